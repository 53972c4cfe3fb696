"""Language-model scoring with a causal self-attention model on subword ids.

Lower-cased words are encoded by a public byte-level vocabulary; a text is the ids of its words
and an end. An attention block, trained in numpy, reads a window of ids and predicts the class of
each next id; an id within its class follows its share of the whole training corpus. Windows of
all ids of the training documents are trained on, in tasks, and weights are averaged after
each round. Scoring covers each text with overlapping windows by batched masked attention; each
id is scored once.
"""

from __future__ import annotations

import base64
import math
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep_memory, materialise, tidy

#: Ids of a window; how far the next window starts (each later window has WINDOW - STRIDE ids of context at least).
WINDOW, STRIDE = 32, 24
#: Numbers of a hidden state and of the layer between; classes of ids, and those that hold a single, frequent id.
WIDTH, HIDDEN, CLASSES, SINGLE = 16, 32, 64, 44
#: Ids with an input vector of their own, by frequency; buckets that the others share.
OWN_IDS, SHARED_IDS = 1024, 64
#: Words for each place of :func:`drawn_places`; rounds of training; windows of a step; step size.
DRAW_WORDS, ROUNDS, BATCH, SPEED = 256, 2, 32, 0.02
#: Windows that are trained on one after the other, about.
SHARD_WINDOWS = 20_000
#: Rows that are cut together, windows that a task deals at once, about (both bound its memory); groups that shards go to, more only if a group would have over GROUP_SHARDS of them.
CUT_ROWS, DEAL_WINDOWS, GROUPS, GROUP_SHARDS = 250, 300_000, 2048, 16
#: Words whose counts are broadcast, at most (the most frequent); other words get theirs by a join, with the same result.
HEAD_WORDS = 400_000
#: Words that a Python worker remembers before it starts anew; windows that are scored together.
CACHE_WORDS, TOGETHER = 700_000, 96
N_IDS = 50_256
#: After the ids: the end of a text, and the start of a text as an input.
END, BOS = N_IDS, N_IDS + 1
#: In a stored window: no id, past the end of a text.
PAST = 0xFFFF

_kept: dict = {}


def load_ranks(file: str):
    """A tiktoken encoding of a file of ranks; kept by each Python worker."""
    if file not in _kept:
        import public_tokenizers
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _kept[file] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _kept[file]


def split_words(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the word at each place of all texts, words of each text) of an Arrow array of texts.

    Words are runs of other than ASCII white space, A-Z lower-cased.
    """
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded, counts = parts.flatten().dictionary_encode(), np.diff(parts.offsets.to_numpy())
    names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    if "" in names:  # beside white space at the ends of a text
        some = index != names.index("")
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[some], minlength=len(counts))
        index = index[some]
    return names, index, counts


@dataclass
class Vocabulary:
    """What counts fix for ids: input symbol, class, log10 probability within the class, and log probability of the class."""

    symbol: np.ndarray
    cls: np.ndarray
    within: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, company: np.ndarray) -> Vocabulary:
        """counts: of ids 0..N_IDS, the last the end (each gets one more). company: [N_IDS + 1, 2 * SINGLE], how often an id
        stands right before and right after each of the most frequent ones; ids without a class of their own are clustered by it."""
        n = counts.astype(float) + 1
        order = np.argsort(-n, kind="stable")
        group = np.full(len(n), CLASSES - 1)
        group[order[:SINGLE]] = np.arange(SINGLE)
        group[order[SINGLE:]] = SINGLE + _clusters(company[order[SINGLE:]], n[order[SINGLE:]], CLASSES - SINGLE)
        size = np.bincount(group, n, CLASSES)
        symbol = OWN_IDS + np.arange(len(n) + 1) % SHARED_IDS
        symbol[order[:OWN_IDS]] = np.arange(OWN_IDS)
        symbol[BOS] = OWN_IDS + SHARED_IDS
        return cls(symbol.astype(np.int32), group.astype(np.int32), np.log10(n / size[group]), np.log(np.maximum(size, 1e-9) / size.sum()))


def _clusters(company: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """k-means of the square roots of profiles; profiles without counts come last, in a cluster of their own."""
    total = company.sum(1)
    some = np.flatnonzero(total > 0)
    out = np.full(len(n), k - 1)
    if len(some) < k:
        return out
    x = np.sqrt((company[some] + 0.1) / (total[some] + 0.1 * company.shape[1])[:, None])
    centre = x[np.linspace(0, min(len(some), 40 * k) - 1, k - 1).astype(int)]
    for _ in range(20):
        near = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        for j in range(k - 1):
            own = near == j
            if own.any():
                centre[j] = np.average(x[own], axis=0, weights=n[some][own])
    out[some] = near
    return out


N_SYMBOLS = OWN_IDS + SHARED_IDS + 1


def new_params(prior: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    g = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    return {
        "E": (0.3 * rng.standard_normal((N_SYMBOLS, WIDTH))).astype(np.float32),
        "P": (0.1 * rng.standard_normal((WINDOW, WIDTH))).astype(np.float32),
        "Q": g(WIDTH, WIDTH), "K": g(WIDTH, WIDTH), "V": g(WIDTH, WIDTH), "O": 0.5 * g(WIDTH, WIDTH),
        "W1": g(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "W2": 0.5 * g(HIDDEN, WIDTH),
        "C": 0.1 * g(WIDTH, CLASSES), "c": prior.astype(np.float32),
    }


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Exponents are held within this bound, so that no maximum need be taken out.
_BOUND = np.float32(60)


def _exp_sum(s: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Exponentials in place, masked; their sums over the last axis."""
    np.clip(s, -_BOUND, _BOUND, out=s)
    np.exp(s, out=s)
    if mask is not None:
        s *= mask
    return s @ np.ones(s.shape[-1], np.float32)


def forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, dict]:
    """Hidden states [windows * WINDOW, WIDTH] for input symbols x [windows, WINDOW]; position i sees positions 0..i only."""
    h0 = p["E"].take(x, axis=0)
    h0 += p["P"]
    flat = h0.reshape(-1, WIDTH)
    q, k, v = ((flat @ p[n]).reshape(h0.shape) for n in "QKV")
    s = np.matmul(q * np.float32(1 / math.sqrt(WIDTH)), k.transpose(0, 2, 1))
    s /= _exp_sum(s, _SEEN)[..., None]
    o = np.matmul(s, v).reshape(-1, WIDTH)
    h1 = o @ p["O"]
    h1 += flat
    z = h1 @ p["W1"]
    z += p["b1"]
    np.maximum(z, 0, out=z)
    h2 = z @ p["W2"]
    h2 += h1
    return h2, {"h0": h0, "q": q, "k": k, "v": v, "a": s, "o": o, "h1": h1, "z": z}


def gradients(p: dict, x: np.ndarray, y: np.ndarray, want_loss: bool = True) -> tuple[dict, float]:
    """Gradients of the mean cross-entropy of classes y (below 0: no target), and the loss (if it isn't wanted: nan)."""
    h2, t = forward(p, x)
    d = h2 @ p["C"]
    d += p["c"]
    d -= d.max(1, keepdims=True)
    np.exp(d, out=d)
    d /= d.sum(1, keepdims=True)
    target = y.ravel()
    on = np.flatnonzero(target >= 0)
    loss = -float(np.log(np.maximum(d[on, target[on]], 1e-30)).mean()) if want_loss else math.nan
    d[on, target[on]] -= 1
    if len(on) < len(target):
        d[target < 0] = 0
    d /= np.float32(max(1, len(on)))
    g = {"C": h2.T @ d, "c": d.sum(0)}
    dh1 = d @ p["C"].T
    g["W2"] = t["z"].T @ dh1
    dz = dh1 @ p["W2"].T
    dz *= t["z"] > 0
    g["W1"], g["b1"] = t["h1"].T @ dz, dz.sum(0)
    dh1 += dz @ p["W1"].T
    g["O"] = t["o"].T @ dh1
    do = (dh1 @ p["O"].T).reshape(t["h0"].shape)
    ds = np.matmul(do, t["v"].transpose(0, 2, 1))
    dv = np.matmul(t["a"].transpose(0, 2, 1), do)
    ds -= (ds * t["a"]).sum(-1, keepdims=True)
    ds *= t["a"]
    ds *= np.float32(1 / math.sqrt(WIDTH))
    dq, dk = np.matmul(ds, t["k"]), np.matmul(ds.transpose(0, 2, 1), t["q"])
    x0 = t["h0"].reshape(-1, WIDTH)
    dx = dh1
    for n, dd in (("Q", dq), ("K", dk), ("V", dv)):
        dd = dd.reshape(-1, WIDTH)
        g[n] = x0.T @ dd
        dx += dd @ p[n].T
    g["P"] = dx.reshape(t["h0"].shape).sum(0)
    place = x.reshape(-1, 1) * np.intp(WIDTH) + np.arange(WIDTH)
    g["E"] = np.bincount(place.ravel(), dx.ravel(), p["E"].size).reshape(p["E"].shape)
    return g, loss


def train_local(p: dict, x: np.ndarray, y: np.ndarray, seed: int, round_: int) -> dict:
    """One pass over windows by Adam, from the given weights."""
    shapes = {k: v.shape for k, v in p.items()}
    flat = np.concatenate([v.ravel() for v in p.values()]).astype(np.float32)  # all weights in one array, so that a step is a few calls
    cuts = np.split(flat, np.cumsum([math.prod(s) for s in shapes.values()])[:-1])
    p = {k: c.reshape(s) for (k, s), c in zip(shapes.items(), cuts, strict=True)}  # views
    m, v, step = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    order, n = np.random.default_rng(seed).permutation(len(x)), 0
    for at in range(0, len(x), BATCH):
        b = order[at : at + BATCH]
        g, _ = gradients(p, x[b], y[b], want_loss=False)
        g = np.concatenate([g[k].ravel() for k in shapes], dtype=np.float32)
        n += 1
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        v *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        v += g
        np.multiply(v, np.float32(1 / (1 - 0.99**n)), out=step)
        np.sqrt(step, out=step)
        step += np.float32(1e-6)
        np.divide(m, step, out=step)
        step *= np.float32(SPEED / (1 + round_) / (1 - 0.9**n))
        flat -= step
    return p


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut documents of so many ids (one after the other) into windows.

    Returns for each place of the windows [n, WINDOW] the id read there (-1: the start of a
    text, or past its end) and the id scored there (-1: scored by another window, or none),
    and the document of each window.
    """
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), n)
    k = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    start = np.repeat(np.cumsum(sizes) - sizes, n).astype(np.int32)
    at = k[:, None] * np.int32(STRIDE) + np.arange(WINDOW, dtype=np.int32)  # place in its document
    past = at >= sizes.astype(np.int32)[doc][:, None]
    scored = start[:, None] + at
    read = scored - np.int32(1)
    read[past | (at == 0)] = -1
    scored[past] = -1
    scored[k > 0, : WINDOW - STRIDE] = -1
    return read, scored, doc


@dataclass
class Scorer:
    """The trained model; log10 probabilities of whole documents."""

    vocab: Vocabulary
    params: dict = field(repr=False)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ids: of all documents, each document closed by END; sizes: ids of each."""
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.vocab.within[ids], len(sizes)).astype(float)
        cls, symbol = self.vocab.cls[ids], np.append(self.vocab.symbol[ids], self.vocab.symbol[BOS])  # the last one is read at -1
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 500_000)))
            base = int(ends[lo - 1]) if lo else 0
            read, scored, doc = windows(sizes[lo:hi])
            read[read >= 0] += base
            scored[scored >= 0] += base
            got = np.zeros(len(read))
            for at in range(0, len(read), TOGETHER):
                t = scored[at : at + TOGETHER].ravel()
                h, _ = forward(self.params, symbol[read[at : at + TOGETHER]])
                on = np.flatnonzero(t >= 0)
                logits = h[on] @ self.params["C"]
                logits += self.params["c"]
                picked = logits[np.arange(len(on)), cls[t[on]]]
                s = np.clip(picked, -_BOUND, _BOUND) - np.log(_exp_sum(logits))
                n = len(read[at : at + TOGETHER])
                got[at : at + n] = np.bincount(on // WINDOW, s, n)
            total[lo:hi] += np.bincount(doc, got, hi - lo) / math.log(10)
            lo = hi
        return total


class _Known(dict):
    """Word -> its number; keeps the ids of each word and its count in the head (-1: not there). Grows by what is looked up."""

    def __init__(self, ranks, head: dict[str, int] | None = None):
        super().__init__()
        self.encode, self.head = ranks.encode_ordinary, head or {}
        self.flat, self.first, self.sizes, self.counts = array("i", [END]), array("q", [0]), array("q", [1]), array("q", [0])  # 0 is the end

    def __missing__(self, w: str) -> int:
        ids = self.encode(" " + w)
        self.first.append(len(self.flat))
        self.sizes.append(len(ids))
        self.counts.append(self.head.get(w, -1))
        self.flat.extend(ids)
        self[w] = n = len(self.sizes) - 1
        return n

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.fromiter((self[w] if w else 0 for w in names), np.int64, len(names))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after the other, ids of each)."""
        first, sizes = np.frombuffer(self.first, np.int64), np.frombuffer(self.sizes, np.int64)
        n = sizes[numbers]
        at = np.arange(n.sum()) + np.repeat(first[numbers] - (np.cumsum(n) - n), n)
        return np.frombuffer(self.flat, np.int32)[at], n


def document_ids(known: _Known, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, each closed by END; ids of each) from the numbers of their words."""
    ids, n = known.ids(np.insert(numbers, np.cumsum(counts), 0))
    return ids, np.add.reduceat(n, np.cumsum([0, *(counts[:-1] + 1)])) if len(counts) else np.zeros(0, np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of a column ``text``; each task counts its own words before they shuffle."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[str, int] = {}

        def out() -> Iterator:
            words, n = list(seen.keys()), np.fromiter(seen.values(), np.int64, len(seen))
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array(n[at : at + 50_000])], ["word", "n"])
            seen.clear()

        get = seen.get
        for batch in batches:
            names, index, _ = split_words(batch.column(0))
            for w, n in zip(names, np.bincount(index, minlength=len(names)).tolist(), strict=True):
                if n:
                    seen[w] = get(w, 0) + n
            if len(seen) > 3_000_000:
                yield from out()
        yield from out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_statistics(vocab: DataFrame, file: str) -> DataFrame:
    """Counts of ids in the training corpus, from its word counts: (a, b, n): b follows a inside a word, or a < 0 and b is any id of a word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_ranks(file).encode_ordinary
        for pdf in batches:
            ids = [encode(" " + w) for w in pdf["word"]]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, n = np.fromiter((i for x in ids for i in x), np.int64, size.sum()), np.repeat(pdf["n"].to_numpy(), size)
            inside = np.ones(len(flat), bool)
            inside[np.cumsum(size) - 1] = False
            at = np.flatnonzero(inside)
            found, where = np.unique(np.concatenate([flat[at] * N_IDS + flat[at + 1], -1 - flat]), return_inverse=True)
            total = np.bincount(where, np.concatenate([n[at], n])).astype(np.int64)
            single = found < 0
            yield pd.DataFrame({"a": np.where(single, -1, found // N_IDS), "b": np.where(single, -1 - found, found % N_IDS), "n": total})

    return vocab.mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` rows have a count of it or more, however high counts are."""
    rows = counts.groupBy((F.length(F.bin("n")) - 1).alias("k")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 64 at most
    least, have = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r["k"]):
        have += r["rows"]
        if have > most:
            break
        least = 1 << r["k"]
    return least


def vocabulary_of(stats: DataFrame, n_docs: int) -> Vocabulary:
    """Classes from the whole corpus's counts; what reaches the driver is bounded by the number of ids."""
    counts = np.zeros(N_IDS + 1)
    for r in stats.where("a < 0").toLocalIterator():
        counts[r["b"]] = r["n"]
    counts[END] = n_docs
    anchors = np.argsort(-(counts + 1), kind="stable")[:SINGLE]
    place = np.full(N_IDS + 1, -1)
    place[anchors] = np.arange(SINGLE)
    company = np.zeros((N_IDS + 1, 2 * SINGLE))
    names = [int(i) for i in anchors]
    got = stats.where((F.col("a") >= 0) & (F.col("a").isin(names) | F.col("b").isin(names))).toArrow()  # at most ids times 2 * SINGLE rows
    a, b, n = (got[c].to_numpy() for c in ("a", "b", "n"))
    before, after = place[b] >= 0, place[a] >= 0
    company[a[before], place[b[before]]] = n[before]
    company[b[after], SINGLE + place[a[after]]] = n[after]
    return Vocabulary.of(counts, company)


def drawn_places(counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, hash) of places in documents of so many words, for trials with fewer windows (training takes all): one for each DRAW_WORDS, at a place of these that follows from the document's hash."""
    n = counts // DRAW_WORDS + 1
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = h[doc].astype(np.uint64) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    own = (own ^ (own >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    own ^= own >> np.uint64(31)
    room = np.minimum(DRAW_WORDS, counts[doc] + 1 - k * DRAW_WORDS)
    return doc, k * DRAW_WORDS + ((own >> np.uint64(11)).astype(np.float64) / (1 << 53) * room).astype(np.int64), own.view(np.int64)


def id_windows(ids: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, hash) of the windows that cover all ids of documents of ``sizes`` ids: the id before a window (or BOS) and its own in 16 bits each (PAST: none)."""
    n = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(sizes) - sizes
    place = k[:, None] * WINDOW + np.arange(WINDOW)
    inside = place < sizes[doc][:, None]
    at = np.where(inside, begin[doc][:, None] + place, 0)
    own_ids = np.where(inside, ids[at], PAST)
    before = np.where(k > 0, ids[at[:, 0] - 1], BOS)
    w = np.concatenate([before[:, None], own_ids], axis=1).astype(np.uint16)
    with np.errstate(over="ignore"):
        own = h[doc].astype(np.uint64) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        own = (own ^ (own >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return w, (own ^ (own >> np.uint64(31))).view(np.int64)


def symbols_of(w: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of windows of ids: each id's class (past the end: -1) is the target of one place, after the symbol of the id before it."""
    inside = w[:, 1:] != PAST
    y = np.where(inside, vocab.cls[np.where(inside, w[:, 1:], 0)], -1).astype(np.int16)
    x = vocab.symbol[np.where(inside, w[:, :-1], BOS)].astype(np.int16)
    return x, y


def _cut(batches: Iterator, file: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`id_windows` of Arrow batches of a text and a hash."""
    known = _Known(load_ranks(file))
    for batch in batches:
        if len(known) > CACHE_WORDS:
            known = _Known(load_ranks(file))
        for k in range(0, batch.num_rows, CUT_ROWS):
            part = batch.slice(k, CUT_ROWS)
            names, index, counts = split_words(part.column(0))
            ids, sizes = document_ids(known, known.numbers(names)[index], counts)
            yield id_windows(ids, sizes, part.column(1).to_numpy())


def _hashed(texts: DataFrame) -> DataFrame:
    return texts.select("text", F.col("h") if "h" in texts.columns else F.xxhash64("text").alias("h"))


def stored_windows(texts: DataFrame, file: str) -> DataFrame:
    """(w, h): :func:`id_windows` of every text and a hash, half as many bytes as symbols and classes.

    A window follows from its row alone: its text and, if there, its hash ``h``.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for w, tags in _cut(batches, file):
            for k in range(0, len(w), SHARD_WINDOWS):
                part = pa.array([r.tobytes() for r in w[k : k + SHARD_WINDOWS]], pa.binary())
                yield pa.RecordBatch.from_arrays([part, pa.array(tags[k : k + SHARD_WINDOWS])], ["w", "h"])

    return _hashed(texts).mapInArrow(cut, "w binary, h long")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of windows by their hash: ``pmod(xxhash64(h), shards)`` as Spark takes it."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        x = turned(h.view(np.uint64) * p2, 31) * p1 ^ (np.uint64(42 + 8) + p5)
        x = turned(x, 27) * p1 + p4
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
    return (x ^ (x >> np.uint64(32))).view(np.int64) % shards


def dealt_windows(texts: DataFrame, file: str, shards: int) -> DataFrame:
    """(shard, n, w): the :func:`id_windows` of all texts, a row for each shard, in the order of their hashes; compressed.

    Tasks pack the windows of one group of shards before they shuffle, which takes 6 bytes for 10 of windows that go one by one.
    """
    groups = min(shards, max(GROUPS, -(-shards // GROUP_SHARDS)))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator:
            w, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            group = shard_of(h, shards) % groups
            order = np.argsort(group, kind="stable")
            names, first = np.unique(group[order], return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            for k in range(0, len(names), 64):
                own = [order[a:b] for a, b in zip(first[k : k + 64].tolist(), ends[k : k + 64], strict=True)]
                columns = [pa.array(names[k : k + 64]), pa.array([squeeze(w[i].tobytes()) for i in own], pa.binary()), pa.array([h[i].tobytes() for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["g", "w", "h"])

        for w, h in _cut(batches, file):
            for k in range(0, len(w), DEAL_WINDOWS):
                held.append((w[k : k + DEAL_WINDOWS], h[k : k + DEAL_WINDOWS]))
                if sum(len(x) for x, _ in held) >= DEAL_WINDOWS:
                    yield from out()
        if held:
            yield from out()

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        squeeze, spread = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        h, w = np.frombuffer(b"".join(pdf["h"]), np.int64), unpacked(map(spread, pdf["w"]))
        shard = shard_of(h, shards)
        order = np.lexsort((h, shard))
        if (np.diff(h[order]) == 0).any():  # repeated rows: by their bytes
            order = np.lexsort((w.view(f"S{w.itemsize * w.shape[1]}").ravel(), h, shard))
        names, first = np.unique(shard[order], return_index=True)
        own = np.split(order, first[1:])
        return pd.DataFrame({"shard": names, "n": [len(i) for i in own], "w": [squeeze(w[i].tobytes()) for i in own]})

    rows = _hashed(texts).mapInArrow(tidy(pack), "g long, w binary, h binary")
    return rows.groupBy("g").applyInPandas(sort, "shard long, n long, w binary")


def training_windows(texts: DataFrame, file: str, vocab: Vocabulary) -> DataFrame:
    """(x, y, h): input symbols and target classes of windows that cover every text, and a hash; a place past the end has class -1."""

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = symbols_of(unpacked(pdf["w"]), vocab)
            yield pd.DataFrame({"x": [r.tobytes() for r in x], "y": [r.tobytes() for r in y], "h": pdf["h"]})

    return stored_windows(texts, file).mapInPandas(known, "x binary, y binary, h long")


def unpacked(w: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w), np.uint16).reshape(-1, WINDOW + 1)


def train(texts: DataFrame, file: str, vocab: Vocabulary, rounds: int = ROUNDS, n_windows: int | None = None) -> dict:
    """Weights after ``rounds``: windows are dealt to shards, each trains from the common weights, then weights are averaged by windows.

    There is a shard for each SHARD_WINDOWS windows begun, of ``n_windows`` (about how many there are; counted if not given); a window's
    hash tells its shard and its place there, so the weights don't depend on how the texts are partitioned. Windows shuffle once, to files that all
    rounds read. Averages are taken in Spark, so the driver gets one number for each weight. No window: the untrained weights.
    """
    spark = texts.sparkSession
    shards = max(1, -(-(stored_windows(texts, file).count() if n_windows is None else n_windows) // SHARD_WINDOWS))
    table = materialise(dealt_windows(texts, file, shards), "lm-windows")
    params = new_params(vocab.prior)
    shapes = {k: v.shape for k, v in params.items()}

    def learner(now: dict, r: int):
        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import zstandard

            keep_memory()
            spread, total, count = zstandard.ZstdDecompressor().decompress, 0.0, 0
            for pdf in batches:
                for packed in pdf["w"]:
                    x, y = symbols_of(unpacked([spread(packed)]), vocab)
                    local = now
                    for k in range(0, len(x), 20_000):
                        local = train_local(local, x[k : k + 20_000], y[k : k + 20_000], k + r, r)
                    flat = np.concatenate([local[k].ravel() for k in shapes]).astype(float)
                    total, count = total + flat * len(x), count + len(x)
            if count:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total, "n": np.float64(count)})

        return tidy(learn)

    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    bounded_batches(spark, 4)  # a row is a whole shard
    try:
        for r in range(rounds):
            mean = table.mapInPandas(learner(params, r), "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"))
            got = mean.toArrow().to_pandas()
            if not len(got):
                break
            flat = np.zeros(len(got), np.float32)
            flat[got["i"].to_numpy()] = got["v"].to_numpy()
            params, at = {}, 0
            for k, s in shapes.items():
                n = int(np.prod(s))
                params[k] = flat[at : at + n].reshape(s)
                at += n
    finally:
        bounded_batches(spark, int(rows))
    return params


@dataclass
class Fitted:
    """A scorer, and the counts of the words it learned from."""

    scorer: Scorer
    words: DataFrame
    n_docs: int
    distinct: int
    total: int


def fit(texts: DataFrame, ranks_file: str) -> Fitted:
    """Learn from a column ``text``: counts of all of it, and weights from windows that cover every text; a column ``h`` tells copies of a text apart."""
    words = materialise(word_counts(texts), "lm-words")
    n_docs = texts.count()
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    stats = materialise(id_statistics(words, ranks_file), "lm-ids")
    vocab = vocabulary_of(stats, n_docs)
    # a text's ids and its end leave half a window empty, about
    n_windows = ((stats.where("a < 0").agg(F.sum("n")).first()[0] or 0) + n_docs) // WINDOW + n_docs // 2
    return Fitted(Scorer(vocab, train(texts, ranks_file, vocab, n_windows=n_windows)), words, n_docs, sums["words"] + (n_docs > 0), (sums["n"] or 0) + n_docs)


def score_documents(docs: DataFrame, ranks_file: str, training: Column | None = None, fitted: Fitted | None = None,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, n_subwords.

    ``training`` tells which rows teach (all by default; null: yes), unless ``fitted`` is given. Tokens
    are the words and one end; base_score adds one to each count over the training tokens, score is the
    model's log10 probability of the lower-cased text. Null counts as empty. Repeated rows are scored
    each; extra columns aren't carried. Without training rows the model knows nothing but still
    gives each id a probability. ``ranks_file`` has to be readable by every worker.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    teach = F.coalesce(training, F.lit(True)) if training is not None else F.lit(True)
    rows = docs.select(F.col(doc_id).alias("doc_id"), teach.alias("learned"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fitted = fitted or fit(rows.where("learned").select("text", F.xxhash64("doc_id", "text").alias("h")), ranks_file)
    words, n_docs, total, distinct = fitted.words, fitted.n_docs, fitted.total, fitted.distinct
    head = words.where(F.col("n") >= least_count(words, HEAD_WORDS)).toArrow().to_pandas()  # at most HEAD_WORDS words
    sent = spark.sparkContext.broadcast((" ".join(head["word"]), head["n"].to_numpy(np.int64), fitted.scorer))
    mark = uuid.uuid4().hex

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        if _kept.get("head", (None,))[0] != mark:
            names, n, model = sent.value
            _kept["head"] = (mark, _Known(load_ranks(ranks_file), dict(zip(names.split(" "), n.tolist(), strict=True)) if len(n) else {}), model)
        _, known, model = _kept["head"]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            if len(known) > CACHE_WORDS:
                known = _Known(load_ranks(ranks_file), known.head)
                _kept["head"] = (mark, known, model)
            names, index, counts = split_words(batch.column(2))
            numbers = known.numbers(names)[index]
            c = np.frombuffer(known.counts, np.int64)[numbers]
            doc = np.repeat(np.arange(len(counts)), counts)
            inside = c >= 0
            base = np.bincount(doc[inside], np.log10(c[inside] + 1.0), len(counts)).astype(float)
            seen = np.bincount(doc[inside & (c > 0)], minlength=len(counts))
            rare, owner = [names[i] for i in index[~inside].tolist()], doc[~inside]
            cut = np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()
            tails = [" ".join(rare[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            ids, sizes = document_ids(known, numbers, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(counts), dtype=np.int64)), batch.column(0), batch.column(1), pa.array(counts + 1, pa.int64()), pa.array(seen, pa.int64()),
                    pa.array(base), pa.array(model.score(ids, sizes)), pa.array(sizes, pa.int64()), pa.array(tails, pa.string()),
                ],
                ["row", "doc_id", "learned", "n_tokens", "head_known", "head_base", "score", "n_subwords", "tail"],
            )
            row += len(counts)

    kind = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, learned boolean, n_tokens long, head_known long, head_base double, score double, n_subwords long, tail string"
    scored = materialise(rows.mapInArrow(score, kind), "lm-scores")
    tail = scored.where(F.length("tail") > 0).select("row", F.explode(F.split("tail", " ")).alias("word"))
    counted = tail.join(words, "word")  # a word that training lacks adds nothing
    sums = counted.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("tail_base"), F.count("n").alias("tail_known"))
    end = math.log10(n_docs + 1.0)
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "learned", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1.0))).alias("base_score"),
        "score", "n_subwords",
    )
