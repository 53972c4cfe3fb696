"""Toxicity: significant passages of token log-odds, calibrated by their extreme-value distribution.

Learning: the distinct words of labelled documents give each word's log-odds between toxic and
clean ones, shrunk by a Dirichlet prior whose shape is the word's share of all documents; words
whose log-odds aren't significant count as neutral. Scoring: every token has its log-odds less a
drift, so that clean text sinks; a linear scan finds all maximal segments of the running sum, and
the largest of them follows an extreme-value distribution in the document's length, which says
how often clean text reaches so high. A calibration turns the document's
evidence into a probability.

Words are runs of letters, lower-cased code point by code point, known by a hash into a fixed
number of slots, so that counts and weights have a bounded size in every task.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

#: Slots that words are hashed into.
SLOTS = 1 << 21
#: Labelled texts that are learned from at most: a uniform draw by hash beyond it. Word shares come from all documents.
LABELLED = 200_000
#: Log-odds count from this many standard deviations.
SIGNIFICANT = 4.0
#: What every token costs: passages bridge about (log-odds of a toxic word) / DRIFT neutral words.
DRIFT = 0.1
#: A passage is reported if clean text of the document's length is expected to hold fewer such passages than this.
EXPECTED = 0.01
#: Evidence is counted in bins of this width for the calibration, between these bounds.
BIN, LOWEST, HIGHEST = 0.25, -40.0, 60.0
#: Code points worked on at once.
CHUNK = 2_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


@cache
def _letters() -> np.ndarray:
    """For every code point: 0 if it is no letter or mark, else a hash of its lower-case form."""
    out = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if c < 0xD800 or c > 0xDFFF:
            if unicodedata.category(ch)[0] in "LM":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
    at = np.flatnonzero(out)
    out[at] = _mixed(out[at]) | np.uint64(1)
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, text, start, end) of every word; starts and ends are code points within the text."""
    joined = "\n".join(texts)  # a line feed is no letter: words end with their texts
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _letters()[points]
    is_letter = h != 0
    edge = np.flatnonzero(np.diff(is_letter, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    place = np.arange(len(points), dtype=np.uint64)
    place[is_letter] -= np.repeat(starts.astype(np.uint64), ends - starts)
    h = _mixed(h ^ (place * _MIX[0]))
    h[~is_letter] = 0
    slot = (_mixed(np.add.reduceat(h, starts)) % np.uint64(SLOTS)).astype(np.int64)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(first, starts, "right") - 1
    return slot, text, starts - first[text], ends - first[text]


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of bounded length, with the place of the first."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, sum), in order: Ruzzo and Tompa's linear scan.

    Only positive scores begin or end a segment, so the scan steps over them alone and takes what lies between from running sums.
    """
    before = np.concatenate([[0.0], np.cumsum(score)])
    at = np.flatnonzero(score > 0)
    return _scan(at.tolist(), before[at].tolist(), before[at + 1].tolist())


def _scan(at: list[int], low: list[float], high: list[float]) -> list[tuple[int, int, float]]:
    """The scan itself: places of positive scores and the running sums before and after each."""
    starts, ends, lows, highs, back = [], [], [], [], []
    for k, lo, hi in zip(at, low, high, strict=True):
        start, end = k, k + 1
        while True:
            # the last earlier segment that begins lower
            j = len(lows) - 1
            while j >= 0 and lows[j] >= lo:
                j = back[j]
            if j < 0 or highs[j] >= hi:
                starts.append(start), ends.append(end), lows.append(lo), highs.append(hi), back.append(j)
                break
            start, lo = starts[j], lows[j]
            del starts[j:], ends[j:], lows[j:], highs[j:], back[j:]
    return [(s, e, h - lo) for s, e, lo, h in zip(starts, ends, lows, highs, strict=True)]


@dataclass
class Model:
    """Fitted parameters: weights of significant slots, tail of the largest segment, probability of each bin of evidence."""

    slots: np.ndarray
    weights: np.ndarray
    lam: float
    k: float
    #: Ends of the calibration's steps and the probability below each (one more than ends).
    steps: np.ndarray
    chances: np.ndarray
    base: float

    def table(self) -> np.ndarray:
        out = np.full(SLOTS, -DRIFT)
        out[self.slots] = self.weights - DRIFT
        return out

    def evidence(self, best: float, n: int) -> float:
        """The largest segment as a standard extreme value: its tail less what the document's length makes likely."""
        return self.lam * best - math.log(self.k * max(n, 1)) if best > 0 else LOWEST

    def expected(self, score: float, n: int) -> float:
        """How many segments of that score clean text of that length holds."""
        return self.k * n * math.exp(-self.lam * score)


def _labels(docs: DataFrame, labels: DataFrame, learn: Column, limit: int) -> DataFrame:
    """(doc_id, toxic) of the texts learned from: one row for each distinct text, with the mean of its copies' labels."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")
    )
    once = rows.join(known, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))
    once = materialise(once.select("doc_id", "toxic", F.pmod(F.xxhash64(F.col("h"), F.lit(7)), F.lit(1 << 30)).alias("draw")), "labelled")
    n, cut = once.count(), 1 << 30
    while n > limit:  # a threshold on the draw that leaves about the limit, never more
        cut = int(cut * limit / n * 0.98)
        once = once.where(F.col("draw") < cut)
        n = once.count()
    return once.select("doc_id", "toxic")


def _slot_counts(docs: DataFrame) -> DataFrame:
    """(slot, n, n_toxic, n_clean): rows that hold a word of the slot, all and learned ones. Tasks add up before they shuffle."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((3, SLOTS))
        for batch in batches:
            texts, toxic = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for first, part in _chunks(texts):
                slot, text, _, _ = tokens(part)
                pair = np.unique(text * SLOTS + slot)
                slot, label = pair % SLOTS, toxic[first + pair // SLOTS]
                sums[0] += np.bincount(slot, minlength=SLOTS)
                learned = ~np.isnan(label)
                slot, label = slot[learned], label[learned]
                sums[1] += np.bincount(slot, label, SLOTS)
                sums[2] += np.bincount(slot, 1 - label, SLOTS)
        at = np.flatnonzero(sums[0])
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(s[some]) for s in sums)], ["slot", "n", "n_toxic", "n_clean"])

    rows = docs.select("text", F.col("toxic").cast("double"))
    got = rows.mapInArrow(count, "slot int, n double, n_toxic double, n_clean double")
    return got.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", "n_toxic", "n_clean")))


def log_odds(counts: DataFrame) -> DataFrame:
    """(slot, n_clean, delta, z) with an informative Dirichlet prior: as many prior words as toxic ones were seen, shared out as in all documents."""
    totals = counts.agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "n_toxic", "n_clean")))
    prior = F.col("all_n_toxic") * F.col("n") / F.col("all_n")
    toxic, clean = F.col("n_toxic") + prior, F.col("n_clean") + prior
    of = lambda y, total: F.log(y / (total + F.col("all_n_toxic") - y))
    delta = of(toxic, F.col("all_n_toxic")) - of(clean, F.col("all_n_clean"))
    return counts.join(F.broadcast(totals)).where((F.col("all_n_toxic") > 0) & (F.col("all_n_clean") > 0)).select(
        "slot", "n_clean", "all_n_clean", delta.alias("delta"), (delta / F.sqrt(1 / toxic + 1 / clean)).alias("z")
    )


def _tail(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * value)) = 1; the mean value is negative and some value positive."""
    low, high = 1e-6, 1.0
    f = lambda x: float(np.dot(shares, np.exp(x * values))) - 1
    while f(high) < 0:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return high


def _segments(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """The ``extra`` columns of docs and: n_tokens, best, evidence, passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*extra, "text")
    passage = "array<struct<start:int,end:int,score:double,expected:double>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "n_tokens long", "best double", "evidence double", f"passages {passage}"])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        worth = m.table()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(len(extra)).to_pylist()]
            count, best = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            passages: list[list[dict]] = [[] for _ in texts]
            for first, part in _chunks(texts):
                slot, text, start, end = tokens(part)
                score = worth[slot]
                n = np.bincount(text, minlength=len(part))
                count[first : first + len(part)] = n
                before = np.concatenate([[0.0], np.cumsum(score)])
                at = np.flatnonzero(score > 0)
                owner, cuts = text[at], None
                for who in np.unique(owner).tolist():
                    cuts = slice(*np.searchsorted(owner, [who, who + 1]))
                    mine = at[cuts]
                    found = _scan(mine.tolist(), before[mine].tolist(), before[mine + 1].tolist())
                    best[first + who] = max(s for _, _, s in found)
                    length = int(n[who])
                    passages[first + who] = [
                        {"start": int(start[a]), "end": int(end[b - 1]), "score": s, "expected": e}
                        for a, b, s in found if (e := m.expected(s, length)) < EXPECTED
                    ]
            evidence = [m.evidence(b, c) for b, c in zip(best.tolist(), count.tolist(), strict=True)]
            arrays = [*(batch.column(i) for i in range(len(extra))), pa.array(count), pa.array(best), pa.array(evidence), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [*extra, "n_tokens", "best", "evidence", "passages"])

    bounded_batches(docs.sparkSession)
    return kept.mapInArrow(scan, schema)


def _rising(n: np.ndarray, toxic: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a rising probability over bins: neighbours that fall are pooled; each step is drawn to the base rate by two rows."""
    pools: list[list[float]] = []
    for i, (a, b) in enumerate(zip(n.tolist(), toxic.tolist(), strict=True)):
        if a:
            pools.append([a, b, i])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                a2, b2, last = pools.pop()
                pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, last]
    chances = [(b + 2 * base) / (a + 2) for a, b, _ in pools]
    return np.array([p[2] for p in pools[:-1]], float), np.array(chances or [base])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = LABELLED) -> Model:
    """Learn from the rows of ``docs`` where ``learn`` holds and ``labels`` has their doc_id; word shares come from all rows.

    Without a toxic or without a clean labelled text there is nothing to tell apart: every score is the labels' mean (0 without labels).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = _labels(docs, labels, learn, limit)  # at most ``limit`` rows
    base = chosen.agg(F.avg("toxic")).first()[0] or 0.0
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left")
    odds = log_odds(materialise(_slot_counts(marked), "slots")).where(F.abs("z") >= SIGNIFICANT)
    got: pd.DataFrame = odds.select("slot", "n_clean", "all_n_clean", "delta").toPandas()  # a row for each slot at most
    slots, weights = got["slot"].to_numpy(np.int64), got["delta"].to_numpy(float)
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0, np.zeros(0), np.array([base]), base)
    if not (weights > DRIFT).any():
        return nothing
    share = np.maximum(got["n_clean"].to_numpy(float), 0.5) / float(got["all_n_clean"].iloc[0])
    values = np.append(weights - DRIFT, -DRIFT)
    shares = np.append(share, max(1 - share.sum(), 0.0))
    if np.dot(values, shares) >= 0:
        return nothing
    model = Model(slots, weights, _tail(values, shares), 1.0, np.zeros(0), np.array([base]), base)
    learned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    seen = materialise(_segments(learned, model, ["doc_id", "toxic"]).select("toxic", "n_tokens", "best"), "segments")
    # the likeliest constant of the tail: documents over the sum of length * exp(-tail * largest segment), clean texts alone
    clean = seen.where((F.col("toxic") < 0.5) & (F.col("n_tokens") > 0))
    n, total = clean.agg(F.count("*"), F.sum(F.col("n_tokens") * F.exp(-model.lam * F.col("best")))).first()
    model.k = n / total if n and total else 1.0
    evidence = F.when(F.col("best") > 0, model.lam * F.col("best") - F.log(F.lit(model.k) * F.greatest("n_tokens", F.lit(1)))).otherwise(LOWEST)
    place = F.floor((F.least(F.greatest(evidence, F.lit(LOWEST)), F.lit(HIGHEST)) - LOWEST) / BIN).cast("int")
    bins: pd.DataFrame = seen.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas()
    size = int((HIGHEST - LOWEST) / BIN) + 1
    counts = [np.bincount(bins["bin"].to_numpy(np.int64), bins[c].to_numpy(float), size) for c in ("n", "toxic")]
    ends, model.chances = _rising(*counts, base)
    model.steps = LOWEST + (ends + 1) * BIN
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, score (probability that it is labelled toxic), predicted, n_tokens, evidence and significant passages.

    A passage has the code points of its start and end, the sum of its tokens and the number of
    such passages expected in clean text of the document's length. Null and empty texts have no
    tokens and the lowest evidence. Repeated rows give a row each, a null doc_id stays null, extra
    columns are left out, an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _segments(rows, model, ["doc_id"])
    chance = F.lit(float(model.chances[0]))
    for end, p in zip(model.steps.tolist(), model.chances[1:].tolist(), strict=True):
        chance = F.when(F.col("evidence") >= end, F.lit(p)).otherwise(chance)
    scored = found.withColumn("score", chance)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "evidence", "passages")
