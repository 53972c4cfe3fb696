"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids meet there.

A's tokens come from a byte-level BPE file of the tokenizers library, B's from a sentencepiece
model with byte fallback; both spell a space followed by the text. Both are known by the byte
offsets at which their tokens end. :func:`align` walks the two arrays of ends along a diagonal:
at the current shift between them it compares slices of doubling length and so jumps over
stretches of one token to one token; where the ends differ it moves the lagging side alone until
both end together, which closes an irregular group and gives the next shift.

Texts are cut into stretches before a space that follows no white space: neither tokenizer joins
across such a place, so tokens, ends and groups of a text are those of its stretches in order. The
stretches that a task has not met before are encoded and aligned together, as one long pair of arrays.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialise

#: Stretches that a task remembers before it starts anew.
STRETCHES = 150_000
#: Rows that go to Python together, whose new stretches are encoded together.
ROWS = 100
#: Stretches that are encoded as one text.
TOGETHER = 1000
#: Linked id pairs looked up at once; more pairs make further passes, whose sums are added.
PASS_PAIRS = 4_000_000

#: How plain byte-level files cut words. Fixed value.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=\S) ")
#: White space that can stand before a space without a cut there: ASCII first, then beyond it.
_BEFORE = [f"{c} " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_BEFORE_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The tokens of each side that close a group: positions in ``a`` and in ``b`` of the ends that both have.

    Both lists rise strictly and have the same last end (or are empty). Linear in their lengths.
    """
    at_a, at_b = [], []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            first, width = i, 1
            while width and i < n and j < m:
                if a[i : i + width] == b[j : j + width]:  # both slices may be cut short, at the same last end
                    step = min(width, n - i)
                    i, j, width = i + step, j + step, 2 * width
                else:
                    width //= 2
                    while width:  # the first difference lies within: halve down to it
                        if a[i : i + width] == b[j : j + width]:
                            i, j = i + width, j + width
                        width //= 2
            at_a.extend(range(first, i))
            at_b.extend(range(first + j - i, j))
            continue
        while a[i] != b[j]:  # an irregular group
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        at_a.append(i)
        at_b.append(j)
        i, j = i + 1, j + 1
    return at_a, at_b


def stretches(text: str) -> list[str]:
    """The text without the spaces at which it is cut; a space goes before each part."""
    plain = text[:1] != " " and not any(x in text for x in _BEFORE) and (text.isascii() or not _BEFORE_WIDE.search(text))
    return text.split(" ") if plain else _CUT.split(text)


class Pair:
    """Two tokenizers: ids of stretches, and the bytes that each id stands for."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        spelt, vocabulary = _byte_of_letter(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(spelt[c] for c in token) if all(c in spelt for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("\u2581")
        #: Is a text's encoding that of its stretches? Both files have to be of the known kind, or texts stay whole.
        self.ranked = _ranked(self.a, self.bytes_a)
        self.cut = self.ranked is not None and not any("\u2581" in p.lstrip("\u2581") for p in names)
        #: Ids as text, with what follows them in a list of groups.
        self.atoms = [f"{i}{c}" for n, ends in ((len(self.bytes_a), ",|"), (len(names), ",;")) for i in range(n) for c in ends]

    def ids_a(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.ranked else self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """A text that is empty stands for the space that goes before it."""
        return [x or [self.space] for x in self.b.encode(texts, num_threads=1)]

    def encode(self, parts: list[str], spelt: list[bytes]) -> tuple[list[int], list[int], np.ndarray]:
        """(ids of A, ids of B, is it spelt as it stands) of stretches in order; one that isn't has no ids.

        Many stretches are encoded as one text, which ends after a stretch that ends a text of its own.
        """
        groups: list[slice] = []
        first = 0
        for k, p in enumerate(parts):
            if not self.cut or not p or p[-1].isspace() or k - first == TOGETHER or k == len(parts) - 1:
                groups.append(slice(first, k + 1))
                first = k + 1
        flat_a: list[int] = []
        flat_b: list[int] = []
        ok = np.ones(len(parts), bool)
        texts = [" ".join(parts[g]) for g in groups]
        for g, text, y in zip(groups, texts, self.ids_b(texts), strict=True):
            x, want = self.ids_a(f" {text}"), spelt[g]
            if not self._spell(x, y, want):
                x, y = [], []
                for k in range(g.start, g.stop):
                    one, two = self.ids_a(f" {parts[k]}"), self.ids_b([parts[k]])[0]
                    ok[k] = self._spell(one, two, spelt[k : k + 1])
                    if ok[k]:
                        x += one
                        y += two
            flat_a += x
            flat_b += y
        return flat_a, flat_b, ok

    def _spell(self, x: list[int], y: list[int], want: list[bytes]) -> bool:
        """Do both spell the bytes, with a token's end at the end of each?"""
        whole, ends = b"".join(want), np.cumsum([len(w) for w in want])
        sides = ((x, self.bytes_a, self.sizes_a), (y, self.bytes_b, self.sizes_b))
        return all(
            b"".join(map(spelt.__getitem__, ids)) == whole and (len(ends) == 1 or np.isin(ends, np.cumsum(sizes[ids]), assume_unique=True).all())
            for ids, spelt, sizes in sides
        )


def _byte_of_letter() -> dict[str, int]:
    """Byte-level spelling: printable bytes stand for themselves, the others count on from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _ranked(tokenizer, spelt: list[bytes]):
    """The same tokenizer by ranks, which is much faster, if its file is a plain byte-level one whose merges go by id; else None.

    An id's rank is then the rank of the one merge that makes it, so both merge the same pairs in the same order.
    """
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    pre, model, special = spec["pre_tokenizer"] or {}, spec["model"], {t["id"] for t in spec["added_tokens"]}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or any(model.get(k) for k in odd):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    ranks = {w: i for i, w in enumerate(spelt) if i not in special}
    if None in made or made != sorted(set(made)) or len(ranks) != len(made) + 256 or max(ranks[bytes([b])] for b in range(256)) > 255:
        return None
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Stretches(dict):
    """Stretch -> its number. New ones are encoded and aligned together by :meth:`settle`."""

    def __init__(self, pair: Pair, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        super().__init__()
        self.pair, self.counts, self.new = pair, counts, []
        #: For each stretch: is it spelt as it stands, tokens of A and B, groups; its links are those of ``links`` in order.
        self.ok, self.n_a, self.n_b, self.n_groups, self.links = array("b"), array("q"), array("q"), array("q"), array("q")
        self.n_best, self.count_sum, self.text = array("q"), array("q"), []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n

    def settle(self) -> None:
        if not self.new:
            return
        spelt = [f" {p}".encode() for p in self.new]
        ids_a, ids_b, ok = self.pair.encode(self.new, spelt)
        flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.pair.sizes_a[flat_a]), np.cumsum(self.pair.sizes_b[flat_b])
        at_a, at_b = (np.array(x, np.int64) for x in align(ends_a.tolist(), ends_b.tolist()))
        code = flat_a[at_a] << 32 | flat_b[at_b]
        # every stretch ends a group: tokens and groups up to its last byte
        bound = np.cumsum(np.where(ok, [len(w) for w in spelt], 0))
        upto_a, upto_b, upto = (np.searchsorted(e, bound, "right") for e in (ends_a, ends_b, ends_a[at_a]))
        n = np.diff(upto, prepend=0)
        self.ok.frombytes(ok.astype(np.int8).tobytes())
        for out, value in ((self.n_a, np.diff(upto_a, prepend=0)), (self.n_b, np.diff(upto_b, prepend=0)), (self.n_groups, n), (self.links, code)):
            out.frombytes(value.astype(np.int64).tobytes())
        if self.counts is not None:
            self._look_up(code, upto, n)
            self._write(flat_a, flat_b, at_a, at_b, (upto_a + upto_b).tolist())
        self.new = []

    def _look_up(self, code: np.ndarray, upto: np.ndarray, n: np.ndarray) -> None:
        pairs, counts, best = self.counts
        k = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
        hit = pairs[k] == code if len(pairs) else np.zeros(len(code), bool)
        for out, value in ((self.n_best, best), (self.count_sum, counts)):
            sums = np.concatenate([[0], np.cumsum(np.where(hit, value[k], 0) if len(pairs) else np.zeros(len(code), np.int64))])
            out.frombytes((sums[upto] - sums[upto - n]).astype(np.int64).tobytes())

    def _write(self, flat_a: np.ndarray, flat_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, upto: list[int]) -> None:
        """The groups of each stretch as text: A's ids, a bar, B's ids; tokens go to their places in the whole and are joined."""
        last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(flat_a)) + np.concatenate([[0], at_b + 1])[group_a]
        place_b = np.arange(len(flat_b)) + (at_a + 1)[group_b]
        seq = np.zeros(len(flat_a) + len(flat_b), np.int64)
        seq[place_a] = 2 * flat_a + last_a
        seq[place_b] = 2 * (len(self.pair.bytes_a) + flat_b) + last_b
        atoms, first = list(map(self.pair.atoms.__getitem__, seq.tolist())), 0
        for u in upto:
            self.text.append("".join(atoms[first:u])[:-1])
            first = u


@cache
def _pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


_memos: dict[str, Stretches] = {}


def _memo(key: str, make) -> Stretches:
    """The stretches that a task has met; see :func:`_forgetful`."""
    if key not in _memos:
        _memos.clear()
        _memos[key] = make()
    return _memos[key]


def _forget() -> None:
    """Of the module, like :func:`_memo`: functions inside others go to workers with copies of the names they use, and would clear a copy."""
    _memos.clear()
    give_back()


def _forgetful(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's work that leaves neither stretches nor the memory they took to the worker, which serves other stages too."""

    def run(batches: Iterator) -> Iterator:
        _forget()  # what a task that was ended early left
        yield from work(batches)
        _forget()

    return run


def _slices(batches: Iterator) -> Iterator:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _numbered(memo: Stretches, text: str | None) -> list[int]:
    return list(map(memo.__getitem__, stretches(text) if memo.pair.cut else [text])) if text else []


def pair_counts(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """How often each pair of ids ends together in the whole corpus: a, b, n, and whether n is the highest of b (ties included).

    Tasks add up their pairs before they shuffle. Null and empty texts, and texts that a tokenizer
    doesn't spell as they stand, have no tokens; an empty table gives no pairs.
    """
    bounded_batches(docs.sparkSession, ROWS)
    job = uuid.uuid4().hex

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair, seen = _pair(a_file, b_file), np.zeros(0, np.int64)
        memo = _memo(job, lambda: Stretches(pair))
        totals: list[tuple[np.ndarray, np.ndarray]] = []

        def add_up() -> None:
            times = np.zeros(len(memo), np.int64)
            times[: len(seen)] = seen
            code, n = np.array(memo.links, np.int64), np.repeat(times, np.array(memo.n_groups, np.int64))
            totals.append((code[n > 0], n[n > 0]))
            codes, at = np.unique(np.concatenate([c for c, _ in totals]), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, at, np.concatenate([k for _, k in totals]))
            totals[:] = [(codes, total)]

        for batch in _slices(batches):
            numbers = [np.array(_numbered(memo, t.as_py()), np.int64) for t in batch.column(0)]
            memo.settle()
            ok = np.array(memo.ok, np.int8)
            flat = np.concatenate([x for x in numbers if ok[x].all()] or [np.zeros(0, np.int64)])
            now = np.bincount(flat, minlength=len(memo))
            now[: len(seen)] += seen
            seen = now
            if len(memo) > STRETCHES:
                add_up()
                del memo, ok, flat, now
                _forget()
                memo, seen = _memo(job, lambda: Stretches(pair)), np.zeros(0, np.int64)
        if len(memo):
            add_up()
        for codes, total in totals:
            for k in range(0, len(codes), 1 << 16):
                c, n = codes[k : k + (1 << 16)], total[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c >> 32), pa.array(c & 0xFFFFFFFF), pa.array(n)], ["a", "b", "n"])

    found = docs.select(F.col(text)).mapInArrow(_forgetful(count), "a long, b long, n long")
    table = materialise(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "id-pairs")
    highest = table.groupBy("b").agg(F.max("n").alias("highest"))
    return table.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """The alignment of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` lists A's ids, a bar and B's ids of each group, groups parted by semicolons. A link
    is an A and a B token that end together, so a group has one. ``n_best`` counts links whose pair
    is the most frequent of its B id in the corpus (ties included), ``count_sum`` adds the pairs'
    counts. Null and empty texts, and texts whose tokens of A or B don't spell a space and the text,
    have zeros and no groups. Repeated rows count as any other and give a row each; a null doc_id
    stays null; extra columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pairs = materialise(pair_counts(docs, a_file, b_file, text), "best-pairs")
    slices = max(1, -(-pairs.count() // pass_pairs))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if slices == 1:
        return _aligned(rows, pairs, a_file, b_file)
    done = []
    for k in range(slices):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
        done.append(materialise(_aligned(rows, part, a_file, b_file).withColumn("pass", F.lit(k)), "aligned"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    # equal groups have equal counts: rows alike in id and groups share their sums
    key = ["doc_id", "n_a", "n_b", "n_groups", "n_links", F.sha2("groups", 256).alias("digest")]
    once = F.sum(F.when(F.col("pass") == 0, 1))
    sums = every.groupBy(*key).agg(once.alias("copies"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("groups").alias("groups"))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    totals = [F.expr(f"{c} div copies").alias(c) for c in ("n_best", "count_sum")]
    return each.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *totals, "groups")


def _aligned(rows: DataFrame, pairs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows with the counts of the given pairs; these are bounded by the caller."""
    spark = rows.sparkSession
    got = pairs.select(F.expr("shiftleft(a, 32) | b").alias("code"), "n", F.col("best").cast("long").alias("best")).toPandas()
    got = got.sort_values("code")
    shared = spark.sparkContext.broadcast(tuple(got[c].to_numpy(np.int64) for c in ("code", "n", "best")))
    bounded_batches(spark, ROWS)
    job = uuid.uuid4().hex

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = lambda: Stretches(_pair(a_file, b_file), shared.value)
        memo = None
        for batch in _slices(batches):
            if len(_memo(job, make)) > STRETCHES:
                memo = None
                _forget()
            memo = _memo(job, make)
            numbers = [_numbered(memo, t.as_py()) for t in batch.column(1)]
            memo.settle()
            ok, columns = np.array(memo.ok, np.int8), [np.array(x, np.int64) for x in (memo.n_a, memo.n_b, memo.n_groups, memo.n_best, memo.count_sum)]
            sums, groups = [], []
            for x in numbers:
                at = np.array(x, np.int64)
                good = len(at) and ok[at].all()
                sums.append([int(c[at].sum()) for c in columns] if good else [0] * 5)
                groups.append(";".join([memo.text[i] for i in x]) if good else "")
            n_a, n_b, n_groups, n_best, total = np.array(sums, np.int64).reshape(-1, 5).T
            arrays = [batch.column(0), *(pa.array(c) for c in (n_a, n_b, n_groups, n_groups, n_best, total)), pa.array(groups, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _RESULT.split(", ")])

    return rows.mapInArrow(_forgetful(count), _RESULT)
