"""Target-distribution importance resampling: documents whose hashed n-grams look like a target's.

Features are runs of one to three words; a feature's bucket is its CRC-32 modulo the number of
buckets. A CRC can be carried on: the state after ``u v`` follows from that of ``u``, moved over
the bytes of `` v``, and the state of `` v`` alone. So a batch needs the states of its distinct words
alone. Head and tail: the states of frequent words and the states and buckets of frequent pairs are
found once and broadcast; words beyond the head take their CRC directly, and pairs beyond it and all
triples are carried on from their words. Either way a bucket's total is exact.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

BUCKETS = 10_000
#: A word or pair counts for the head where it is at least this share of a batch's words or pairs: a batch names at most 1 / share of each.
HEAD_SHARE = 1 / 4096
#: What is broadcast of the head: the most frequent words and pairs. The tail beyond is worked out with the same results.
HEAD_WORDS, HEAD_PAIRS = 1 << 15, 1 << 17
#: Slots for each pair of the head in the table that finds them.
SPREAD = 8

#: Bytes after A-Z are lower-cased: digits, a-z and all beyond ASCII stay, anything else parts words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@cache
def _over(n: int) -> np.ndarray:
    """Tables [4, 256] that move a CRC over ``n`` zero bytes: xor of one entry for each byte of the state."""
    one = np.array([zlib.crc32(b"\0" * n, v) ^ zlib.crc32(b"\0" * n) for v in (1 << k for k in range(32))], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, (np.arange(256) >> bit & 1) == 1] ^= one[8 * byte + bit]
    return out


def carry(state: np.ndarray, lengths: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """CRC of A followed by B: ``state`` of A, length in bytes and CRC of B."""
    kinds, at = np.unique(lengths, return_inverse=True)
    tables = np.stack([_over(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    out = tail.copy()
    for byte in range(4):
        out ^= tables[at, byte, state >> np.uint32(8 * byte) & np.uint32(255)]
    return out


class Words:
    """The words of an Arrow array of texts: distinct ones, each word's number among them, and words in each text."""

    def __init__(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(_LOWER)
        plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        parts = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        self.names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        index, sizes = coded.indices.to_numpy(), np.diff(parts.offsets.to_numpy())
        empty = self.names.index(b"") if b"" in self.names else -1
        real = index != empty
        text = np.repeat(np.arange(len(sizes)), sizes)[real]
        self.index, self.counts = index[real].astype(np.int64), np.bincount(text, minlength=len(sizes))
        #: Does a word follow in the same text, and do two?
        same = text[1:] == text[:-1]
        self.two, self.three = np.flatnonzero(same), np.flatnonzero(same[:-1] & same[1:])


class Head:
    """Broadcast part: frequent words with their CRC states, frequent pairs with the state after both."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.words = {w: k for k, w in enumerate(words)}
        self.states = np.array([(zlib.crc32(w), zlib.crc32(b" " + w)) for w in words], np.uint32).reshape(-1, 2)
        codes = [self.words[u] << 32 | self.words[v] for u, v in pairs if u in self.words and v in self.words]
        size = 1 << max(4, (SPREAD * len(codes)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.after = np.full(size, -1, np.int64), np.zeros(size, np.uint32)
        names = list(self.words)
        for c in codes:  # of pairs that meet in a slot, one stays; the others are carried on like the tail
            at = int(self.slots(np.array([c]))[0])
            self.keys[at], self.after[at] = c, zlib.crc32(names[c >> 32] + b" " + names[c & 0xFFFFFFFF])

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)


def crcs(words: Words, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC states of all words, pairs and triples, in order."""
    known = np.array([head.words.get(w, -1) for w in words.names], np.int64)
    own, spaced = np.zeros(len(known), np.uint32), np.zeros(len(known), np.uint32)
    is_head = known >= 0
    own[is_head], spaced[is_head] = head.states[known[is_head]].T if len(head.states) else (0, 0)
    for k in np.flatnonzero(~is_head).tolist():  # the tail: direct CRC
        w = words.names[k]
        own[k], spaced[k] = zlib.crc32(w), zlib.crc32(b" " + w)
    lengths = np.array([len(w) + 1 for w in words.names], np.int64)
    i = words.index
    one = own[i] if len(i) else np.zeros(0, np.uint32)
    first, second = i[words.two], i[words.two + 1]
    codes = known[first] << 32 | known[second]
    codes[(known[first] < 0) | (known[second] < 0)] = -2
    at = head.slots(codes)
    hit = head.keys[at] == codes
    two = head.after[at]
    miss = np.flatnonzero(~hit)
    two[miss] = carry(own[first[miss]], lengths[second[miss]], spaced[second[miss]])
    # the pair that begins a triple is the pair at the same place
    at_pair = np.searchsorted(words.two, words.three)
    third = i[words.three + 2]
    return one, two, carry(two[at_pair], lengths[third], spaced[third])


def head_of(texts: DataFrame, text: str = "text") -> Head:
    """The head, from all rows: tasks name what is frequent in each batch of rows, the counts are added and ordered in Spark."""

    def frequent(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            w = Words(batch.column(0))
            n = np.bincount(w.index, minlength=len(w.names))
            words = np.flatnonzero(n >= max(2, len(w.index) * HEAD_SHARE))
            codes, m = np.unique(w.index[w.two] << 32 | w.index[w.two + 1], return_counts=True)
            pairs = np.flatnonzero(m >= max(2, len(w.two) * HEAD_SHARE))
            names = [w.names[k] for k in words.tolist()] + [w.names[c >> 32] + b" " + w.names[c & 0xFFFFFFFF] for c in codes[pairs].tolist()]
            arrays = [pa.array(names, pa.binary()), pa.array(np.arange(len(names)) >= len(words)), pa.array(np.concatenate([n[words], m[pairs]]), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["feature", "pair", "n"])

    bounded_batches(texts.sparkSession)
    found = texts.select(F.col(text)).mapInArrow(frequent, "feature binary, pair boolean, n long")
    totals = found.groupBy("feature", "pair").agg(F.sum("n").alias("n"))
    first = lambda pair, n: [bytes(r[0]) for r in totals.where(F.col("pair") == pair).orderBy(F.desc("n"), "feature").limit(n).collect()]
    return Head(first(False, HEAD_WORDS), [tuple(p.split(b" ")) for p in first(True, HEAD_PAIRS)])


def bucket_totals(texts: DataFrame, head, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """Features of all rows in each bucket: bucket, n. Each task adds up its own before they shuffle. ``head`` is a broadcast :class:`Head`."""

    def add_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for crc in crcs(Words(batch.column(0)), head.value):
                sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    return texts.select(F.col(text)).mapInArrow(add_up, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth, in thousandths of the log ratio of smoothed shares."""
    big_s, big_t, n = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: (t + 1) * (big_s + n) / ((s + 1) * (big_t + n))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, head, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's n_words, n_features and weight (the sum of its features' gains)."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), np.uint32(len(gain))

    def add_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worth = shared.value
        for batch in batches:
            words = Words(batch.column(1))
            n = words.counts
            weight = np.zeros(len(n), np.int64)
            for crc, k in zip(crcs(words, head.value), (1, 2, 3), strict=True):
                each = np.maximum(n - (k - 1), 0)
                sums = np.concatenate([[0], np.cumsum(worth[crc % buckets])])
                ends = np.cumsum(each)
                weight += sums[ends] - sums[ends - each]
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(add_up, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: str = "42", least_words: int = 20, buckets: int = BUCKETS,
             doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents with ``least_words`` words or more, without replacement, by weight plus Gumbel noise.

    Returns every row's doc_id, n_words, n_features, weight, score and rank (1, 2, 3... by falling
    score, ties to the smaller doc_id; null if not drawn). Null and empty texts have no features and
    weight 0. Repeated rows count each and tie; a null doc_id hashes as an empty one and goes
    before all others in ties; extra columns are left out. Empty documents give an empty result; an empty target makes
    all gains follow the documents alone.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(head_of(docs, text))

    def totals(table: DataFrame, name: str) -> np.ndarray:
        got: pd.DataFrame = bucket_totals(table, head, buckets, name).toPandas()  # a row for each bucket at most
        return np.bincount(got["bucket"].to_numpy(np.int64), got["n"].to_numpy(np.float64), buckets).astype(np.int64)

    weighed = weigh(docs, head, gains(totals(docs, text), totals(target, target_text)), doc_id, text)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((draw + 0.5) / 4294967296.0)) * F.lit(-1000.0)).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words)
    # one order over all rows: sorted ranges, each range's rows numbered within, counts of the ranges before added
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id")]
    ranged = materialise(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "scored")
    sizes = ranged.groupBy("part").agg(F.sum(F.col("able").cast("long")).alias("n")).toPandas().sort_values("part")  # a row for each range
    drawn = percent * int(sizes["n"].sum()) // 100
    starts = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))
    reached = [p for p, start in starts.items() if start < drawn]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    first = spark.createDataFrame([(p, int(starts[p])) for p in reached], "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order[1:])).cast("long")
    at = ranged.where("able").join(F.broadcast(first), "part").withColumn("place", F.col("start") + within)
    taken = at.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = ranged.where(~F.col("able") | ~F.col("part").isin(reached)) if reached else ranged
    return taken.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
