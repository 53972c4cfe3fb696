"""Line deduplication with two Bloom filters.

Line keys are hashed; one filter holds hashes seen once, the other those seen twice. Both are
built in shards of the bit space from hashes alone. Only lines that pass the twice-seen filter
shuffle as text, for exact counts and the choice of the first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, bounded_batches, materialise, text_of

#: Bits of a filter for each line, and the largest filter (256 MB, 134 million lines at full size): beyond it more
#: lines are suspected and shuffle, with the same result.
BITS_PER_LINE, MAX_BITS = 16, 1 << 31
#: Bits that a hash sets; bits of a filter's shard, at most, and its shards, at least.
PROBES, SHARD_BITS, SHARDS = 4, 1 << 21, 256
#: Hashes of confirmed lines that are broadcast, at most (32 MB); beyond that rows with a suspected line are joined.
BROADCAST_LINES = 4_000_000


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _shards(bits: int) -> int:
    return max(SHARDS, bits // SHARD_BITS)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """[n, PROBES] positions in a filter of ``bits`` (a power of two), all in the same shard of it."""
    h = h.astype(np.uint64)
    shard_bits = np.uint64(bits // _shards(bits))
    step = (h >> np.uint64(40)) | np.uint64(1)
    within = (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % shard_bits
    return _shard(h, bits)[:, None] * shard_bits + within


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    """The shard of hashes, by their highest bits."""
    return h >> np.uint64(64 - (_shards(bits).bit_length() - 1))


def twice_seen(hashes: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter as packed bits, from a column ``hashes`` of longs arrays, each distinct within its row."""
    shards = _shards(bits)

    def by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [np.asarray(x, np.int64) for x in pdf["hashes"] if len(x)]
            if not lists:
                continue
            h = np.concatenate(lists).astype(np.uint64)
            h = np.sort(h)
            h = h[np.concatenate([[True, True], h[2:] != h[:-2]])[: len(h)]]  # once and twice is all that matters: a line of every document sends two hashes a batch
            cut = np.searchsorted(_shard(h, bits), np.arange(shards + 1, dtype=np.uint64))
            some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            yield pd.DataFrame({"shard": some, "blob": [h[cut[s] : cut[s + 1]].tobytes() for s in some]})

    def build(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hashes one batch after the other: bits new to the once-seen filter go there, hashes that it has go to the other."""
        size = bits // shards
        once, twice, shard = np.zeros(size, bool), np.zeros(size, bool), int(key[0])
        for pdf in batches:
            for blob in pdf["blob"]:
                h, n = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
                at = (_places(h, bits) - np.uint64(shard * size)).astype(np.int64)
                seen = once[at].all(axis=1) | (n > 1)
                twice[at[seen].ravel()] = True
                once[at.ravel()] = True
        yield pd.DataFrame({"shard": [shard], "blob": [np.packbits(twice, bitorder="little").tobytes()]})

    parts = (
        hashes.mapInPandas(by_shard, "shard int, blob binary")
        .groupBy("shard")
        .applyInPandas(build, "shard int, blob binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        size = bits // 8 // shards
        out[r["shard"] * size : (r["shard"] + 1) * size] = np.frombuffer(r["blob"], np.uint8)
    return out


def _found(hashes: pd.Series, test) -> pd.Series:
    """For each row's hashes the indexes of those that pass ``test``."""
    lists = [np.asarray(x, np.int64) for x in hashes]
    size = np.array([len(x) for x in lists], np.int64)
    yes = test(np.concatenate(lists).astype(np.uint64)) if size.sum() else np.zeros(0, bool)
    return pd.Series([np.flatnonzero(yes[e - n : e]).astype(np.int32) for n, e in zip(size, np.cumsum(size), strict=True)], dtype=object)


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` rows lose their
    lines in every row; with ``keep_first`` the first line of the row with the smallest doc_id
    stays. A null or empty text is one empty line. Each row is a document, so repeated rows
    count; rows that share a doc_id (null included) lose the same keys. Extra columns are not
    carried.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    lines = F.split("text", "\n", -1)
    keys = F.filter(F.array_distinct(F.transform(lines, line_key)), lambda k: F.char_length(k) >= min_chars)
    keyed = rows.select("doc_id", "text", keys.alias("keys")).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    total = rows.select(F.size(lines).alias("n")).agg(F.sum("n")).first()[0] or 1
    bits = 1 << 20
    while bits < min(MAX_BITS, total * BITS_PER_LINE):
        bits *= 2
    shared = spark.sparkContext.broadcast(twice_seen(keyed.select("hashes"), bits).tobytes())

    def in_filter(h: np.ndarray) -> np.ndarray:
        at = _places(h, bits)
        return ((np.frombuffer(shared.value, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    @F.pandas_udf("array<int>")
    def suspected(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in hashes:
            yield _found(s, in_filter)

    named = keyed.select("doc_id", "keys", suspected("hashes").alias("at")).where(F.size("at") > 0)
    named = named.select("doc_id", F.explode(F.transform("at", lambda i: F.get("keys", i))).alias("key"))
    suspects = materialise(named, "suspected-lines")
    counted = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    counted = materialise(counted.select("key", "first_id", (F.col("n") >= min_docs).alias("common"), F.xxhash64("key").alias("h")), "counted-lines")
    common = counted.where("common")
    n_common = common.count()
    # a line whose hash is a confirmed one's is suspected too, so a collision shows among the suspected keys
    hashed_apart = common.select("h").join(counted.select("h"), "h").count() == n_common
    if keep_first or n_common > BROADCAST_LINES or not hashed_apart:
        return _by_join(keyed, lines, suspects, common, suspected, keep_first)
    known = np.sort(common.select("h").toArrow()["h"].to_numpy().astype(np.uint64))  # at most BROADCAST_LINES
    confirmed = spark.sparkContext.broadcast(known.tobytes())

    def in_list(h: np.ndarray) -> np.ndarray:
        have = np.frombuffer(confirmed.value, np.uint64)
        return have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h if len(have) else np.zeros(len(h), bool)

    @F.pandas_udf("array<int>")
    def bad_at(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in hashes:
            yield _found(s, in_list)

    marked = keyed.select("doc_id", "text", "keys", bad_at("hashes").alias("at")).withColumn("bad", F.transform("at", lambda i: F.get("keys", i)))
    kept = F.when(F.size("bad") > 0, F.filter(lines, lambda x: ~F.array_contains("bad", line_key(x))))
    out = marked.select("doc_id", "text", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(
        "doc_id", "n_lines", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("kept", "\n"), "text").alias("kept_text"),
    )


def _by_join(keyed: DataFrame, lines: Column, suspects: DataFrame, common: DataFrame, suspected, keep_first: bool) -> DataFrame:
    """The same by joins, for any number of confirmed lines: only rows with a suspected line shuffle.

    Both sides of the join on a line's key are read from files, so that adaptive execution can split a very common line.
    """
    hits = suspects.join(common.hint("merge"), "key")
    drops = hits.groupBy("doc_id").agg(
        F.collect_set("key").alias("bad"), F.collect_set(F.when(F.col("doc_id") == F.col("first_id"), F.col("key"))).alias("own")
    )
    drops = drops.select(F.col("doc_id").alias("drop_id"), "bad", "own")
    rows = keyed.select("doc_id", "text", (F.size(suspected("hashes")) > 0).alias("suspect"))
    out = ["doc_id", F.size(lines).cast("long").alias("n_lines")]
    clean = rows.where(~F.col("suspect")).select(*out, F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    joined = rows.where("suspect").join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), line_key(line).alias("k"), i.alias("i")))
    stays = lambda x: ~F.array_contains("bad", x["k"])
    if keep_first:
        first = lambda x: F.array_contains("own", x["k"]) & (F.array_position(F.transform(lines, line_key), x["k"]) == x["i"] + 1)
        kept = F.filter(numbered, lambda x: stays(x) | first(x))
    else:
        kept = F.filter(numbered, stays)
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.transform(kept, lambda x: x["line"]))
    some = joined.select(*out, kept.alias("kept"))
    some = some.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    return clean.unionByName(some)
