"""Exact deduplication by deterministic block naming.

Each text is cut into fixed-size blocks. Distinct blocks are sorted and named by integers;
then adjacent names are paired, distinct pairs are sorted and named, and so on, until a
document has one name. Equal texts, and only those, end with the same (rounds, name).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, text_of

#: Bytes of UTF-8 in a block.
BLOCK_BYTES = 4096
#: A block is hot if it is one in HOT_SHARE of all or more (so no more than that many are) and stands in HOT_ROWS; its rows are
#: dealt by a salt for each 1/PARTS of all blocks that it makes up, SALTS at most (so the salts of all hot blocks are few).
HOT_SHARE, HOT_ROWS, PARTS, SALTS = 100, 200, 200, 64


def packed_blocks(size: int):
    """UDF: UTF-8 bytes -> its blocks, each packed without loss (equal blocks give equal bytes); an empty text has one."""

    @F.pandas_udf("array<binary>")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=False).compress
        for s in texts:
            yield pd.Series([[squeeze(t[i : i + size]) for i in range(0, max(1, len(t)), size)] for t in s])

    return pack


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for distinct keys: each partition sorts its own keys and counts on in its own range of integers."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _salts(blocks: DataFrame) -> Column:
    """Number of salts of a column ``block``: 1 but for hot blocks. Each task counts its own blocks before they shuffle."""
    counts = materialise(blocks.groupBy(F.xxhash64("block").alias("h")).agg(F.count(F.lit(1)).alias("n")), "block-counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    hot = counts.where(F.col("n") >= max(HOT_ROWS, -(-total // HOT_SHARE))).collect()  # HOT_SHARE rows at most
    out = F.lit(1)
    for r in hot:
        out = F.when(F.xxhash64("block") == r["h"], min(SALTS, -(-PARTS * r["n"] // total))).otherwise(out)
    return out


def document_names(docs: DataFrame, key: list[str], text: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each distinct ``key``: key columns, rounds, name and copies (rows that share the key).

    ``key`` has to tell different texts apart; its columns may not be null. Distinct blocks and
    pairs are pre-aggregated by each task before they shuffle. When names are joined back, rows
    of hot blocks are dealt by salts, and tables of pairs are read from files on both sides, so
    that adaptive execution can split their hot partitions.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*key, F.posexplode(packed_blocks(block_bytes)(F.encode(text, "UTF-8"))).alias("pos", "block"))
    names = _named(rows.select("block").distinct(), ["block"])
    salts = _salts(rows)
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*key, "pos"), salts).cast("int"))
    named = dealt.join(salted, ["block", "salt"])
    # pos is known to be dense, so the largest one tells how many rounds a document needs
    current = materialise(
        named.groupBy(*key, "pos").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("copies")), "block-names"
    )
    size = current.groupBy(*key).agg(F.max("pos").alias("last"))
    done = current.join(size.where(F.col("last") == 0).select(*key), key).select(
        *key, F.lit(0).alias("rounds"), "name", "copies"
    )
    open_ = materialise(current.join(size.where(F.col("last") > 0), key), "open-0")
    n = 0
    while not open_.isEmpty():
        n += 1
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = (
            open_.groupBy(*key, half.alias("half"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.max("copies").alias("copies"),
                F.max("last").alias("last"),
            )
            .withColumn("last", F.floor(F.col("last") / 2).cast("int"))
        )
        pairs = materialise(pairs, f"pairs-{n}")
        names = materialise(_named(pairs.select("a", "b").distinct(), ["a", "b"]), f"pair-names-{n}")
        after = materialise(
            pairs.join(names.hint("merge"), ["a", "b"]).select(*key, F.col("half").alias("pos"), "name", "copies", "last"), f"open-{n}"
        )
        done = done.unionByName(after.where("last = 0").select(*key, F.lit(n).alias("rounds"), "name", "copies"))
        open_ = after.where("last > 0")
    return done


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays (null ids
    only if the group has no other); of repeated rows with that id, one stays. Extra columns
    are not carried; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("id0"),
        F.col("doc_id").isNull().alias("no_id"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        "text",
    )
    key = ["id0", "no_id", "text_sha256"]
    named = materialise(document_names(rows, key, F.col("text"), block_bytes), "document-names")
    groups = named.groupBy("rounds", "name").agg(
        F.max(F.when(~F.col("no_id"), F.col("id0"))).alias("keep_id"), F.sum("copies").alias("group_size")
    )
    groups = materialise(groups, "groups-of-copies")
    each = named.join(groups.hint("merge"), ["rounds", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    own = F.when(~F.col("no_id"), F.col("id0"))
    return each.select(
        own.alias("doc_id"), "keep_id", "group_size",
        (own.eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )
