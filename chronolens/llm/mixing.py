"""Mixing sources to target weights.

Each source's words are packed into fixed-length blocks. A source's slots in the mix are dealt
to output shards at random, all sources alike, so that a shard's counts by source are
multinomial given its size while the sources' totals meet their targets. A slot's number is
mapped through its source's pseudorandom permutation to a block, anew for each pass over the
source, and blocks join the documents by index.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import fresh, materialise, shared_dir

#: Weights of the sources in code point order, repeating; a source is taken at most MAX_PASSES times.
WEIGHTS, MAX_PASSES = (5, 2, 1), 3
#: Words of a block; slots of an output shard on average; slots that one task's row deals out, about.
BLOCK_WORDS, SHARD_SLOTS, DEALT_SLOTS = 32, 65_536, 262_144
#: Rows of a source that are summed together, about; such sums that are summed together.
BUCKET_ROWS, GROUP = 256, 1024
#: The plan has a row for each source; up to so many it is broadcast, beyond that joined.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sizes: list[int], weights=WEIGHTS, most: int = MAX_PASSES) -> list[float]:
    """Share out the sum of sizes by weight; a target stops at ``most`` times its size, the excess is reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``x``: four Feistel rounds, walked on while outside."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask, out = np.uint64((1 << half) - 1), x.astype(np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            k = np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            m = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((m ^ (m >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def shares(n: int, shards: int, seed: tuple[int, ...], low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(shard, first, count) of the shards low..high-1 that get any of n slots, each slot's shard drawn evenly from all.

    Halves are dealt by binomial draws that depend on the seed and the half alone, so any range of
    shards is worked out without the others; slots are numbered by shard.
    """
    high = shards if high is None else high
    todo = [(0, shards, 0, n)]
    while todo:
        a, b, first, count = todo.pop()
        if not count or b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, count
            continue
        m = (a + b) // 2
        left = int(np.random.default_rng([*seed, a, b]).binomial(count, (m - a) / (b - a)))
        todo += [(m, b, first + left, count - left), (a, m, first, left)]


def source_plan(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(sid, source, rows, source_size, target, blocks, slots) from (source, rows, n): targets and slots of each source.

    The sources without the capped ones share what is left by weight: sources in order of size over
    weight are capped as long as the share of the rest would exceed MAX_PASSES times their size.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("sid", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("w", F.get(weights, F.col("sid") % len(WEIGHTS))).withColumn("r", F.col("n") / F.col("w"))
    before = Window.orderBy("r", "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    gone, used = F.coalesce(F.sum("n").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("n").over(whole) - MAX_PASSES * gone) / (F.sum("w").over(whole) - used)
    levels = ranked.select("r", "sid", level.alias("level")).where(F.col("level") <= MAX_PASSES * F.col("r"))
    level = levels.agg(F.min_by("level", F.struct("r", "sid")).alias("level"))
    target = F.least(MAX_PASSES * F.col("n").cast("double"), F.col("level") * F.col("w"))
    out = ranked.crossJoin(F.broadcast(level)).withColumn("target", target)  # one row
    n, blocks = F.col("n"), F.ceil(F.col("n") / block_words)
    passes = F.when(n > 0, F.least(F.floor(F.col("target") / n), F.lit(MAX_PASSES))).otherwise(0)
    rest = F.when(passes < MAX_PASSES, F.least(blocks, F.round((F.col("target") - passes * n) / block_words))).otherwise(0)
    slots = F.when(n > 0, passes * blocks + rest).otherwise(0)
    return out.select("sid", "source", "rows", n.alias("source_size"), "target", blocks.cast("long").alias("blocks"), slots.cast("long").alias("slots"))


def slot_blocks(plan: DataFrame, seed: int) -> DataFrame:
    """(shard, slot, sid, block, turn): the block that each slot of the mix takes, and in which pass over its source."""
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_SLOTS))
    step = F.least(F.lit(shards), F.ceil(F.lit(float(shards)) * DEALT_SLOTS / F.col("slots"))).cast("long")
    ranges = plan.where("slots > 0").select("sid", "blocks", "slots", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"), step)).alias("low"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, blocks, slots, step, low in zip(*(pdf[c].tolist() for c in ("sid", "blocks", "slots", "step", "low")), strict=True):
                for shard, first, count in shares(slots, shards, (seed, sid), low, min(low + step, shards)):
                    slot = np.arange(first, first + count)
                    turns = slot // blocks
                    for turn in range(int(turns[0]), int(turns[-1]) + 1):
                        own = slot[turns == turn]
                        block = permuted(own % blocks, blocks, seed * 1_000_003 + sid * 31 + turn)
                        yield pd.DataFrame({"shard": np.int64(shard), "slot": own, "sid": np.int32(sid), "block": block, "turn": np.int32(turn)})

    n_parts = max(1, math.ceil(total / DEALT_SLOTS))
    return ranges.repartition(min(4 * n_parts, 20_000), "sid", "low").mapInPandas(take, "shard long, slot long, sid int, block long, turn int")


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, key: Column, seed: int, block_words: int):
    """(rows with their place in their source, blocks that the mix takes). ``key``: a hash that orders the rows of a source."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("h"))
    rows = materialise(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("n"))
    plan = materialise(source_plan(sizes, block_words), "mix-plan")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS))
    counts = plan.select(F.col("source").alias("plan_source"), "sid", "source_size", "target", buckets.alias("buckets"))
    n_sources = plan.count()
    keyed = rows.join(F.broadcast(counts) if n_sources <= BROADCAST_SOURCES else counts, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    keyed = keyed.withColumn("bucket", F.pmod("h", "buckets")).drop("buckets")
    # places: a row in its bucket, a bucket among GROUP others, such a group in its source: no window holds a whole source
    before = lambda *c: Window.partitionBy(*c[:-1]).orderBy(c[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("sum")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = sums.groupBy("sid", "group").agg(F.sum("sum").alias("all"))
    groups = groups.select("sid", "group", F.coalesce(F.sum("all").over(before("sid", "group")), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("sum").over(before("sid", "group", "bucket")), F.lit(0))
    base = sums.withColumn("near", near).join(groups, ["sid", "group"]).select("sid", "bucket", (F.col("far") + F.col("near")).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("own", F.sum("size").over(within) - F.col("size")).join(base, ["sid", "bucket"])
    placed = placed.select("doc_id", "sid", "size", "h", "source_size", "target", (F.col("base") + F.col("own")).alias("start"))
    return placed, slot_blocks(plan, seed)


def _covered(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document with words has words in: block, words, from (the first of them in the document)."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    at = F.greatest(F.col("block") * block_words, "start")
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    return rows.withColumn("words", end - at).withColumn("from", at - F.col("start"))


def mixed_blocks(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS,
                 doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as blocks: (shard, slot, sid, turn, doc_id, from, words).

    Slot ``slot`` of source ``sid`` (its place in code point order) lies in output shard ``shard`` and
    holds ``words`` words of the document from its word ``from`` on, in pass ``turn`` over the source.
    """
    placed, taken = _plan(docs, doc_id, text, source, F.xxhash64(F.col(doc_id), F.col(text)), seed, block_words)
    return _covered(placed, block_words).join(taken.hint("merge"), ["sid", "block"]).select("shard", "slot", "sid", "turn", "doc_id", "from", "words")


def write_mix(taken: DataFrame, path: str | None = None) -> str:
    """Write the slots of the mix as output shards and return the folder: rows of (shard, slot, sid, block, turn) in order of shard, source and slot.

    A file holds the slots of neighbouring shards whole. A shard's words follow by joining its blocks (sid, block) with the documents' places.
    """
    spark = taken.sparkSession
    path = path or f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    taken.repartitionByRange(parts, "shard", "sid").sortWithinPartitions("shard", "sid", "slot").write.parquet(path)
    return path


def read_mix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard long, slot long, sid int, block long, turn int").parquet(path)


def mix_sources(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    Sources in code point order, a null source last, weigh 5, 2, 1 and so on. Null and empty
    texts have size 0 and nothing is taken of them. Repeated rows are rows of their own. No
    word is taken more often than MAX_PASSES times; the same rows give the same result again.
    """
    placed, taken = _plan(docs, doc_id, text, source, F.xxhash64(F.col(doc_id), F.col(text)), seed, block_words)
    key = ["doc_id", "h", "start", "size", "source_size", "target", "sid"]
    taken = read_mix(docs.sparkSession, write_mix(taken))  # what a document gives is counted in the written shards
    # taken blocks grow with the input, so they are never broadcast
    times = taken.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    each = _covered(placed, block_words).join(times.hint("merge"), ["sid", "block"], "left")
    got = each.groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return got.select(*out).unionByName(none.select(*out))


def mixed_documents(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS,
                    doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each pass that takes words of a document.

    A pass that takes all blocks of a document keeps its text as it is; otherwise the text is
    the taken blocks' words joined by spaces, and ``n_chars``, if there, is counted anew. Rows
    without words are in no mix. Repeated rows take part each; rows of one id and text that
    differ elsewhere, such as in the source, stay apart.
    """
    own = fresh(docs, "mix_own")
    value = lambda f: F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`")))
    marks = F.xxhash64(*[F.struct(F.col(f"`{f.name}`").isNull(), value(f)) for f in docs.schema.fields])
    placed, taken = _plan(docs, doc_id, text, source, marks, seed, block_words)
    got = _covered(placed, block_words).join(taken.hint("merge"), ["sid", "block"]).groupBy("sid", "doc_id", "h", "start", "size", "turn").agg(
        F.sum("words").alias("mix_taken"), F.sort_array(F.collect_list(F.struct("from", "words"))).alias("mix_spans")
    )
    # rows that are alike in all columns share a hash, and the places of all of them
    parts = F.collect_list(F.struct("start", "turn", "size", "mix_taken", "mix_spans"))
    first = got.groupBy(F.col("doc_id").alias("mix_id"), F.col("h").alias("mix_h")).agg(parts.alias("mix_all"))
    distinct = docs.withColumn(own, marks)
    if not placed.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        distinct = distinct.dropDuplicates([doc_id, own])
    joined = distinct.join(first, F.col(doc_id).eqNullSafe(F.col("mix_id")) & (F.col(own) == F.col("mix_h")))
    each = joined.withColumn("mix_one", F.explode("mix_all"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    spans, total, size = F.col("mix_one.mix_spans"), F.col("mix_one.mix_taken"), F.col("mix_one.size")
    # the words are bound by an outer transform, so that a text is split once and not for each span
    chosen = F.transform(
        F.array(words), lambda ws: F.flatten(F.transform(spans, lambda s: F.slice(ws, (s["from"] + 1).cast("int"), s["words"].cast("int"))))
    )[0]
    new = F.when(total == size, F.col(text)).otherwise(F.array_join(chosen, " "))
    out = each.withColumn(text, new)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(F.col(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
