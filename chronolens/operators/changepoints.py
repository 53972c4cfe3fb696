"""Change points: all open chunks of all series are split at once, pass by pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ln_factorial
from .series import null_safe_names, placed, same
from .storage import written


def split_scores(df: DataFrame, key: list[str], order: list[str], minlength: int = 5, power: Column | None = None) -> DataFrame:
    """For each chunk (``key``): log odds of a split into two zero-mean Gaussians, the best split, number of splits, n.

    Splits leave ``minlength`` samples on either side; a chunk too short for one has log odds -inf and no best split.
    """
    p = power if power is not None else F.col("re") * F.col("re") + F.col("im") * F.col("im")
    w = Window.partitionBy(*key).orderBy(*order)
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    rows = df.select(*key, *order, p.alias("_p")).select(
        *key, F.row_number().over(w).alias("k"), F.sum("_p").over(run).alias("front"),
        F.count(F.lit(1)).over(whole).alias("n"), F.sum("_p").over(whole).alias("total"),
    )
    m, k = F.col("n") - F.col("k"), F.col("k")
    evidence = lambda n, s: ln_factorial(n - 1) - n * F.log(s)
    score = evidence(k, F.col("front")) + evidence(m, F.col("total") - F.col("front")) - math.log(2)
    ok = (k >= minlength) & (m >= minlength) & (F.col("front") > 0) & (F.col("total") > F.col("front"))
    scored = rows.withColumn("s", F.when(ok, score))
    top = F.max("s").alias("top")
    best = scored.groupBy(*key).agg(top, F.max_by("k", "s").alias("split"), F.count("s").alias("splits"), F.first("n").alias("n"), F.first("total").alias("total"))
    spread = scored.join(best.select(*key, "top"), key).groupBy(*key).agg(F.sum(F.exp(F.col("s") - F.col("top"))).alias("z"))
    single = ln_factorial(F.col("n") - 1) - F.col("n") * F.log("total")
    odds = F.when(F.col("splits") > 0, F.col("top") + F.log("z") - single).otherwise(F.lit(float("-inf")))
    return best.join(spread, key).select(*key, "n", "splits", "split", odds.alias("log_odds"))


def threshold(kind: str | float) -> Column:
    """default: 4.07 + 1.33 log10 n; trials: ln of the number of splits; or a number."""
    if kind == "default":
        return 4.07 + 1.33 * F.log10("n")
    if kind == "trials":
        return F.log("splits")
    return F.lit(float(kind))


def change_points(df: DataFrame, key: list[str], order: list[str], limit: str | float = "default", minlength: int = 5, maxlength: int | None = None, width=None) -> DataFrame:
    """``df`` with chunk (from 0 in time order), chunk_start (place of its first sample) and n (samples).

    A pass scores every open chunk, splits those above the threshold and closes the rest; it ends
    when nothing splits. Passes are written to the shared folder. With ``width`` samples get their places within
    stretches of that width of the first order column, so that no task sorts a whole series. All-zero series are never split.
    """
    base = written(placed(df, key, order[1:], width, "_i", order[0]) if width else df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1), "cp-series")
    open_ = base.select(*key, "_i", F.lit(0).cast("int").alias("_a"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_p"))
    closed, n = None, 0
    while True:
        scores = split_scores(open_, [*key, "_a"], ["_i"], minlength, F.col("_p"))
        cut = scores.select(*key, "_a", F.when(F.col("log_odds") > threshold(limit), F.col("split")).alias("_cut"))
        state = written(open_.join(cut, [*key, "_a"]), f"cp-{n}")
        shut = state.where("_cut is null").select(*key, "_i", "_a")
        closed = shut if closed is None else closed.unionByName(shut)
        open_ = state.where("_cut is not null").select(*key, "_i", F.when(F.col("_i") < F.col("_a") + F.col("_cut"), F.col("_a")).otherwise(F.col("_a") + F.col("_cut")).cast("int").alias("_a"), "_p")
        n += 1
        if open_.isEmpty():
            break
    if maxlength:
        # a chunk longer than maxlength is cut; if the last piece would be below minlength, the cut before it moves back
        size = F.count(F.lit(1)).over(Window.partitionBy(*key, "_a"))
        rel, whole = F.col("_i") - F.col("_a"), F.floor((F.col("_n") - 1) / maxlength)
        last = F.col("_n") - whole * maxlength
        move = F.when((whole > 0) & (last < minlength), minlength - last).otherwise(0)
        piece = F.when(rel >= whole * maxlength - move, whole).otherwise(F.floor(rel / maxlength))
        start = F.when(piece == whole, whole * maxlength - move).otherwise(piece * maxlength)
        closed = closed.withColumn("_n", size).withColumn("_a", F.when(F.col("_n") > maxlength, F.col("_a") + start).otherwise(F.col("_a")).cast("int")).drop("_n")
    labelled = base.join(closed, [*key, "_i"])
    sizes = closed.groupBy(*key, "_a").agg(F.count(F.lit(1)).alias("n"))  # a row for each chunk
    chunks = sizes.withColumn("chunk", F.row_number().over(Window.partitionBy(*key).orderBy("_a")) - 1)
    return labelled.join(chunks, [*key, "_a"]).select(*df.columns, "chunk", F.col("_a").alias("chunk_start"), "n")


def label_chunks(df: DataFrame, starts: DataFrame, key: list[str], order: list[str], width=None) -> DataFrame:
    """Chunk id, start and length for each sample from a table of change points (key, start_idx, ln_ratio).

    Without change points a series is one chunk of ratio -inf. With ``width`` long series are dealt out: places come
    from stretches of that width of the first order column, and chunks meet samples in stretches of places.
    """
    if width is not None:
        return _label_stretches(placed(df, key, order[1:], width, "_i", order[0]), starts, key, df.columns)
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1)
    marked = rows.join(starts.withColumnRenamed("start_idx", "_i"), [*key, "_i"], "left")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ids = marked.withColumn("chunk", F.sum(F.when(F.col("ln_ratio").isNotNull() & (F.col("_i") > 0), 1).otherwise(0)).over(run))
    of = Window.partitionBy(*key, "chunk")
    ratio = F.coalesce(F.max("ln_ratio").over(of), F.lit(float("-inf")))
    return ids.select(*df.columns, "chunk", F.min("_i").over(of).alias("chunk_start"), F.count(F.lit(1)).over(of).alias("n"), ratio.alias("ln_ratio"))


#: Places in a stretch where samples and chunks meet.
STRETCH = 1 << 16


def _label_stretches(rows: DataFrame, starts: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    size = rows.groupBy(*key).agg((F.max("_i") + 1).alias("_n"))
    given = starts.where(F.col("ln_ratio").isNotNull()).select(*key, F.col("start_idx").cast("long").alias("_a"), "ln_ratio")
    nulls = null_safe_names(given, key)
    inner = size.join(nulls, same(size, nulls, key)).where("_a < _n").select(*key, "_a", "ln_ratio", "_n")
    zero = size.select(*key, F.lit(0).cast("long").alias("_a"), F.lit(None).cast("double").alias("ln_ratio"), "_n")  # a series begins with a chunk, stated or not
    chunks = inner.unionByName(zero).groupBy(*key, "_a").agg(F.max("ln_ratio").alias("ln_ratio"), F.max("_n").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_a")  # a row for each chunk
    chunks = chunks.select(*key, "_a", F.coalesce("ln_ratio", F.lit(float("-inf"))).alias("ln_ratio"), F.coalesce(F.lead("_a").over(w), F.col("_n")).alias("_z"), (F.row_number().over(w) - 1).alias("chunk"))
    spread = chunks.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_a") / STRETCH), F.floor((F.col("_z") - 1) / STRETCH))))
    met = null_safe_names(spread, [*key, "_s"])
    held = rows.withColumn("_s", F.floor(F.col("_i") / STRETCH))
    j = held.join(met, same(held, met, [*key, "_s"]) & (F.col("_i") >= F.col("_a")) & (F.col("_i") < F.col("_z")))
    return j.select(*columns, "chunk", F.col("_a").alias("chunk_start"), (F.col("_z") - F.col("_a")).alias("n"), "ln_ratio")


def chunk_variance(df: DataFrame, key: list[str]) -> DataFrame:
    """Sample variance of re and im together (ddof 1, 2n numbers) for each chunk; ``sigma`` given by the user wins."""
    s1, s2, n = F.sum(F.col("re") + F.col("im")), F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 2 * F.count(F.lit(1))
    var = (s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0))
    if "sigma" in df.columns:
        var = F.coalesce(F.avg(F.col("sigma") * F.col("sigma")), var)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), var.alias("var"))
