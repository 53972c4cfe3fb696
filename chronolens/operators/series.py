"""Cleaning and shaping of series: (source, detector, ..., t, re, im)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source", "detector"]


def normalise_series(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Accept (t, re, im[, sigma]) or (t, z struct<re, im>); the schema is checked while planning."""
    if "z" in df.columns:
        df = df.select("*", F.col("z.re").alias("re"), F.col("z.im").alias("im")).drop("z")
    missing = {"t", "re", "im", *key} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    more = [F.col("sigma").cast("double")] if "sigma" in df.columns else []
    return df.select(*key, "t", F.col("re").cast("double"), F.col("im").cast("double"), *more)


def dedupe_times(df: DataFrame, pos: str, key: list[str] = KEY) -> DataFrame:
    """Of repeated times the first in input order stays."""
    w = Window.partitionBy(*key, "t").orderBy(pos)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def crop(df: DataFrame, start, end, dt=None, key: list[str] = KEY) -> DataFrame:
    """start <= t < end; with a regular step dt an unaligned start keeps the sample before it."""
    if dt is None:
        return df.where((F.col("t") >= start) & (F.col("t") < end))
    t0 = F.min("t").over(Window.partitionBy(*key))
    step = F.floor((F.col("t") - t0) / dt)
    first, last = F.floor((F.lit(start) - t0) / dt), F.floor((F.lit(end) - t0) / dt)
    return df.withColumns({"_i": step, "_a": first, "_b": last}).where("_i >= _a and _i < _b").drop("_i", "_a", "_b")


def select_detectors(df: DataFrame, detectors: list[str]) -> DataFrame:
    return df.where(F.col("detector").isin(*detectors))


def drop_detector(df: DataFrame, detector: str) -> DataFrame:
    return df.where(F.col("detector") != detector)


def flag_outliers(df: DataFrame, thresh: float = 3.5, key: list[str] = KEY, parts=("re", "im")) -> DataFrame:
    """Column ``outlier``: a part's modified z-score, 0.6745 |x - median| / MAD, is above thresh.

    Exact medians: one grouped aggregate for medians, one for deviations, joined by key.
    """
    if not thresh > 0:
        raise ValueError("thresh has to be positive")
    med = df.groupBy(*key).agg(*[F.median(p).alias(f"_m_{p}") for p in parts])
    dev = df.join(med, key).select(*key, *[F.abs(F.col(p) - F.col(f"_m_{p}")).alias(f"_d_{p}") for p in parts])
    mad = dev.groupBy(*key).agg(*[F.median(f"_d_{p}").alias(f"_s_{p}") for p in parts])
    both = df.join(med.join(mad, key), key)
    far = F.lit(False)
    for p in parts:
        far = far | F.coalesce(0.6745 * F.abs(F.col(p) - F.col(f"_m_{p}")) / F.nullif(F.col(f"_s_{p}"), F.lit(0.0)) > thresh, F.lit(False))
    return both.select(*df.columns, far.alias("outlier"))


def remove_outliers(df: DataFrame, thresh: float = 3.5, key: list[str] = KEY) -> DataFrame:
    return flag_outliers(df, thresh, key).where(~F.col("outlier")).drop("outlier")


def zero_series(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg((F.max(F.abs("re") + F.abs("im")) == 0).alias("all_zero"))


def time_step(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Smallest difference of successive times; null for a single sample."""
    d = F.col("t") - F.lag("t").over(Window.partitionBy(*key).orderBy("t"))
    return df.select(*key, d.alias("d")).groupBy(*key).agg(F.min("d").alias("dt"))


#: Ticks a second on which fractional times are laid to find their common step.
TICKS = 1_000_000


def fractional(df: DataFrame, column: str = "t") -> bool:
    return df.schema[column].dataType.simpleString() in ("double", "float")


def gcd_step(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Greatest common divisor of the time differences: distinct differences first, then Euclid over the few that are left.

    Whole times give a whole step; fractional ones are laid on microseconds first and give a double.
    """
    real = fractional(df)
    t = F.round(F.col("t") * TICKS).cast("long") if real else F.col("t")
    d = (t - F.lag(t).over(Window.partitionBy(*key).orderBy("t"))).cast("long")
    diffs = df.select(*key, d.alias("d")).where("d > 0").distinct()

    def euclid(a: Column, b: Column) -> Column:
        pair = F.struct(a.alias("a"), b.alias("b"))
        steps = F.sequence(F.lit(1), F.lit(92))  # Fibonacci bound for longs
        return F.aggregate(
            steps, pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.when(p["b"] == 0, F.lit(1)).otherwise(p["b"])).alias("b")))
        )["a"]

    step = F.aggregate(F.collect_set("d"), F.lit(0).cast("long"), lambda acc, x: euclid(acc, x))
    return diffs.groupBy(*key).agg((step / TICKS if real else step).alias("step"))


def placed(df: DataFrame, key: list[str], order: list[str], width, out: str = "place", t: str = "t") -> DataFrame:
    """Column ``out``: place of a row in its series (from 0), ordered by time and then ``order``; no task sorts a whole series.

    Rows are numbered within stretches of time of ``width``, and the counts of the stretches before are added.
    """
    rows = df.withColumn("_b", F.floor(F.col(t) / width))
    sizes = rows.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = null_safe_names(sizes.select(*key, "_b", F.coalesce(before, F.lit(0)).alias("_start")), [*key, "_b"])
    within = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(t, *order)) - 1
    numbered = rows.withColumn("_i", within)
    return numbered.join(starts, same(numbered, starts, [*key, "_b"]), "left").withColumn(out, (F.col("_i") + F.col("_start")).cast("long")).select(*df.columns, out)


def null_safe_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Key columns renamed for a join on equal or both null keys."""
    return df.select(*[F.col(n).alias(f"_k_{n}") if n in names else F.col(n) for n in df.columns])


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[f"_k_{n}"])
    return out


def contiguous_runs(df: DataFrame, gap, key: list[str] = KEY, t: str = "t", near: float | None = None, width=None) -> DataFrame:
    """Column ``run``: number of the run; a new one where the difference to the time before exceeds ``gap``.

    With ``near`` the difference has to be ``gap`` within that share of it; 0 asks for equality, as
    stored series do. With ``width`` long series are worked on in stretches of time of that width
    (column ``bucket``, which stays): each finds its own breaks, and the last time before a stretch and the breaks up
    to it come from a table of one row a stretch.
    """
    follows = lambda step: step <= gap if near is None else F.abs(step - gap) <= near * gap
    if width is None:
        w = Window.partitionBy(*key).orderBy(t)
        new = F.when(follows(F.col(t) - F.lag(t).over(w)), 0).otherwise(1)
        return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rows = df.withColumn("bucket", F.floor(F.col(t) / width))
    w = Window.partitionBy(*key, "bucket").orderBy(t)
    before = F.lag(t).over(w)
    new = rows.withColumn("_new", F.when(before.isNull() | follows(F.col(t) - before), 0).otherwise(1))
    new = new.withColumn("_within", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    ends = new.groupBy(*key, "bucket").agg(F.min(t).alias("_a"), F.max(t).alias("_z"), F.max("_within").alias("_n"))
    of = Window.partitionBy(*key).orderBy("bucket")
    joint = F.when(follows(F.col("_a") - F.lag("_z").over(of)), 0).otherwise(1)
    upto = ends.withColumn("_joint", joint).withColumn("_total", F.sum(F.col("_joint") + F.col("_n")).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    starts = null_safe_names(upto.select(*key, "bucket", (F.col("_total") - F.col("_n")).alias("_start")), [*key, "bucket"])
    return new.join(starts, same(new, starts, [*key, "bucket"]), "left").withColumn("run", F.col("_start") + F.col("_within")).select(*df.columns, "bucket", "run")


def run_bounds(df: DataFrame, gap, key: list[str] = KEY, t: str = "t") -> DataFrame:
    """First and last time and size of each run."""
    return contiguous_runs(df, gap, key, t).groupBy(*key, "run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"))


def run_segments(df: DataFrame, dt, key: list[str] = KEY, t: str = "t") -> DataFrame:
    """(start, end) of the runs in which times follow by dt within 1e-5 of it, widened by half a step at both ends."""
    runs = contiguous_runs(df, dt, key, t, near=1e-5).groupBy(*key, "run")
    return runs.agg((F.min(t) - dt / 2).alias("start"), (F.max(t) + dt / 2).alias("end"), F.count(F.lit(1)).alias("n"))


def running_median(df: DataFrame, window: int = 30, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Columns med_re, med_im: medians of ``window`` samples from -window//2 on; the upper one for an even window.

    Edges are mirrored without repeating the edge sample (series shorter than the window reflect
    as far as they reach); gaps are ignored; window 0 gives zeros; 1 or less otherwise is an error.
    """
    if window == 0:
        return df.withColumns({"med_re": F.lit(0.0), "med_im": F.lit(0.0)})
    if not isinstance(window, int) or window < 2:
        raise ValueError("window has to be a whole number above 1, or 0")
    order, half = order or ["t"], window // 2
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    # a row stands at its own place and, near an edge, at its mirrored one
    front, back = -F.col("_i"), 2 * (F.col("_n") - 1) - F.col("_i")
    places = F.filter(
        F.array(F.col("_i"), F.when((F.col("_i") > 0) & (F.col("_i") <= half), front), F.when((back > F.col("_n") - 1) & (back < F.col("_n") + window - half - 1), back)),
        lambda p: p.isNotNull(),
    )
    wide = rows.withColumn("_p", F.explode(places))
    frame = Window.partitionBy(*key).orderBy("_p").rowsBetween(-half, window - 1 - half)
    upper = lambda c: F.get(F.sort_array(F.collect_list(c).over(frame)), F.floor(F.count(F.lit(1)).over(frame) / 2).cast("int"))
    out = wide.withColumns({"med_re": upper("re"), "med_im": upper("im")})
    return out.where("_p = _i").drop("_i", "_n", "_p")


def subtract_running_median(df: DataFrame, window: int = 30, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    out = running_median(df, window, key, order)
    return out.withColumns({"re": F.col("re") - F.col("med_re"), "im": F.col("im") - F.col("med_im")}).drop("med_re", "med_im")


def zero_pad(df: DataFrame, step=None, key: list[str] = KEY) -> DataFrame:
    """Even grid from first to last time; absent samples are zero, with null in other columns.

    Without ``step`` each series has its own, from gcd_step (one sample: 1). Times are whole or
    double; on doubles a step is any positive number, and times may lie a thousandth of it off the
    grid. A time further off is an error: its sample would be lost. Each row makes the samples
    absent before the next one, so the series shuffles once and is joined with nothing.
    """
    real = fractional(df)
    if step is not None and (step <= 0 or not real and step != int(step)):
        raise ValueError("the step has to be positive, and whole for whole times")
    rows = df
    if step is None:
        own = null_safe_names(gcd_step(df, key), key)
        rows = df.join(own, same(df, own, key), "left").withColumn("_d", F.coalesce("step", F.lit(1))).select(*df.columns, "_d")
    else:
        rows = df.withColumn("_d", F.lit(float(step) if real else int(step)))
    w = Window.partitionBy(*key).orderBy("t")
    hops = (F.lead("t").over(w) - F.col("t")) / F.col("_d")
    off = F.abs(hops - F.round(hops)) > (1e-3 if real else 1e-9)
    n = F.when(off, F.raise_error(F.lit("a time lies off the grid")).cast("long")).otherwise(F.greatest(F.coalesce(F.round(hops).cast("long"), F.lit(1)), F.lit(1)))
    spread = rows.withColumn("_n", n).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    t = (F.col("t") + F.col("_j") * F.col("_d")).cast(df.schema["t"].dataType)
    value = lambda c: F.when(F.col("_j") == 0, F.coalesce(c, F.lit(0.0)) if c in ("re", "im") else F.col(c)).otherwise(F.lit(0.0) if c in ("re", "im") else F.lit(None))
    return spread.select(*[F.col(c) if c in key else t.alias("t") if c == "t" else value(c).alias(c) for c in df.columns])


def add_template(df: DataFrame, template: DataFrame, ranges: DataFrame | None = None, key: list[str] = KEY) -> DataFrame:
    """Add a model (key, t, t_re, t_im) inside closed time ranges (key, start, end; the whole span by default)."""
    j = df.join(template, [*key, "t"], "left")
    if ranges is not None:
        spans = ranges.groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))  # few for each series
        j = j.join(spans, key, "left")
        inside = F.exists(F.coalesce("_spans", F.array().cast("array<struct<start:double,end:double>>")), lambda s: (F.col("t") >= s["start"]) & (F.col("t") <= s["end"]))
    else:
        inside = F.lit(True)
    add = lambda c: F.when(inside, F.coalesce(f"t_{c}", F.lit(0.0))).otherwise(0.0)
    out = j.withColumns({"add_re": add("re"), "add_im": add("im")})
    return out.withColumns({"re": F.col("re") + F.col("add_re"), "im": F.col("im") + F.col("add_im")}).select(*df.columns, "add_re", "add_im")


def merge_series(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Union of two series tables; sigma in both or neither, and no overlap of their spans in any series."""
    if ("sigma" in a.columns) != ("sigma" in b.columns):
        raise ValueError("sigma has to be in both or in neither")
    span = lambda d, n: d.groupBy(*key).agg(F.min("t").alias(f"{n}0"), F.max("t").alias(f"{n}1"))
    clash = span(a, "a").join(span(b, "b"), key).where("a0 <= b1 and b0 <= a1")
    if not clash.isEmpty():
        raise ValueError("series overlap in time")
    return a.unionByName(b)


def add_data(multi: DataFrame, df: DataFrame, detector: str) -> DataFrame:
    return multi.unionByName(df.withColumn("detector", F.lit(detector)))


def overlap(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """|Re sum conj(a) b| / |Re sum conj(a) a| of two templates at the same times."""
    j = a.join(b.select(*key, "t", F.col("re").alias("re2"), F.col("im").alias("im2")), [*key, "t"])
    ab, aa = F.sum(F.col("re") * F.col("re2") + F.col("im") * F.col("im2")), F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return j.groupBy(*key).agg(F.abs(ab / aa).alias("overlap"))


def compress_time_segments(df: DataFrame, dt, key: list[str] = KEY) -> DataFrame:
    """(start, end) of the runs in which times follow by exactly dt, as stored series keep them."""
    runs = contiguous_runs(df, dt, key, near=0.0).groupBy(*key, "run")
    return runs.agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"))


def expand_time_segments(segments: DataFrame, dt, key: list[str] = KEY) -> DataFrame:
    """The inverse: each time of each segment, and its place ``i`` in the series."""
    n = F.round((F.col("end") - F.col("start")) / dt).cast("long") + 1
    w = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.withColumn("_n", n).withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    rows = base.select(*key, "start", "_base", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k", "_s"))
    return rows.select(*key, (F.col("start") + F.col("_k") * dt).alias("t"), (F.col("_base") + F.col("_k")).alias("i"))
