"""Posterior tables: odds, intervals, limits, comparisons, catalogue joins and sorting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ellipticity_to_q22, h0_spindown, h0_to_ellipticity, hash_uniform, log_add


def credible_interval(samples: DataFrame, key: list[str], value: str, low: float, high: float) -> DataFrame:
    """Linear-interpolated quantiles."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return samples.groupBy(*key).agg(q.alias("_q")).select(*key, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def upper_limit(samples: DataFrame, key: list[str], value: str, q: float = 0.95) -> DataFrame:
    if not 0 < q <= 1:
        raise ValueError("q has to be in (0, 1]")
    return samples.groupBy(*key).agg(F.percentile(value, F.lit(q)).alias("limit"))


def quantile_sketch(samples: DataFrame, key: list[str], value: str, k: int = 800) -> DataFrame:
    """(key, sketch): a mergeable quantile sketch of bounded size; partial sketches of tasks are merged, no group is held in one place.

    The rank of a quantile read from it is off by about 2.3 / k^0.9 of all draws at most (0.6 % for 800) in 99 of 100 cases.
    """
    return samples.groupBy(*key).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketched_interval(sketches: DataFrame, low: float, high: float) -> DataFrame:
    """The interval's ends as draws of about those ranks."""
    keys = [c for c in sketches.columns if c != "sketch"]
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    return sketches.select(*keys, at(low).alias("low"), at(high).alias("high"))


def best_sample(samples: DataFrame, key: list[str], score: Column, tie: list[str]) -> DataFrame:
    """The row with the largest score; of ties the smallest by ``tie``. Aggregated, so hot sources pre-combine."""
    rank = F.struct(score.alias("s"), *[(-F.col(t)).alias(t) for t in tie])
    best = samples.groupBy(*key).agg(F.max_by(F.struct(*[c for c in samples.columns if c not in key]), rank).alias("_b"))
    return best.select(*key, "_b.*")


def odds(evidence: DataFrame, kind: str = "svn", base: str = "ln", compat: bool = False, joint: tuple[str, ...] = ("joint", "coherent")) -> DataFrame:
    """evidence: (source, dets, n_dets, ln_z, ln_z_noise). svn: ln Z - ln Z_noise by (source, dets).

    cvi: joint ln Z against the sum over detectors of log-added ln Z and noise; null without a joint
    row. compat: the log-addition is done on base-10 values, as an older tool did.
    """
    scale = F.lit(1.0 if base == "ln" else 1 / math.log(10))
    if kind == "svn":
        return evidence.select("source", "dets", ((F.col("ln_z") - F.col("ln_z_noise")) * scale).alias("odds"))
    is_joint = (F.col("n_dets") > 1) | F.col("dets").isin(*joint)
    each = log_add("ln_z", "ln_z_noise")
    if compat:
        each = log_add(F.col("ln_z") / math.log(10), F.col("ln_z_noise") / math.log(10)) * math.log(10)
    top = F.max(F.when(is_joint, F.col("ln_z")))
    return evidence.groupBy("source").agg(((top - F.sum(F.when(~is_joint, each))) * scale).alias("odds"))


def posterior_summary(samples: DataFrame, key: list[str], value: str, score: str, low: float = 0.05, high: float = 0.95, ddof: int = 1) -> DataFrame:
    """Mean, deviation, median, central interval and the value at the best score (the smallest of ties)."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    out = samples.groupBy(*key).agg(
        F.avg(value).alias("mean"), (F.stddev_samp if ddof else F.stddev_pop)(value).alias("std"), q.alias("_q"),
        F.max_by(value, F.struct(F.col(score), -F.col(value))).alias("best"),
    )
    return out.select(*key, "mean", "std", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"), "best")


def credible_levels(samples: DataFrame, truth: DataFrame, key: list[str], value: str) -> DataFrame:
    """Fraction of draws below the true value for each injection; truth: (key, truth)."""
    return samples.join(truth, key).groupBy(*key).agg(F.avg((F.col(value) < F.col("truth")).cast("double")).alias("level"))


def pp_table(levels: DataFrame, by: list[str]) -> DataFrame:
    """Sorted levels against ranks, with the Kolmogorov-Smirnov distance of each parameter."""
    w = Window.partitionBy(*by)
    rows = levels.withColumn("cdf", F.cume_dist().over(w.orderBy("level")))
    n = F.count(F.lit(1)).over(w)
    gap = F.greatest(F.abs(F.col("cdf") - F.col("level")), F.abs(F.col("cdf") - 1 / n - F.col("level")))
    return rows.withColumn("ks", F.max(gap).over(w))


def merge_posteriors(samples: DataFrame, evidence: DataFrame, key: list[str], run: str, draw: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(draws kept, merged evidence). A run's draws stay with probability exp(ln_z - largest ln_z); evidence: ln of the mean."""
    top = evidence.groupBy(*key).agg(F.max("ln_z").alias("_top"), F.count(F.lit(1)).alias("_n"))
    w = evidence.join(top, key).withColumn("_w", F.exp(F.col("ln_z") - F.col("_top")))
    kept = samples.join(w.select(*key, run, "_w"), [*key, run]).where(hash_uniform(draw, seed) < F.col("_w")).drop("_w")
    merged = w.groupBy(*key, "_top", "_n").agg(F.sum("_w").alias("_s")).select(*key, (F.col("_top") + F.log("_s") - F.log("_n")).alias("ln_z"))
    return kept, merged


def compare_samples(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two-sample K-S distance and its asymptotic p by key: running counts over the union, ties together.

    A key with draws on one side only has no row.
    """
    both = a.select(*key, F.col(value).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*key, F.col(value).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy(*key, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*key)
    run = w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select(*key, F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"), F.sum("a").over(w).alias("na"), F.sum("b").over(w).alias("nb")).where("na > 0 and nb > 0")
    out = rows.groupBy(*key).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    lam = F.col("ks") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return out.select(*key, "ks", p.alias("p"))


def fisher_combined(p: DataFrame, key: list[str]) -> DataFrame:
    """Fisher's combined p-value: chi-square survival of even degrees of freedom in closed form."""
    s = p.groupBy(*key).agg((-F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("_h"), F.count(F.lit(1)).cast("int").alias("_n"))
    step = lambda acc, k: F.struct((acc["s"] + acc["t"] * F.col("_h") / k).alias("s"), (acc["t"] * F.col("_h") / k).alias("t"))
    total = F.aggregate(
        F.when(F.col("_n") > 1, F.sequence(F.lit(1), F.col("_n") - 1)).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), step
    )["s"]
    return s.select(*key, (F.exp(-F.col("_h")) * total).alias("p"))


def jensen_shannon(p: DataFrame, key: list[str]) -> DataFrame:
    """Divergence (nats) of two densities on the same points, columns p and q, each normalised to sum one first."""
    sums = p.groupBy(*key).agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    j = p.join(sums, key).select(*key, (F.col("p") / F.col("_p")).alias("p"), (F.col("q") / F.col("_q")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return j.groupBy(*key).agg(F.sum((part("p") + part("q")) / 2).alias("js"))


def limits_table(samples: DataFrame, sources: DataFrame, q: float = 0.95, value: str = "h0") -> DataFrame:
    """One row for each source; for each detector set the q-quantile and the derived ellipticity, quadrupole and spin-down ratio.

    samples: (source, dets, value); sources: (source, f0, f1, dist). Without a source row the derived columns are null.
    """
    lim = upper_limit(samples, ["source", "dets"], value, q).join(sources, "source", "left")
    ell = h0_to_ellipticity("limit", "f0", "dist")
    lim = lim.withColumns({"ellipticity": ell, "q22": ellipticity_to_q22(ell), "sdratio": F.col("limit") / h0_spindown("f0", "f1", "dist")})
    tag = f"_{int(100 * q)}%UL"
    agg = [F.first(c).alias(n) for c, n in (("limit", f"{value}{tag}"), ("ellipticity", f"ell{tag}"), ("q22", f"q22{tag}"), ("sdratio", f"sdrat{tag}"))]
    return lim.groupBy("source").pivot("dets").agg(*agg)


def amplitude_limits(samples: DataFrame, sources: DataFrame, q: float = 0.95, amplitudes=("h0", "c21", "c22", "q22")) -> DataFrame:
    """(source, dets, column, value): limits on all amplitudes that the samples have, and what follows from h0.

    samples: (source, dets, one column for each amplitude, null where a source's model has none);
    sources: (source, f0, f1, dist). Columns are named H0_95%UL for a source with results of one
    detector set and H0_{dets}_95%UL otherwise; so are ELL, Q22 (from h0, where q22 is no amplitude of the source) and
    SDRAT. SDLIM, a row for each source with a falling frequency and a distance, has no detectors.
    """
    have = [a for a in amplitudes if a in samples.columns]
    lim = samples.groupBy("source", "dets").agg(*[F.percentile(a, F.lit(q)).alias(a) for a in have])
    sets = lim.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    j = lim.join(sets, "source").join(sources.select("source", "f0", "f1", "dist"), "source", "left")
    null = F.lit(None).cast("double")
    h0 = F.col("h0") if "h0" in have else null
    ell = h0_to_ellipticity(h0, "f0", "dist")
    spin = F.when(F.col("f1") < 0, h0_spindown("f0", "f1", "dist"))
    named = [(a.upper(), F.col(a)) for a in have if a != "q22"] + [("ELL", ell), ("Q22", F.coalesce(F.col("q22") if "q22" in have else null, ellipticity_to_q22(ell))), ("SDRAT", h0 / spin)]
    rows = j.select("source", "dets", "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in named])).alias("_r")).where("_r.value is not null")
    name = F.concat(F.col("_r.name"), F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit("_"), "dets")), F.lit(f"_{int(100 * q)}%UL"))
    limit = j.groupBy("source").agg(F.max(F.when(h0.isNotNull(), spin)).alias("value")).where("value is not null")
    return rows.select("source", "dets", name.alias("column"), F.col("_r.value").alias("value")).unionByName(limit.select("source", F.lit(None).cast("string").alias("dets"), F.lit("SDLIM").alias("column"), "value"))


def limits_row(limits: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each source with the named columns; the names are given, so that no job has to find them."""
    return limits.groupBy("source").pivot("column", columns).agg(F.first("value"))


def results_with_data(results: DataFrame, series: DataFrame) -> DataFrame:
    """For each (source, dets) the series of its detectors: two-character codes, one after the other."""
    member = F.explode(F.transform(F.sequence(F.lit(0), (F.length("dets") / 2 - 1).cast("int")), lambda i: F.substring(F.col("dets"), (i * 2 + 1).cast("int"), F.lit(2))))
    return results.withColumn("detector", member).join(series, ["source", "detector"])


def fill_from_catalog(par: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Own value, else the catalogue's; a finite intrinsic period derivative overrides even an own f1: f1 = -pdot f0^2.

    par: (source, dist, f0, f1); catalogue: (source, c_dist, c_f0, c_f1, c_pdot).
    """
    j = par.join(catalogue, "source", "left")
    f0 = F.coalesce("f0", "c_f0")
    finite = F.col("c_pdot").isNotNull() & ~F.isnan("c_pdot") & (F.abs("c_pdot") < float("inf"))
    f1 = F.when(finite, -F.col("c_pdot") * f0 * f0).otherwise(F.coalesce("f1", "c_f1"))
    return j.select("source", F.coalesce("dist", "c_dist").alias("dist"), f0.alias("f0"), f1.alias("f1"))


def match_known(sources: DataFrame, known: DataFrame, on: list[str], by_name: str = "name") -> DataFrame:
    """Sources that match a known injection by name or by equal parameters; (source columns, match)."""
    name = sources.join(known.select(F.col(by_name).alias("_k"), F.col(by_name).alias("match")), F.col(by_name) == F.col("_k")).drop("_k")
    k = known.select(F.xxhash64(*on).alias("_h"), *[F.col(c).alias(f"_{c}") for c in on], F.col(by_name).alias("match"))
    same = F.col("_h") == F.xxhash64(*on)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rest = sources.join(known.select(F.col(by_name)), by_name, "left_anti")
    return name.unionByName(rest.join(k, same).drop("_h", *[f"_{c}" for c in on]))


def join_snr_odds(snr: DataFrame, odds_: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Inner join of two statistics; the sources of one have to contain those of the other."""
    if not snr.join(odds_, "source", "left_anti").isEmpty() and not odds_.join(snr, "source", "left_anti").isEmpty():
        raise ValueError("neither set of sources contains the other")
    out = snr.join(odds_, "source")
    return out.where(F.col("source").isin(*only)) if only else out


def filter_recycled(df: DataFrame) -> DataFrame:
    """Recycled sources: 0 < 3.2e19 sqrt(-f1/f0^3) <= 1e11 and f0 >= 1/0.03."""
    b = 3.2e19 * F.sqrt(F.greatest(-F.col("f1") / F.pow("f0", F.lit(3)), F.lit(0.0)))
    return df.where((b > 0) & (b <= 1e11) & (F.col("f0") >= 1 / 0.03))


def select_sources(df: DataFrame, include: list | None = None, exclude: list | None = None, compat: bool = False) -> DataFrame:
    """Requested sources without the excluded ones; compat: exclusion counts only beside an include list."""
    if include:
        df = df.where(F.col("source").isin(*include))
    return df.where(~F.col("source").isin(*exclude)) if exclude and (include or not compat) else df


def valid_parameters(df: DataFrame, name: str = "name") -> DataFrame:
    return df.where(" and ".join(f"{c} is not null" for c in ("f0", "ra", "dec", name)))


def flag_near_nyquist(series: DataFrame, sources: DataFrame, rate: float) -> DataFrame:
    return series.join(sources.select("source", "f0"), "source").withColumn("near_nyquist", F.col("freqfactor") * F.col("f0") > 0.8 * rate / 2)


def sort_limits(table: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Sort by a column; if there is none of that name, by the one whose name has it inside and whose minimum is smallest."""
    name = by
    if by not in table.columns:
        some = [c for c in table.columns if by in c]
        if not some:
            raise ValueError(f"no column holds {by}")
        low = table.agg(*[F.min(f"`{c}`").alias(f"c{i}") for i, c in enumerate(some)]).first()
        name = min((x, c) for x, c in zip(low, some, strict=True) if x is not None)[1]
    c = F.col(f"`{name}`")
    return table.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "source")


def most_constraining(table: DataFrame, lows: list[str], highs: list[str] = ()) -> DataFrame:
    """Boolean ``{c}_best`` columns: the smallest limits and the largest odds, from one aggregate."""
    tops = table.agg(*[F.min(f"`{c}`").alias(f"_t_{c}") for c in lows], *[F.max(f"`{c}`").alias(f"_t_{c}") for c in highs])
    j = table.crossJoin(F.broadcast(tops))  # one row
    flags = [(F.col(f"`{c}`") == F.col(f"`_t_{c}`")).alias(f"{c}_best") for c in [*lows, *highs]]
    return j.select(*[F.col(f"`{c}`") for c in table.columns], *flags)


def best_column(table: DataFrame, name: str) -> str:
    """The column of several detectors, else the one with the smallest mean."""
    some = [c for c in table.columns if name in c]
    if not some:
        raise ValueError(f"no column holds {name}")
    widest = max(some, key=lambda c: len(c.split("_")[0]))
    if len(widest.split("_")[0]) > 2:
        return widest
    mean = table.agg(*[F.avg(f"`{c}`").alias(f"c{i}") for i, c in enumerate(some)]).first()
    return min(zip(mean, some, strict=True))[1]


def common_parameters(long: DataFrame, result: str = "source", param: str = "param") -> DataFrame:
    """Parameters that every result has, and the number of results that have each."""
    total = long.agg(F.count_distinct(result).alias("_n"))
    return long.groupBy(param).agg(F.count_distinct(result).alias("n_results")).crossJoin(F.broadcast(total)).select(param, "n_results", (F.col("n_results") == F.col("_n")).alias("common"))


def sample_without_replacement(df: DataFrame, key: list[str], draw: str, n: int, seed: int = 0) -> DataFrame:
    """n draws of each key in hash order; reproducible."""
    w = Window.partitionBy(*key).orderBy(hash_uniform(draw, seed), draw)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sensitivity_curve(asds: DataFrame, t_obs: DataFrame, scale: float, points: int = 1000) -> DataFrame:
    """(f, sensitivity): ASD^2 / T_obs of each detector, interpolated to common frequencies, combined harmonically.

    asds: (detector, f, asd); t_obs: (detector, t_obs), one for each detector or an error.
    """
    if not asds.select("detector").distinct().join(t_obs, "detector", "left_anti").isEmpty():
        raise ValueError("a detector has no observing time")
    w = Window.partitionBy("detector").orderBy("f")
    psd = asds.join(t_obs, "detector").withColumn("s", F.col("asd") * F.col("asd") / F.col("t_obs"))
    parts = psd.select("detector", F.col("f").alias("f0"), F.col("s").alias("s0"), F.lead("f").over(w).alias("f1"), F.lead("s").over(w).alias("s1")).where("f1 is not null")
    band = asds.groupBy("detector").agg(F.min("f").alias("a"), F.max("f").alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    # each stretch of a curve makes the grid points inside it: no join of grid and curves
    cut = parts.crossJoin(F.broadcast(band)).withColumn("d", (F.col("b") - F.col("a")) / (points - 1))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("f0") - F.col("a")) / F.col("d") - 1e-9)), F.least(F.lit(points - 1), F.ceil((F.col("f1") - F.col("a")) / F.col("d") - 1e-9) - 1)
    last = F.when(F.col("f1") >= F.col("b"), F.lit(points - 1)).otherwise(last)
    rows = cut.where((first <= last) & (F.col("f0") <= F.col("b"))).withColumn("k", F.explode(F.sequence(first, last)))
    f = F.col("a") + F.col("k") * F.col("d")
    s = F.col("s0") + (f - F.col("f0")) / (F.col("f1") - F.col("f0")) * (F.col("s1") - F.col("s0"))
    return rows.select("k", f.alias("f"), s.alias("s")).groupBy("k").agg(F.first("f").alias("f"), (scale * F.sqrt(1 / F.sum(1 / F.col("s")))).alias("sensitivity"))
