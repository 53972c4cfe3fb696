"""Population inference: hyper-parameter distributions and their likelihoods over many sources."""

from __future__ import annotations

import math
import re
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, ellipticity_to_q22, h0_to_q22, hash_uniform, normal_cdf
from .infer import log_sum_exp
from .slices import slices_of, times
from .storage import written


def never() -> Column:
    return F.lit(float("-inf"))


class Distribution(ABC):
    """Subclass and give log_pdf(x, hyper): hyper-parameters come as columns by name."""

    low, high = 0.0, math.inf

    @abstractmethod
    def log_pdf(self, x: Column, hyper: dict[str, Column]) -> Column: ...

    def inside(self, x: Column, value: Column) -> Column:
        """-inf for each x out of bounds (for that x alone)."""
        ok = (x >= self.low) & (x <= self.high if self.high < math.inf else F.lit(True))
        return F.when(ok, value).otherwise(never())


class Exponential(Distribution):
    """Scale ``mu``; not positive: -inf."""

    def log_pdf(self, x, hyper):
        mu = hyper["mu"]
        return F.when(mu > 0, self.inside(x, -F.log(F.abs(mu)) - x / mu)).otherwise(never())


class PowerLaw(Distribution):
    """x^-alpha between minimum and maximum, columns ``alpha, minimum, maximum``."""

    def log_pdf(self, x, hyper):
        a, lo, hi = hyper["alpha"], hyper["minimum"], hyper["maximum"]
        flat = F.abs(a - 1) < 1e-12
        norm = F.when(flat, F.log(F.log(hi / lo))).otherwise(F.log(F.abs((F.pow(hi, 1 - a) - F.pow(lo, 1 - a)) / F.when(flat, 1.0).otherwise(1 - a))))
        return F.when((x >= lo) & (x <= hi), -a * F.log(x) - norm).otherwise(never())


class Delta(Distribution):
    """All at ``peak``."""

    def log_pdf(self, x, hyper):
        return F.when(x == hyper["peak"], 0.0).otherwise(never())


class BoundedGaussian(Distribution):
    """Mixture of Gaussians cut at ``low``: columns mu0, sigma0, w0, mu1, ...; the last weight is one minus the others."""

    def __init__(self, modes: int = 1, low: float = 0.0):
        self.modes, self.low = modes, low

    def log_pdf(self, x, hyper):
        total, left = F.lit(0.0), F.lit(1.0)
        ok = F.lit(True)
        for i in range(self.modes):
            mu, given = hyper[f"mu{i}"], hyper[f"sigma{i}"]
            s = F.when(given > 0, given).otherwise(1.0)  # no division by zero, whatever order Spark evaluates in
            w = left if i == self.modes - 1 else hyper[f"w{i}"]
            left, ok = left - w, ok & (given > 0)
            z = (x - mu) / s
            total = total + w * F.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi) * (1 - normal_cdf((F.lit(self.low) - mu) / s)))
        return F.when(ok & (total > 0), self.inside(x, F.log(total))).otherwise(never())


class Histogram(Distribution):
    """Bins with equal edges, weights w0..; density=True divides by the bin's width, else the log weight is returned."""

    def __init__(self, low: float, high: float, bins: int, density: bool = True):
        self.low, self.high, self.bins, self.density = low, high, bins, density

    def log_pdf(self, x, hyper):
        width = (self.high - self.low) / self.bins
        k = F.least(F.floor((x - self.low) / width), F.lit(self.bins - 1))
        w = F.coalesce(*[F.when(k == i, hyper[f"w{i}"]) for i in range(self.bins)])
        return self.inside(x, F.log(w / width) if self.density else F.log(w))


DISTRIBUTIONS = {"exponential": Exponential, "powerlaw": PowerLaw, "delta": Delta, "bounded-gaussian": BoundedGaussian, "histogram": Histogram}


def distribution(name: str | Distribution, **kwargs) -> Distribution:
    return name if isinstance(name, Distribution) else DISTRIBUTIONS[name.lower()](**kwargs)


#: What replaces a log likelihood of -inf.
FLOOR = -1e300 ** 0.5
#: Points of a hyper grid or an axis that are broadcast at once; more take a pass for each slice.
MOST_POINTS = 100_000
#: Exponents are taken from the nearest multiple of this.
SPAN = 500.0


def log_hyper_likelihood_samples(samples: DataFrame, hyper_grid: DataFrame, dist: Distribution, hyper_id: str, params: list[str], value: str = "x") -> DataFrame:
    """(hyper_id, ln_like): sum over sources of ln mean over draws of the pdf. The hyper grid is small and broadcast after a check."""
    j = times(samples, hyper_grid, MOST_POINTS)
    pdf = F.exp(dist.log_pdf(F.col(value), {p: F.col(p) for p in params}))
    by_source = j.groupBy(hyper_id, "source").agg(F.avg(pdf).alias("m"))
    return by_source.groupBy(hyper_id).agg(F.sum(F.when(F.col("m") > 0, F.log("m")).otherwise(FLOOR)).alias("ln_like"))


def source_likelihood_on_grid(samples: DataFrame, evidence: DataFrame, grid: DataFrame, value: str = "x") -> DataFrame:
    """(source, x, ln_l): density of draws mirrored at zero, bandwidth from the draws as they are, twice that, plus ln_z, minus the flat ln prior.

    evidence: (source, ln_z, ln_prior); grid: one column x, of checked size.
    """
    stats = samples.groupBy("source").agg(F.stddev_samp(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    rows = samples.join(stats, "source").select("source", F.col(value).alias("_v"), (F.col("_s") * F.pow("_n", F.lit(-0.2))).alias("_h"))
    j = times(rows, grid, MOST_POINTS)
    k = lambda m: F.exp(-0.5 * F.pow((F.col("x") - m) / F.col("_h"), F.lit(2)))
    dens = F.avg((k(F.col("_v")) + k(-F.col("_v"))) / (F.col("_h") * math.sqrt(2 * math.pi)))
    out = j.groupBy("source", "x").agg(dens.alias("_d")).join(evidence, "source")
    return out.select("source", "x", (F.log("_d") + F.col("ln_z") - F.col("ln_prior")).alias("ln_l"))


def log_hyper_likelihood_grid(like: DataFrame, hyper_grid: DataFrame, dist: Distribution, hyper_id: str, params: list[str]) -> DataFrame:
    """(hyper_id, ln_like): sum over sources of ln of the trapezoid of exp(ln pdf + ln_l) over x; FLOOR for a source without a finite term."""
    w = Window.partitionBy("source").orderBy("x")
    weight = (F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))) / 2
    j = times(like.withColumn("w", weight), hyper_grid, MOST_POINTS)
    term = dist.log_pdf(F.col("x"), {p: F.col(p) for p in params}) + F.col("ln_l")
    by_source = log_sum_exp(j.where(term > never()), [hyper_id, "source"], term, F.col("w"), "l")
    every = times(like.select("source").distinct(), hyper_grid.select(hyper_id).distinct(), MOST_POINTS)
    return every.join(by_source, [hyper_id, "source"], "left").groupBy(hyper_id).agg(F.sum(F.coalesce("l", F.lit(FLOOR))).alias("ln_like"))


def modes_of(dist: Distribution, params: dict[str, Column]) -> list[tuple[Column, Column]]:
    """(centre, width) of the places where a distribution changes fast, in its parameters; one for each mode."""
    n = sum(1 for k in params if re.fullmatch(r"mu\d+", k))
    if n:
        return [(params[f"mu{i}"], params[f"sigma{i}"]) for i in range(n)]
    if "mu" in params and "sigma" in params:
        return [(params["mu"], params["sigma"])]
    if "mu" in params:
        return [(params["mu"], params["mu"])]
    return []


def refined_hyper_likelihood(like: DataFrame, hyper_grid: DataFrame, dist: Distribution, hyper_id: str, params: list[str], sigmas: float = 6.0, nodes: int = 100, modes: Callable | None = None) -> DataFrame:
    """:func:`log_hyper_likelihood_grid` on a grid of each hyper point's own: the coarse one and ``nodes`` points within ``sigmas`` widths of each mode.

    A source's ln_l at the added points is the cubic through its four nearest coarse points (a
    natural continuation at the ends; linear if there are fewer than four). Coarse points of all
    sources are the same; points beyond them are left out. Every added point finds its coarse cell by an equi-join on the
    cell's number, so nothing is compared with all coarse points. Added points are made once for each hyper point, shared by all
    sources as weights and pdf are, and joined to a source's coarse cells. A hyper point with a null or zero parameter keeps the coarse grid alone.
    """
    like = written(like.select("source", "x", "ln_l"), "likelihoods")
    cells = written(like.select("x").distinct(), "cells")  # the coarse grid
    of = Window.orderBy("x")  # an axis of checked size
    if cells.count() > 100_000:
        raise ValueError("the coarse grid has over 100000 points")
    axis = written(cells.select("x", (F.row_number().over(of) - 1).alias("cell"), F.lead("x").over(of).alias("x_next")), "axis")
    low, high = axis.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return hyper_grid.select(hyper_id).distinct().withColumn("ln_like", F.lit(None).cast("double")).limit(0)
    named = {p: F.col(p) for p in params}
    own = []
    for centre, width in (modes or modes_of)(dist, named):
        a, b = F.greatest(F.lit(low), centre - sigmas * width), F.least(F.lit(high), centre + sigmas * width)
        own.append(F.when((width > 0) & (a < b), _even(a, b, nodes)).otherwise(F.array().cast("array<double>")))
    empty = F.array().cast("array<double>")
    added = hyper_grid.withColumn("x", F.explode(F.array_distinct(F.concat(empty, *own)))).where((F.col("x") > low) & (F.col("x") < high))
    # the cell of an added point: coarse points and added ones in one order would need a sort of all; a bucket of the mean spacing finds the few candidates
    spacing = (high - low) / max(axis.count() - 1, 1)
    spread = lambda c: F.floor((F.col(c) - low) / spacing)
    buckets = axis.where("x_next is not null").withColumn("bucket", F.explode(F.sequence(spread("x"), spread("x_next"))))
    placed = added.withColumn("bucket", spread("x")).alias("p").join(F.broadcast(buckets.select("bucket", "cell", F.col("x").alias("x_lo"), "x_next")), "bucket")
    placed = placed.where((F.col("x") > F.col("x_lo")) & (F.col("x") < F.col("x_next"))).select(hyper_id, *params, "x", "cell", F.lit(True).alias("added"))
    # all points of a hyper point with weight and pdf: the same for all sources, and broadcast to them in slices
    coarse = times(axis.select("x", "cell"), hyper_grid.select(hyper_id, *params), MOST_POINTS).select(hyper_id, *params, "x", "cell", F.lit(False).alias("added"))
    by = Window.partitionBy(hyper_id).orderBy("x")
    weight = (F.coalesce(F.lead("x").over(by), F.col("x")) - F.coalesce(F.lag("x").over(by), F.col("x"))) / 2
    points = placed.unionByName(coarse).withColumns({"w": weight, "lp": dist.log_pdf(F.col("x"), named)})
    points = written(points.where(F.col("lp") > never()).select(hyper_id, "x", "cell", "added", "w", "lp"), "points")
    # a source's stencil: its four coarse points around each cell
    w = Window.partitionBy("source").orderBy("x")
    partitions = max(int(like.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    numbered = like.repartition(partitions, "source").withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("source"))})
    at = lambda c, k: (F.lead if k >= 0 else F.lag)(c, abs(k)).over(w)
    shift = F.greatest(F.lit(0), F.least(F.col("_r") - 1, F.col("_n") - 4)) - F.col("_r")
    pick = lambda c, j: F.coalesce(*[F.when(shift + j == k, at(c, k)) for k in range(-3, 4)])
    pieces = numbered.select("source", F.col("_r").alias("cell"), *[pick(c, j).alias(f"{n}{j}") for c, n in (("x", "x"), ("ln_l", "y")) for j in range(4)], F.col("x").alias("a0"), F.col("ln_l").alias("b0"), at("x", 1).alias("a1"), at("ln_l", 1).alias("b1"))
    xs, ys = ([F.col(f"{n}{j}") for j in range(4)] for n in "xy")
    cubic = F.lit(0.0)
    for i in range(4):
        term = ys[i]
        for j in range(4):
            if i != j:
                term = term * (F.col("x") - xs[j]) / (xs[i] - xs[j])
        cubic = cubic + term
    line = F.col("b0") + (F.col("x") - F.col("a0")) * (F.col("b1") - F.col("b0")) / (F.col("a1") - F.col("a0"))
    value = F.col("lp") + F.when(F.col("added"), F.coalesce(cubic, line)).otherwise(F.col("b0"))
    # sums of terms scaled by powers of e^SPAN near them: one pass, no largest term is needed first; a source's
    # cells lie in one partition, and so do its sums, so that nothing shuffles with the points
    sums = None
    for part in slices_of(points, MOST_POINTS):
        terms = pieces.join(F.broadcast(part), "cell").select(hyper_id, "source", value.alias("_x"), F.col("w").alias("_w")).where(F.col("_x") > never())
        got = terms.withColumn("_b", F.rint(F.col("_x") / SPAN)).groupBy(hyper_id, "source", "_b").agg(F.sum(F.col("_w") * F.exp(F.col("_x") - SPAN * F.col("_b"))).alias("_s"))
        sums = got if sums is None else sums.unionByName(got)
    by_source = sums.groupBy(hyper_id, "source").agg(F.collect_list(F.struct("_b", "_s")).alias("_t"), F.max("_b").alias("_top"))
    total = F.aggregate("_t", F.lit(0.0), lambda s, t: s + t["_s"] * F.exp(SPAN * (t["_b"] - F.col("_top"))))
    by_source = by_source.select(hyper_id, "source", (SPAN * F.col("_top") + F.log(total)).alias("l"))
    pairs = times(like.select("source").distinct(), hyper_grid.select(hyper_id).distinct(), MOST_POINTS)
    return pairs.join(by_source, [hyper_id, "source"], "left").groupBy(hyper_id).agg(F.sum(F.coalesce("l", F.lit(FLOOR))).alias("ln_like"))


def _even(a: Column, b: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: a + k * (b - a) / (n - 1))


def hyper_posterior(ll: DataFrame, hyper_id: str, weight: Column | None = None) -> DataFrame:
    """(.., p) over the hyper grid, summing to one."""
    z = log_sum_exp(ll, [], F.col("ln_like"), weight, "_z")
    return ll.crossJoin(F.broadcast(z)).withColumn("p", (weight if weight is not None else F.lit(1.0)) * F.exp(F.col("ln_like") - F.col("_z"))).drop("_z")


def posterior_predictive(post: DataFrame, points: DataFrame, dist: Distribution, params: list[str]) -> DataFrame:
    """(x, density): mean pdf at points under the hyper posterior (column p)."""
    j = times(post, points, MOST_POINTS)
    return j.groupBy("x").agg(F.sum(F.col("p") * F.exp(dist.log_pdf(F.col("x"), {q: F.col(q) for q in params}))).alias("density"))


def to_quadrupole(samples: DataFrame, draw: str, f0: str = "f0", dist: str = "dist", compat: bool = False, prior: Column | None = None, seed: int = 3) -> DataFrame:
    """Column q22 from q22, ell or h0, whichever is there; draws under a non-uniform prior are thinned with weight 1/prior.

    compat: the weight is the prior itself, as an older tool had it.
    """
    have = [c for c in ("q22", "ell", "h0") if c in samples.columns]
    forms = {"q22": col("q22") if "q22" in have else None, "ell": ellipticity_to_q22("ell") if "ell" in have else None, "h0": h0_to_q22("h0", f0, dist) if "h0" in have else None}
    out = samples.withColumn("q22", F.coalesce(*[forms[c] for c in have]))
    if prior is None:
        return out
    weight = prior if compat else 1 / prior
    w = out.withColumn("_w", weight)
    top = F.max("_w").over(Window.partitionBy("source"))
    return w.withColumn("_t", top).where(hash_uniform(draw, seed) < F.col("_w") / F.col("_t")).drop("_w", "_t")
