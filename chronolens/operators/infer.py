"""From series to likelihoods: signal-to-noise ratios, products of chunks, grids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, ln_gamma
from .slices import times


#: Chunks that one pass over a grid takes: a bounded broadcast; more make further passes.
PASS_CHUNKS = 100_000


def signal_snr(df: DataFrame, key: list[str], re: str = "t_re", im: str = "t_im", sigma: str = "sigma") -> DataFrame:
    """sqrt of the sum of (re / sigma)^2 + (im / sigma)^2 over a template's columns."""
    p = (F.col(re) * F.col(re) + F.col(im) * F.col(im)) / (F.col(sigma) * F.col(sigma))
    return df.groupBy(*key).agg(F.sqrt(F.sum(p)).alias("snr"))


def coherent_snr(per_series: DataFrame, key: list[str]) -> DataFrame:
    """Root of the sum of squares; null ratios (no injection) are skipped."""
    return per_series.groupBy(*key).agg(F.sqrt(F.sum(F.col("snr") * F.col("snr"))).alias("coherent_snr"))


def chunk_products(df: DataFrame, key: list[str], templates=("fp", "fc"), gaussian: bool = False) -> DataFrame:
    """n, dd and all products d.T (re, im) and T.T of a chunk in one aggregate; weight 1, or 1 / sigma^2 for a Gaussian."""
    w = 1 / (F.col("sigma") * F.col("sigma")) if gaussian else F.lit(1.0)
    out = [F.count(F.lit(1)).alias("n"), F.sum(w * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("dd")]
    for i, t in enumerate(templates):
        out += [F.sum(w * F.col("re") * F.col(t)).alias(f"d_{t}_re"), F.sum(w * F.col("im") * F.col(t)).alias(f"d_{t}_im")]
        out += [F.sum(w * F.col(t) * F.col(u)).alias(f"{t}_{u}") for u in templates[i:]]
    if gaussian:
        out.append(F.sum(F.log("sigma")).alias("ln_sigma"))
    return df.groupBy(*key).agg(*out)


def chi_square(templates=("fp", "fc")) -> Column:
    """dd - 2 d.m + m.m with m = sum a_T T; amplitudes are columns a_{T}_re, a_{T}_im."""
    dm = reduce(Column.__add__, [F.col(f"d_{t}_re") * F.col(f"a_{t}_re") + F.col(f"d_{t}_im") * F.col(f"a_{t}_im") for t in templates])
    mm = F.lit(0.0)
    for i, t in enumerate(templates):
        for u in templates[i:]:
            both = F.col(f"a_{t}_re") * F.col(f"a_{u}_re") + F.col(f"a_{t}_im") * F.col(f"a_{u}_im")
            mm = mm + (1 if t == u else 2) * F.col(f"{t}_{u}") * both
    return F.col("dd") - 2 * dm + mm


def chunk_log_likelihood(chi2: Column, gaussian: bool = False) -> Column:
    n = F.col("n")
    if gaussian:
        return -0.5 * chi2 - n * math.log(2 * math.pi) - 2 * F.col("ln_sigma")
    return ln_gamma(n) - math.log(2) - n * (math.log(math.pi) + F.log(chi2))


def log_likelihood(grid: DataFrame, products: DataFrame, key: list[str], grid_id: list[str], templates=("fp", "fc"), gaussian: bool = False) -> DataFrame:
    """Log likelihood of every grid point: grid x chunks, summed by (key, grid point).

    Products are a row for each chunk and are broadcast in slices of bounded size; the grid stays dealt out.
    """
    j = times(grid, products, PASS_CHUNKS)
    return j.groupBy(*key, *grid_id).agg(F.sum(chunk_log_likelihood(chi_square(templates), gaussian)).alias("ln_like"))


def noise_log_evidence(products: DataFrame, key: list[str], gaussian: bool = False) -> DataFrame:
    return products.groupBy(*key).agg(F.sum(chunk_log_likelihood(F.col("dd"), gaussian)).alias("ln_z_noise"))


def _pairs(templates) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(templates)) for j in range(i, len(templates))]


#: The six responses: tensor plus and cross, vector x and y, scalar breathing and longitudinal.
MODES = ("tp", "tc", "vx", "vy", "sb", "sl")


def joint_products(df: DataFrame, key: list[str], templates=MODES, gaussian: bool = False) -> DataFrame:
    """All products of a chunk with a set of templates, in one aggregate.

    A template is a column, or a complex one as columns {name}_re and {name}_im. Returns n, dd, the
    Hermitian matrix of the templates as its upper triangle by rows (arrays gram_re, gram_im), the
    products conj(T) d (dot_re, dot_im) and ln_sigma. Weights are 1, or 1 / sigma^2 with
    ``gaussian``. ``white``: the real triangle under 1 / sigma^2 in either case, for signal-to-noise
    ratios; null without a sigma column. Harmonics are series of their own: have ``freqfactor`` in the key.
    """
    real = {t: t in df.columns for t in templates}
    part = lambda t: (F.col(t), F.lit(0.0)) if real[t] else (F.col(f"{t}_re"), F.col(f"{t}_im"))
    noise = "sigma" in df.columns
    white = 1 / (F.col("sigma") * F.col("sigma")) if noise else None
    if gaussian and not noise:
        raise ValueError("a Gaussian likelihood needs sigma")
    w = white if gaussian else F.lit(1.0)

    def product(a, b, weight, imaginary: bool) -> Column:
        (ar, ai), (br, bi) = a, b
        return F.sum(weight * (ar * bi - ai * br if imaginary else ar * br + ai * bi))

    d, pairs = (F.col("re"), F.col("im")), _pairs(templates)
    out = [F.count(F.lit(1)).alias("n"), product(d, d, w, False).alias("dd")]
    for name, weight, imaginary in (("gram_re", w, False), ("gram_im", w, True), ("white", white, False)):
        if weight is not None:
            out.append(F.array(*[product(part(templates[i]), part(templates[j]), weight, imaginary) for i, j in pairs]).alias(name))
    for name, imaginary in (("dot_re", False), ("dot_im", True)):
        out.append(F.array(*[product(part(t), d, w, imaginary) for t in templates]).alias(name))
    out.append((F.sum(F.log("sigma")) if noise else F.lit(None).cast("double")).alias("ln_sigma"))
    sums = df.groupBy(*key).agg(*out)
    return sums if noise else sums.withColumn("white", F.lit(None).cast("array<double>"))


def quadratic_form(templates=MODES, gram: tuple[str, str | None] = ("gram_re", "gram_im"), amp: str = "a") -> Column:
    """conj(a) G a over the upper triangle; amplitudes are columns {amp}_{template}_re and _im."""
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_pairs(templates)):
        (ar, ai), (br, bi) = ((F.col(f"{amp}_{templates[x]}_re"), F.col(f"{amp}_{templates[x]}_im")) for x in (i, j))
        both = F.get(gram[0], F.lit(k)) * (ar * br + ai * bi)
        if gram[1] is not None and i != j:
            both = both - F.get(gram[1], F.lit(k)) * (ar * bi - ai * br)
        total = total + (1 if i == j else 2) * both
    return total


def joint_chi_square(templates=MODES, amp: str = "a") -> Column:
    """dd - 2 Re(conj(a) T.d) + conj(a) G a."""
    dot = reduce(Column.__add__, [F.get("dot_re", F.lit(k)) * F.col(f"{amp}_{t}_re") + F.get("dot_im", F.lit(k)) * F.col(f"{amp}_{t}_im") for k, t in enumerate(templates)])
    return F.col("dd") - 2 * dot + quadratic_form(templates, amp=amp)


def joint_log_likelihood(grid: DataFrame, products: DataFrame, key: list[str], grid_id: list[str], harmonics=(1, 2), templates=MODES, gaussian: bool = False) -> DataFrame:
    """Log likelihood of every grid point over the chunks of all detectors and harmonics, summed by (key, grid point).

    Products have a column freqfactor; a harmonic's amplitudes are the grid's columns
    a{harmonic}_{template}_re and _im. Chunks of other harmonics are left out. Chunks are dealt to
    slices of bounded size; a slice is broadcast to the grid, which stays where it is.
    """
    mine = products.where(F.col("freqfactor").isin(*[float(h) for h in harmonics]))
    chosen = [F.when(F.col("freqfactor") == float(h), chunk_log_likelihood(joint_chi_square(templates, f"a{h}"), gaussian)) for h in harmonics]
    return times(grid, mine, PASS_CHUNKS).groupBy(*key, *grid_id).agg(F.sum(F.coalesce(*chosen)).alias("ln_like"))


def joint_snr(products: DataFrame, key: list[str], harmonics=(1, 2), templates=MODES) -> DataFrame:
    """Signal-to-noise ratio of amplitudes a{harmonic}_{template}_re, _im, joined to the products already, over chunks and harmonics."""
    power = F.coalesce(*[F.when(F.col("freqfactor") == float(h), quadratic_form(templates, ("white", None), f"a{h}")) for h in harmonics])
    return products.groupBy(*key).agg(F.sqrt(F.sum(power)).alias("snr"))


def grid_axis(spark: SparkSession, name: str, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """(name, w_name): points and trapezoid weights of an axis."""
    if not low < high or bins < 2:
        raise ValueError("an axis needs low < high and two points")
    x = F.col("id") * ((high - low) / (bins - 1)) + low
    if log:
        a, b = math.log10(low), math.log10(high)
        x = F.pow(F.lit(10.0), F.col("id") * ((b - a) / (bins - 1)) + a)
    rows = spark.range(bins).select("id", x.alias(name))
    w = Window.orderBy("id")  # an axis is a few points
    weight = (F.coalesce(F.lead(name).over(w), F.col(name)) - F.coalesce(F.lag(name).over(w), F.col(name))) / 2
    return rows.select(name, weight.alias(f"w_{name}"))


def parameter_grid(spark: SparkSession, axes: dict[str, tuple]) -> DataFrame:
    """Product of axes with the product of their weights as ``w``; axes: name -> (low, high, bins[, log])."""
    grid = reduce(lambda a, b: a.crossJoin(b), [grid_axis(spark, k, *v) for k, v in axes.items()])
    return grid.withColumn("w", reduce(Column.__mul__, [F.col(f"w_{k}") for k in axes])).drop(*[f"w_{k}" for k in axes])


def log_sum_exp(df: DataFrame, key: list[str], x: Column, w: Column | None = None, out: str = "lse") -> DataFrame:
    """ln sum w exp(x) by key: the maximum first, then the sum."""
    rows = df.select(*key, x.alias("_x"), (w if w is not None else F.lit(1.0)).alias("_w"))
    top = rows.groupBy(*key).agg(F.max("_x").alias("_top"))
    j = rows.join(top, key) if key else rows.crossJoin(top)
    return j.groupBy(*key, "_top").agg(F.sum(F.col("_w") * F.exp(F.col("_x") - F.col("_top"))).alias("_s")).select(*key, (F.col("_top") + F.log("_s")).alias(out))


def grid_evidence(grid: DataFrame, key: list[str]) -> DataFrame:
    """Trapezoid of exp(ln_like + ln_prior); columns ln_like, ln_prior, w."""
    return log_sum_exp(grid, key, F.col("ln_like") + F.col("ln_prior"), F.col("w"), "ln_z")


def marginalise(grid: DataFrame, key: list[str], keep: list[str], weight: str = "w") -> DataFrame:
    """Posterior over the kept axes, summing to one under the grid's weights."""
    z = log_sum_exp(grid, key, F.col("ln_like") + F.col("ln_prior"), F.col(weight), "_z")
    j = grid.join(z, key)
    return j.groupBy(*key, *keep).agg(F.sum(F.col(weight) * F.exp(F.col("ln_like") + F.col("ln_prior") - F.col("_z"))).alias("p"))


def grid_credible_interval(marginal: DataFrame, key: list[str], axis: str, low: float, high: float) -> DataFrame:
    """Axis values where the cumulative marginal passes low and high."""
    c = F.sum("p").over(Window.partitionBy(*key).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))
    rows = marginal.withColumn("_c", c)
    at = lambda q: F.min(F.when(F.col("_c") >= q - 1e-12, F.col(axis)))
    return rows.groupBy(*key).agg(at(low).alias("low"), at(high).alias("high"))


def detector_combinations(series: DataFrame, coherent: bool = True, incoherent: bool = True) -> DataFrame:
    """(source, dets, detector): the joint combination and each detector alone; one detector gives itself only."""
    if not coherent and not incoherent:
        raise ValueError("neither coherent nor incoherent")
    sets = series.groupBy("source").agg(F.array_sort(F.collect_set("detector")).alias("all"))
    single = F.transform("all", lambda d: F.array(d))
    one = F.size("all") == 1
    joint = F.array(F.col("all"))
    combos = F.when(one, joint).otherwise(F.concat(joint, single) if coherent and incoherent else joint if coherent else single)
    return sets.select("source", F.explode(combos).alias("c")).select("source", F.concat_ws("", "c").alias("dets"), F.explode("c").alias("detector"))


def weighted(value: str, weight: str) -> Column:
    return F.sum(col(value) * col(weight)) / F.sum(col(weight))
