"""Background studies: distributions of a statistic away from the source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import OBLIQUITY, angular_separation, ecliptic_to_equatorial, erfc, hash_uniform
from .slices import times
from .storage import written


#: Points or places of the detector that are broadcast at once.
MOST_NODES = 100_000


def join_background(shifts: DataFrame, odds: DataFrame, key: str = "name") -> DataFrame:
    """Join whose sets of names have to be equal."""
    j = shifts.join(odds, key, "full_outer")
    s, o = [c for c in shifts.columns if c != key][0], [c for c in odds.columns if c != key][0]
    if not j.where(F.col(s).isNull() | F.col(o).isNull()).isEmpty():
        raise ValueError("names differ")
    return j


def histogram(df: DataFrame, key: list[str], value: str, low: float, high: float, bins: int = 25, log: bool = False) -> DataFrame:
    """(key, bin, left, n, density, above): linear or log10 bins, the last closed on the right; above counts values from the bin on."""
    x = F.log10(value) if log else F.col(value)
    a, b = (math.log10(low), math.log10(high)) if log else (low, high)
    width = (b - a) / bins
    k = F.least(F.floor((x - a) / width), F.lit(bins - 1))
    rows = df.where((x >= a) & (x <= b)).select(*key, k.cast("int").alias("bin"))
    n = rows.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key)
    edge = lambda i: F.pow(F.lit(10.0), i * width + a) if log else i * width + a
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    total = F.sum("n").over(w)
    above = F.sum("n").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    return n.select(*key, "bin", left.alias("left"), "n", (F.col("n") / total / (right - left)).alias("density"), above.alias("above"))


def log_bounds(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.pow(F.lit(10.0), F.floor(F.log10(F.min(value)))).alias("low"), F.pow(F.lit(10.0), F.ceil(F.log10(F.max(value)))).alias("high"))


def bandwidth(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Scott's rule."""
    return df.groupBy(*key).agg((F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("h"))


def kde(df: DataFrame, points: DataFrame, key: list[str], value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(key, x, density): Gaussian kernels at points (one column x, of checked size), mirrored at given bounds."""
    rows = df.join(bandwidth(df, key, value), key).select(*key, F.col(value).alias("_v"), "h")
    j = times(rows, points, MOST_NODES)
    k = lambda m: F.exp(-0.5 * F.pow((F.col("x") - m) / F.col("h"), F.lit(2)))
    total: Column = k(F.col("_v"))
    for edge in (low, high):
        if edge is not None:
            total = total + k(2 * edge - F.col("_v"))
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("x") >= low)
    if high is not None:
        inside = inside & (F.col("x") <= high)
    return j.groupBy(*key, "x").agg(F.avg(F.when(inside, total / (F.col("h") * math.sqrt(2 * math.pi))).otherwise(0.0)).alias("density"))


def kde_tail_probability(df: DataFrame, at: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, tail): integral of the density above x; at: (key, x)."""
    rows = df.join(bandwidth(df, key, value), key).join(at, key)
    return rows.groupBy(*key).agg(F.avg(0.5 * erfc((F.col("x") - F.col(value)) / F.col("h") / math.sqrt(2))).alias("tail"))


def ecdf(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, cdf, survival) for distinct values: counts first, so the window sees distinct values only."""
    n = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key)
    c = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_n").over(w)
    return n.select(*key, value, c.alias("cdf"), (1 - c).alias("survival"))


def rank_of(df: DataFrame, at: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, n_above): background values at or above x."""
    return df.join(at, key).groupBy(*key).agg(F.sum((F.col(value) >= F.col("x")).cast("long")).alias("n_above"))


def sky_cell(ra, dec, rings: int = 8, sectors: int = 16) -> Column:
    """Equal-area cell of the sky: rings in the sine of declination, sectors in right ascension."""
    ring = F.least(F.floor((F.sin(dec) + 1) / 2 * rings), F.lit(rings - 1))
    sector = F.least(F.floor(F.pmod(ra, F.lit(2 * math.pi)) / (2 * math.pi) * sectors), F.lit(sectors - 1))
    return (ring * sectors + sector).cast("int")


def cell_max(df: DataFrame, cell: Column, value: str, cells: DataFrame) -> DataFrame:
    """(cell, top): largest value of each cell; cells without any get the overall minimum less one. cells: one column cell."""
    top = df.groupBy(cell.alias("cell")).agg(F.max(value).alias("top"))
    low = df.agg((F.min(value) - 1).alias("_low"))
    return cells.join(top, "cell", "left").crossJoin(F.broadcast(low)).select("cell", F.coalesce("top", "_low").alias("top"))


def shift_name(n: Column) -> Column:
    """A, B .. Z, AA, AB .. for 0, 1 .. (up to three letters)."""
    letter = lambda k: F.char((F.pmod(k, F.lit(26)) + 65).cast("int"))
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(two)).otherwise(""), letter(n))


def background_positions(sources: DataFrame, n: int, exclusion: float = 0.01, seed: int = 5, oversample: int = 4) -> DataFrame:
    """n isotropic points for each source (name, place, ra, dec): (name, place, ra, dec), named after the source with a letter.

    Points lie in the source's ecliptic hemisphere, outside the exclusion radius around it; ``place`` is
    an integer of the source's own from which its points follow, so the same table gives the same points.
    """
    north = F.asin(F.sin("dec") * math.cos(OBLIQUITY) - F.cos("dec") * F.sin("ra") * math.sin(OBLIQUITY)) >= 0
    # dealt before the fan-out: a short list of sources may come in one partition, and the points needn't shuffle to be ranked
    partitions = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sources.select("name", "place", "ra", "dec").repartition(partitions, "name", "place")
    tries = dealt.withColumn("_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * oversample - 1).cast("long"))))
    own = F.col("_id") + F.pmod(F.col("place"), F.lit(65536)) * 9973
    lon = hash_uniform(own, seed) * (2 * math.pi)
    lat = F.asin(hash_uniform(own * 7919 + 13, seed + 1)) * F.when(north, 1.0).otherwise(-1.0)
    ra, dec = ecliptic_to_equatorial(lon, lat)
    points = tries.select("name", "place", "_id", ra.alias("_ra"), dec.alias("_dec"), angular_separation(ra, dec, "ra", "dec").alias("_far"))
    rank = F.row_number().over(Window.partitionBy("name", "place").orderBy("_id"))
    kept = points.where(F.col("_far") > exclusion).withColumn("_k", rank).where(F.col("_k") <= n)
    return kept.select(F.concat("name", shift_name(F.col("_k") - 1)).alias("name"), "place", F.col("_ra").alias("ra"), F.col("_dec").alias("dec"))


def sky_overlap(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` (ra, dec, ra2, dec2, f0 and others) with ``overlap``: |mean over nodes of exp(2 pi i f0 (delay - delay2))|.

    nodes: (x, y, z) of the detector in light seconds at the live times, evenly spaced; at most ``MOST_NODES``.
    """
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: space them further apart")
    unit = lambda r, d: (F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d))
    part = [a - b for a, b in zip(unit(F.col("ra"), F.col("dec")), unit(F.col("ra2"), F.col("dec2")), strict=True)]
    held = points.withColumns({"_u": part[0], "_v": part[1], "_w": part[2]})
    cycles = F.col("f0") * (F.col("_u") * F.col("x") + F.col("_v") * F.col("y") + F.col("_w") * F.col("z"))
    angle = (cycles - F.floor(cycles)) * (2 * math.pi)
    j = held.crossJoin(F.broadcast(nodes.select("x", "y", "z")))
    n = F.count(F.lit(1))
    sums = j.groupBy(*points.columns).agg(F.sum(F.cos(angle)).alias("_c"), F.sum(F.sin(angle)).alias("_s"), n.alias("_k"))
    return sums.select(*points.columns, (F.hypot("_c", "_s") / F.col("_k")).alias("overlap"))


def distinct_positions(sources: DataFrame, n: int, nodes: DataFrame, overlap: float, exclusion: float = 0.01, seed: int = 5, oversample: int = 2, rounds: int = 12) -> DataFrame:
    """n points for each source (name, ra, dec, f0) whose phase differs: (name, of, k, ra, dec, overlap).

    Points lie in the source's ecliptic hemisphere, further than ``exclusion`` from it, and the
    overlap of their phase with the source's over the nodes is below the limit. Each round draws
    points for the sources that lack some, until all have n; if some lack points after ``rounds``
    rounds it is an error. The same table and seed give the same points; no source gives no row; names are not null and not repeated.
    """
    if not 0 < overlap <= 1:
        raise ValueError("the overlap limit has to lie above 0 and not above 1")
    base = sources.select("name", F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), "f0")
    north = F.asin(F.sin("dec2") * math.cos(OBLIQUITY) - F.cos("dec2") * F.sin("ra2") * math.sin(OBLIQUITY)) >= 0
    lacking, good = base, None
    for r in range(rounds):
        size = n * oversample
        tries = lacking.withColumn("_id", F.explode(F.sequence(F.lit(r * size).cast("long"), F.lit((r + 1) * size - 1).cast("long"))))
        uniform = lambda k: F.pmod(F.xxhash64("name", "_id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
        ra, dec = ecliptic_to_equatorial(uniform(0) * (2 * math.pi), F.asin(uniform(1)) * F.when(north, 1.0).otherwise(-1.0))
        points = tries.withColumns({"ra": ra, "dec": dec}).where(angular_separation("ra", "dec", "ra2", "dec2") > exclusion)
        fine = written(sky_overlap(points, nodes).where(F.col("overlap") < overlap), "positions")
        good = fine if good is None else good.unionByName(fine)
        enough = good.groupBy("name").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= n).select("name")
        lacking = written(base.join(enough, "name", "left_anti"), "lacking")
        if lacking.isEmpty():
            break
    else:
        raise ValueError(f"some sources have fewer than {n} points after {rounds} rounds")
    k = F.row_number().over(Window.partitionBy("name").orderBy("_id")) - 1
    return good.withColumn("k", k.cast("long")).where(F.col("k") < n).select(F.concat("name", shift_name(F.col("k"))).alias("name"), F.col("name").alias("of"), "k", "ra", "dec", "overlap")


def background_study(shifts: DataFrame, odds: DataFrame, on_source: str) -> DataFrame:
    """(n, n_above, tail, kde_tail): how odd the on-source value is among the shifted ones."""
    j = join_background(shifts, odds)
    off = j.where(F.col("name") != on_source).select("odds")
    on = j.where(F.col("name") == on_source).agg(F.first("odds").alias("x"))
    width = off.agg((F.stddev_samp("odds") * F.pow(F.count("odds"), F.lit(-0.2))).alias("h"))
    # both are one row, so the shifted ones stay where they are
    rows = off.crossJoin(F.broadcast(on)).crossJoin(F.broadcast(width))
    n, above = F.count(F.lit(1)), F.sum((F.col("odds") >= F.col("x")).cast("long"))
    tail = F.avg(0.5 * erfc((F.col("x") - F.col("odds")) / F.col("h") / math.sqrt(2)))
    return rows.agg(n.alias("n"), above.alias("n_above"), (above / n).alias("tail"), tail.alias("kde_tail"))
