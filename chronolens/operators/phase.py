"""Rotating, filtering and averaging: from raw samples to reduced complex series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ARMS, SIDEREAL_DAY, antenna_pattern, col, complex_rotate, phase_cycles
from . import filters
from .segments import samples_in_segments
from .series import contiguous_runs, placed
from .slices import slices_of, times
from .storage import written

BINS = 2880


def response_table(spark: SparkSession, sources: DataFrame, detectors: list[str], bins: int = BINS) -> DataFrame:
    """(source, detector, bin, fp, fc, fp1, fc1): the response over a sidereal day, with the next bin's value beside each."""
    grid = sources.select("source", "ra", "dec").join(spark.range(bins).withColumnRenamed("id", "bin"))
    angle = lambda b: b * (2 * math.pi / bins)
    out = None
    for d in detectors:
        (p0, c0), (p1, c1) = (antenna_pattern(angle(x), "ra", "dec", d) for x in (F.col("bin"), F.col("bin") + 1))
        part = grid.select("source", F.lit(d).alias("detector"), "bin", p0.alias("fp"), c0.alias("fc"), p1.alias("fp1"), c1.alias("fc1"))
        out = part if out is None else out.unionByName(part)
    return out


def join_response(df: DataFrame, response: DataFrame, t0: float, bins: int = BINS, key=("source", "detector"), parts=("fp", "fc")) -> DataFrame:
    """Periodic linear interpolation of the response at (t - t0) mod a sidereal day; an equi-join on the bin.

    A sample without a response keeps its row, with null parts.
    """
    x = F.pmod(F.col("t") - t0, F.lit(SIDEREAL_DAY)) * (bins / SIDEREAL_DAY)
    rows = df.withColumn("_x", x).withColumn("bin", F.least(F.floor("_x"), F.lit(bins - 1)))
    j = rows.join(response, [*key, "bin"], "left")
    blend = lambda p: F.col(p) + (F.col("_x") - F.col("bin")) * (F.col(f"{p}1") - F.col(p))
    return j.select(*df.columns, *[blend(p).alias(p) for p in parts])


def attach_response(df: DataFrame, sources: DataFrame, detectors: list[str], t0: float, bins: int = BINS) -> DataFrame:
    """Rows (source, t, ..) once for each detector with fp and fc, as :func:`join_response` takes them from :func:`response_table`.

    Only the two bins beside each sample are worked out, in its row, so nothing grows with sources x
    bins: for samples fewer than these. Rows of unknown sources keep null parts.
    """
    x = F.pmod(F.col("t") - t0, F.lit(SIDEREAL_DAY)) * (bins / SIDEREAL_DAY)
    rows = df.withColumn("_x", x).withColumn("bin", F.least(F.floor("_x"), F.lit(bins - 1)))
    dec = F.col("dec").cast("double")
    place = sources.select("source", F.col("ra").cast("double").alias("_ra"), F.sin(dec).alias("_sd"), F.cos(dec).alias("_cd"))
    turned = rows.join(place, "source", "left").withColumn("_w", F.col("_x") - F.col("bin"))
    angle = lambda b: b * (2 * math.pi / bins) - F.col("_ra")
    turned = turned.withColumns({f"_{n}{k}": f(angle(F.col("bin") + k)) for k in (0, 1) for n, f in (("s", F.sin), ("c", F.cos))})
    # the wave's tensor is the same for all detectors and blends as the responses do
    parts = {}
    for k in (0, 1):
        s, c, sd, cd = F.col(f"_s{k}"), F.col(f"_c{k}"), F.col("_sd"), F.col("_cd")
        u, v = (-s, -c, F.lit(0.0)), (-c * sd, s * sd, cd)
        for i in range(3):
            for j in range(i, 3):
                parts[f"_p{i}{j}", k], parts[f"_q{i}{j}", k] = u[i] * u[j] - v[i] * v[j], u[i] * v[j] + v[i] * u[j]
    names = sorted({n for n, _ in parts})
    blended = turned.select(*df.columns, *[(parts[n, 0] + F.col("_w") * (parts[n, 1] - parts[n, 0])).alias(n) for n in names])
    each = []
    for d in detectors:
        a, b = ARMS[d]
        weight = {(i, j): 0.5 * (a[i] * a[j] - b[i] * b[j]) * (1 if i == j else 2) for i in range(3) for j in range(i, 3)}
        plus, cross = (sum((F.lit(w) * F.col(f"_{n}{i}{j}") for (i, j), w in weight.items()), F.lit(0.0)) for n in "pq")
        each.append(F.struct(F.lit(d).alias("detector"), plus.alias("fp"), cross.alias("fc")))
    return blended.select(*df.columns, F.inline(F.array(*each)))


def node_stencils(nodes: DataFrame, key: list[str], value: str = "y") -> DataFrame:
    """Each node (key, k, value) with its four-point stencil y0..y3 (nodes k-1..k+2); stencils at the ends are shifted inside."""
    w = Window.partitionBy(*key).orderBy("k")
    at = lambda i: (F.lead if i >= 0 else F.lag)(value, abs(i)).over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    first = F.greatest(F.lit(0), F.least(F.col("_r") - 1, F.col("_n") - 4))
    rows = nodes.select(*key, "k", F.col(value).alias(value), (F.row_number().over(w) - 1).alias("_r"), n.alias("_n")).withColumn("_o", first - F.col("_r"))
    stencil = [F.coalesce(*[F.when(F.col("_o") + j == i, at(i)) for i in range(-3, 4)]) for j in range(4)]
    return rows.select(*key, "k", (F.col("k") + F.col("_o")).alias("k0"), *[s.alias(f"y{j}") for j, s in enumerate(stencil)])


def join_delay_nodes(df: DataFrame, nodes: DataFrame, t0, step, key: list[str], value: str = "y", out: str = "delay") -> DataFrame:
    """Cubic Lagrange interpolation of node values (at t0 + k * step) at every sample; an equi-join on the node index.

    A sample beyond the nodes keeps its row, with a null delay. Columns of ``df`` whose names begin with _n_ are not allowed.
    """
    return join_stencils(df, node_stencils(nodes, key, value), t0, step, key, out)


def join_stencils(df: DataFrame, stencils: DataFrame, t0, step, key: list[str], out: str = "delay", few: bool = False) -> DataFrame:
    """As :func:`join_delay_nodes`, from :func:`node_stencils`, which are broadcast if they are ``few``."""
    st = stencils.select(*key, F.col("k").alias("_n_k"), F.col("k0").alias("_n_k0"), *[F.col(f"y{i}").alias(f"_n_y{i}") for i in range(4)])
    k = F.floor((F.col("t") - t0) / step)
    x = (F.col("t") - t0) / step - F.col("_n_k0")
    terms = []
    for i in range(4):
        c = F.lit(1.0)
        for j in range(4):
            if i != j:
                c = c * (x - j) / (i - j)
        terms.append(c * F.col(f"_n_y{i}"))
    return df.withColumn("_n_k", k).join(F.broadcast(st) if few else st, [*key, "_n_k"], "left").select(*df.columns, sum(terms[1:], terms[0]).alias(out))


#: Sources are broadcast up to so many rows; longer lists take a pass for each slice.
BROADCAST_SOURCES = 100_000


def attach_source(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Every raw row for every source: the fan-out of the engine, over a source list of checked size."""
    return times(raw, sources, BROADCAST_SOURCES)


def attached_sums(raw: DataFrame, sources: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of :func:`attach_source` counted (``n``) and summed in advance: one for each key of the raw rows and source.

    For sums of products of a raw value and a source's term: raw rows meet no source one by one, so
    the work is that of reading them plus one row for each key and source.
    """
    sums = raw.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])
    return attach_source(sums, sources)


def block_average(df: DataFrame, samples: int, gap, key: list[str], factor: float = 1.0, width=None) -> DataFrame:
    """Means of blocks of ``samples`` inside each contiguous run; an incomplete last block is dropped.

    With ``width`` runs and places in them are found in stretches of time of that width, with no sort of a whole series.
    """
    runs = contiguous_runs(df, gap, key, width=width)
    if width is None:
        n = F.row_number().over(Window.partitionBy(*key, "run").orderBy("t")) - 1
        blocks = runs.withColumn("block", F.floor(n / samples))
    else:
        blocks = placed(runs, [*key, "run"], [], width).withColumn("block", F.floor(F.col("place") / samples))
    out = blocks.groupBy(*key, "run", "block").agg(F.avg("t").alias("t"), (factor * F.avg("re")).alias("re"), (factor * F.avg("im")).alias("im"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == samples).drop("_n")


def butterworth(knee: float, rate: float, order: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Digital low-pass (numerator, denominator) of second-order and first-order sections by the bilinear transform: [sections, 3]."""
    warp = 2 * rate * math.tan(math.pi * knee / rate)
    b, a = [], []
    for k in range(order // 2):
        theta = math.pi * (2 * k + 1) / (2 * order) + math.pi / 2
        p = warp * complex(math.cos(theta), math.sin(theta))
        z = (2 * rate + p) / (2 * rate - p)
        den = [1.0, -2 * z.real, abs(z) ** 2]
        g = sum(den) / 4
        b.append([g, 2 * g, g]), a.append(den)
    if order % 2:
        z = (2 * rate - warp) / (2 * rate + warp)
        g = (1 - z) / 2
        b.append([g, g, 0.0]), a.append([1.0, -z, 0.0])
    return np.array(b), np.array(a)


def filter_run(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after the other (transposed form II); without a state the steady state of the first sample is taken."""
    y = x.astype(complex)
    out = np.zeros((len(b), 2), complex)
    for s in range(len(b)):
        if state is None:
            gain = b[s].sum() / a[s].sum()
            z2 = b[s, 2] - a[s, 2] * gain
            z1 = b[s, 1] - a[s, 1] * gain + z2
            z = np.array([z1, z2]) * (y[0] if len(y) else 0)
        else:
            z = state[s].copy()
        z1, z2 = complex(z[0]), complex(z[1])
        b0, b1, b2, a1, a2 = b[s, 0], b[s, 1], b[s, 2], a[s, 1], a[s, 2]
        res = np.empty_like(y)
        for i, v in enumerate(y.tolist()):
            o = b0 * v + z1
            z1 = b1 * v - a1 * o + z2
            z2 = b2 * v - a2 * o
            res[i] = o
        y, out[s] = res, (z1, z2)
    return y, out


def low_pass(df: DataFrame, knee: float, rate: float, key: list[str], order: int = 9, piece: int = filters.PIECE, compat: bool = False) -> DataFrame:
    """Butterworth filter forward and backward over each run (key, run, t, re, im); restarts with each contiguous run.

    Runs are cut to pieces of ``piece`` samples that tasks filter apart, with the states carried
    from piece to piece. Other columns are left out.
    """
    return filters.low_pass(df, *butterworth(knee, rate, order), rate, key, piece, compat)


def fir_low_pass(df: DataFrame, taps: list[float], key: list[str]) -> DataFrame:
    """Windowed FIR as a weighted window sum, all in columns; edges keep the taps that reach samples, renormalised."""
    half = len(taps) // 2
    frame = Window.partitionBy(*key, "run").orderBy("t").rowsBetween(-half, len(taps) - 1 - half)
    pos = F.row_number().over(Window.partitionBy(*key, "run").orderBy("t")) - 1
    rows = df.withColumn("_i", pos)
    weights = F.array(*[F.lit(float(x)) for x in taps])

    def conv(c: str) -> Column:
        items = F.collect_list(F.struct("_i", F.col(c).alias("v"))).over(frame)
        w = lambda x: F.get(weights, (x["_i"] - F.col("_i") + half).cast("int"))
        total = F.aggregate(items, F.lit(0.0), lambda s, x: s + w(x) * x["v"])
        return total / F.aggregate(items, F.lit(0.0), lambda s, x: s + w(x))

    return rows.withColumns({"_re": conv("re"), "_im": conv("im")}).withColumns({"re": F.col("_re"), "im": F.col("_im")}).drop("_re", "_im", "_i")


#: Different phases turned in one pass over the raw data; longer lists take further passes.
SLICE_SOURCES = 20_000


def heterodyne(raw: DataFrame, sources: DataFrame, segments: DataFrame, rate: float, resample: float, knee: float, crop: float = 60.0, n_freq: int = 2, order: int = 9, freqfactor: float = 1.0, piece: int = filters.PIECE, compat: bool = False, decimals: int | None = None) -> DataFrame:
    """Raw (detector, t, x) to reduced (source, detector, run, block, t, re, im).

    Segments (detector, start, end) choose the samples; every source (source, f0.., epoch) rotates
    them by ``freqfactor`` times its phase; runs are filtered, cropped at both ends and averaged to
    ``resample``; times are block centres. Raw data shuffle once, to stretches of a run; sources
    are turned inside the tasks, so only means leave them (and filter states of runs longer than a
    stretch). Sources of the same frequencies and epoch are turned once and share the means, which are
    rounded to ``decimals`` before. A null frequency or epoch counts as 0. No source, sample or segment gives no row; a run
    shorter than both crops gives none.
    """
    checked_rates(rate, resample, knee, crop)
    kept = samples_in_segments(raw, segments, ["detector"], 3600)
    rows = kept.select("detector", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"))
    runs = contiguous_runs(rows, 1.5 / rate, ["detector"], width=piece / rate)
    pieces = filters.pieces_of(runs, ["detector"], ["x"], rate, piece)
    terms = [f"f{i}" for i in range(n_freq)]
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    named = sources.select("source", *[zero(c) for c in (*terms, "epoch")])
    sets = written(named.select(*terms, "epoch").distinct(), "phases")
    out = None
    for got in slices_of(sets, SLICE_SOURCES):
        few = got.toPandas()  # SLICE_SOURCES rows at most, about
        held = {"f": freqfactor * few[terms].to_numpy(float).reshape(len(few), n_freq), "epoch": few["epoch"].to_numpy(float)}
        numbered = [(*map(float, r), k) for k, r in enumerate(few.itertuples(index=False))]
        of = F.broadcast(pieces.sparkSession.createDataFrame(numbered, ", ".join([*(f"{c} double" for c in (*terms, "epoch")), "place int"])))
        part = filters.reduced(pieces, held, *butterworth(knee, rate, order), rate, round(rate / resample), crop, compat)
        if decimals is not None:
            part = part.withColumns({c: F.round(c, decimals) for c in ("re", "im")})
        part = shared(part, named.join(of, [*terms, "epoch"]).select("place", "source"), "place")
        out = part if out is None else out.unionByName(part)
    return out.select("source", "detector", "run", "block", "t", "re", "im")


def shared(df: DataFrame, members: DataFrame, by: str) -> DataFrame:
    """Rows of ``df`` (with ``by``) once for each member (``by``, source) of their group; rows stay where they are, members are broadcast in slices.

    A row meets its members as one list and is unfolded from there: joined with them one by one, Spark
    works out its columns (rounding above all) again for each.
    """
    parts = slices_of(members, BROADCAST_SOURCES)
    df = df if len(parts) == 1 else written(df, "shared")
    out = None
    for part in parts:
        lists = part.groupBy(by).agg(F.collect_list(F.struct("source")).alias("_members"))
        j = df.join(F.broadcast(lists), by).drop(by)
        j = j.select(*[c for c in j.columns if c != "_members"], F.inline("_members"))
        out = j if out is None else out.unionByName(j)
    return out


def checked_rates(rate: float, resample: float, knee: float, crop: float) -> None:
    """Errors for rates that don't fit: a block is a whole number of samples, the knee lies below both Nyquist frequencies that matter."""
    if rate <= 0 or resample <= 0 or resample > rate:
        raise ValueError("rates have to be positive, and the reduced one not above that of the raw data")
    if abs(rate / resample - round(rate / resample)) > 1e-9 * rate / resample:
        raise ValueError("the raw rate has to be a whole multiple of the reduced one")
    if not 0 < knee < rate / 2:
        raise ValueError("the knee has to lie between 0 and half the raw rate")
    if crop < 0:
        raise ValueError("crop can't be negative")


def reheterodyne(series: DataFrame, phase_difference: Column, segments: DataFrame | None, samples: int, gap, key: list[str], width: int = 3600, runs_width=None) -> DataFrame:
    """Rotate a reduced series by a phase difference (cycles), restrict it to segments and average blocks.

    ``runs_width``: work on the series in stretches of that width of time, so that no task sorts a whole series.
    """
    rows = samples_in_segments(series, segments, key, width) if segments is not None else series
    re, im = complex_rotate("re", "im", phase_difference)
    turned = rows.select(*key, "t", re.alias("re"), im.alias("im"))
    return block_average(turned, samples, gap, key, width=runs_width)


def phase_polynomials(old: DataFrame, new: DataFrame, n_freq: int = 2, freqfactor: float = 1.0) -> DataFrame:
    """Two parameter sets (source, f0.., epoch[, freqfactor]) as one polynomial of their phase difference.

    Returns source, epoch (of the new set), turn (the difference at that epoch, in cycles) and for
    each term the old frequency moved to that epoch (``o0``..) and the difference (``d0``..), all
    times the frequency factor. The old set's phase is moved with split seconds. A source that only one set
    has is left out; a null term or epoch counts as 0; a set that was turned with another factor is a ValueError.
    """
    for df in (old, new):
        if "freqfactor" in df.columns and not df.where(~F.col("freqfactor").eqNullSafe(F.lit(float(freqfactor)))).isEmpty():
            raise ValueError("the parameter sets have another frequency factor")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    a = old.select("source", *[zero(f"f{i}").alias(f"_a{i}") for i in range(n_freq)], zero("epoch").alias("_a"))
    b = new.select("source", *[zero(f"f{i}").alias(f"_b{i}") for i in range(n_freq)], zero("epoch").alias("epoch"))
    j = a.join(b, "source")
    shift = F.col("epoch") - F.col("_a")
    moved = [sum((F.col(f"_a{m}") * F.pow(shift, F.lit(m - n)) / math.factorial(m - n) for m in range(n, n_freq)), F.lit(0.0)) for n in range(n_freq)]
    turn = phase_cycles("epoch", [f"_a{i}" for i in range(n_freq)], "_a", factor=freqfactor)
    terms = [(freqfactor * m).alias(f"o{n}") for n, m in enumerate(moved)] + [(freqfactor * (F.col(f"_b{n}") - m)).alias(f"d{n}") for n, m in enumerate(moved)]
    return j.select("source", "epoch", (-turn).alias("turn"), *terms)


def phase_difference(t, n_freq: int = 2, old_delay=None, new_delay=None) -> Column:
    """Cycles of the new less the old phase at ``t`` for rows joined with :func:`phase_polynomials`; delays are seconds added to the time."""
    zero = F.lit(0.0)
    was, now = (col(d) if d is not None else zero for d in (old_delay, new_delay))
    difference = phase_cycles(t, [f"d{n}" for n in range(n_freq)], "epoch", now)
    since, later, moved = col(t) - F.col("epoch") + was, now - was, zero
    for n in range(n_freq):  # the old polynomial over the change of delay, without the large terms that cancel
        for k in range(1, n + 2):
            moved = moved + F.col(f"o{n}") * F.pow(since, F.lit(n + 1 - k)) * F.pow(later, F.lit(k)) / (math.factorial(k) * math.factorial(n + 1 - k))
    return F.col("turn") + difference + (moved - F.floor(moved))


def second_stage(coarse: DataFrame, old: DataFrame, new: DataFrame, rate: float, resample: float, segments: DataFrame | None = None, nodes: DataFrame | None = None, old_nodes: DataFrame | None = None,
                 node_t0: float = 0.0, node_step: float = 60.0, n_freq: int = 2, freqfactor: float = 1.0, knee: float | None = None, runs_width: float = 86400.0, shift: float = 0.0) -> DataFrame:
    """Reduced (source, detector, t, re, im) at ``rate`` from one parameter set to another, averaged to ``resample``.

    ``nodes`` (source, detector, k, y) give the delays of the new phase, ``old_nodes`` those that
    the first stage used already; samples beyond their nodes are left out. With ``knee`` each run
    is low-passed before it is averaged. ``shift``: seconds from the mean time of a mean's raw samples to
    its stated time (half a raw sample if blocks are stated by their centre); phases are taken at the former. Sources that a set doesn't have are left out; an empty series gives no row.
    """
    checked_rates(rate, resample, rate / 4 if knee is None else knee, 0.0)
    key = ["source", "detector"]
    rows = samples_in_segments(coarse, segments, ["detector"], 3600) if segments is not None else coarse
    rows = rows.select(*key, (F.col("t").cast("double") - shift).alias("t"), "re", "im")
    for name, table in (("_new", nodes), ("_old", old_nodes)):
        if table is not None:
            rows = join_delay_nodes(rows, table, node_t0, node_step, key, out=name).where(F.col(name).isNotNull())
    polynomials = phase_polynomials(old, new, n_freq, freqfactor)
    cycles = phase_difference("t", n_freq, "_old" if old_nodes is not None else None, "_new" if nodes is not None else None)
    re, im = complex_rotate("re", "im", cycles)
    turned = rows.join(polynomials, "source").select(*key, "t", re.alias("re"), im.alias("im"))
    if knee is not None:
        turned = low_pass(contiguous_runs(turned, 1.5 / rate, key, width=runs_width).drop("bucket"), knee, rate, key).drop("run")
    return block_average(turned, round(rate / resample), 1.5 / rate, key, width=runs_width).withColumn("t", F.col("t") + shift)


def two_stage(raw: DataFrame, sources: DataFrame, segments: DataFrame, nodes: DataFrame, rate: float, first: float = 1.0, second: float = 1 / 60, node_t0: float = 0.0, node_step: float = 60.0,
              knee: float = 0.5, second_knee: float | None = None, n_freq: int = 2, freqfactor: float = 1.0, decimals: int | None = None, **more) -> DataFrame:
    """Stage one without delays at ``first`` Hz, written to the shared folder; stage two adds the delay nodes' phase and averages to ``second`` Hz.

    Sources with the same phase and the same delay nodes go through both stages once and share the
    means, rounded to ``decimals`` before. Sources without a name or nodes give no row. With
    ``second_knee`` stage two is :func:`second_stage`, else :func:`means_of_spans`, with the same results.
    """
    terms = [f"f{i}" for i in range(n_freq)]
    nodes = nodes.where("source is not null")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    known = sources.where("source is not null").select("source", *[zero(c) for c in (*terms, "epoch")]).join(marked(nodes, "detector", "k", F.col("y").cast("double")), "source")
    same_of = [*terms, "epoch", *MARKS]
    members = written(known.join(known.groupBy(*same_of).agg(F.min("source").alias("like")), same_of).select("source", "like", *terms, "epoch"), "alike")
    heads = members.where("source = like").drop("like").distinct()
    few = heads.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    own = heads.select("source")
    nodes = nodes.join(F.broadcast(own) if few else own, "source", "left_semi")
    stage = heterodyne(raw, heads, segments, rate, first, knee, n_freq=n_freq, freqfactor=freqfactor, **more)
    shift = 0.5 / rate
    if second_knee is not None:
        coarse = written(stage.drop("run", "block"), "stage-1")
        out = second_stage(coarse, heads, heads, first, second, nodes=nodes, node_t0=node_t0, node_step=node_step, n_freq=n_freq, freqfactor=freqfactor, knee=second_knee, shift=shift)
    else:
        coarse = written(stage.select("source", "detector", F.col("run").alias("first_run"), F.col("block").alias("at"), (F.col("t") - shift).alias("t"), "re", "im"), "stage-1")
        out = means_of_spans(coarse, heads, nodes, first, second, node_t0, node_step, n_freq, freqfactor).withColumn("t", F.col("t") + shift)
    if decimals is not None:
        out = out.withColumns({c: F.round(c, decimals) for c in ("re", "im")})
    return shared(out.withColumnRenamed("source", "like"), members.select("like", "source"), "like").select("source", *[c for c in out.columns if c != "source"])


#: A set of rows as their number and 128 bits of hashes: their order and place don't matter.
MARKS = ["_n", "_h1", "_h2"]


def marked(rows: DataFrame, *columns) -> DataFrame:
    """(source, MARKS) of the set of rows (``columns``) that each source has."""
    mark = lambda seed: F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.sum(mark(1)).alias("_h1"), F.sum(mark(2)).alias("_h2"))


#: Spans of blocks and stencils of delay nodes that are broadcast, at most; more are joined.
BROADCAST_ROWS = 1_000_000


def means_of_spans(coarse: DataFrame, heads: DataFrame, nodes: DataFrame, rate: float, resample: float, node_t0: float, node_step: float, n_freq: int, freqfactor: float, width: float = 86400.0) -> DataFrame:
    """:func:`second_stage` without a filter for a series (source, detector, first_run, at, t, re, im) in which all sources have the same blocks ``at``, of the same runs.

    Runs and places in them follow from times and from where a source has delays. They are
    found once for all sources whose nodes lie at the same times, as spans of a first run: blocks
    first to last, with ``ahead`` to add for the place. The rows of the sources are turned and
    averaged where they lie, with no window over them; only partial means shuffle.
    """
    checked_rates(rate, resample, rate / 4, 0.0)
    samples, key = round(rate / resample), ["source", "detector"]
    stencils = written(node_stencils(nodes, key), "stencils")
    full = stencils.where(" and ".join(f"y{i} is not null" for i in range(4)))
    covers = marked(full, "detector", "k")
    covers = written(covers.join(covers.groupBy(*MARKS).agg(F.min("source").alias("cover")), MARKS).select("source", "cover"), "covers")
    kinds = full.join(covers.where("source = cover"), "source").select("cover", "detector", F.col("k").alias("_n_k"))
    one = coarse.join(F.broadcast(heads.agg(F.min("source").alias("source"))), "source", "left_semi").select("detector", "first_run", "at", "t")
    places = one.withColumn("_n_k", F.floor((F.col("t") - node_t0) / node_step)).join(kinds, ["detector", "_n_k"]).drop("_n_k")
    runs = contiguous_runs(places, 1.5 / rate, ["cover", "detector"], width=width).drop("bucket")
    numbered = placed(runs, ["cover", "detector", "run"], [], width).withColumn("ahead", F.col("place") - F.col("at"))
    spans = written(numbered.groupBy("cover", "detector", "first_run", "run", "ahead").agg(F.min("at").alias("first"), F.max("at").alias("last")), "spans")
    small = lambda df, most: F.broadcast(df) if df.limit(most + 1).count() <= most else df
    # means are few for each source beside what they go out to: sources of the same phase and delays
    tasks = filters.TASKS_A_CORE * coarse.sparkSession.sparkContext.defaultParallelism
    rows = join_stencils(coarse, stencils, node_t0, node_step, key, few=stencils.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS).where(F.col("delay").isNotNull())
    rows = rows.join(small(phase_polynomials(heads, heads, n_freq, freqfactor), BROADCAST_SOURCES), "source")
    re, im = complex_rotate("re", "im", phase_difference("t", n_freq, None, "delay"))
    turned = rows.select(*key, "first_run", "at", "t", re.alias("re"), im.alias("im")).join(small(covers, BROADCAST_SOURCES), "source")
    met = turned.join(small(spans, BROADCAST_ROWS), ["cover", "detector", "first_run"]).where("at between first and last")
    met = met.withColumn("block", F.floor((F.col("at") + F.col("ahead")) / samples))
    out = met.groupBy(*key, "run", "block").agg(*[F.avg(c).alias(c) for c in ("t", "re", "im")], F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == samples).drop("_n").repartition(tasks, *key, "run", "block")
