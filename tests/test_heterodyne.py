"""The fan-out stage, its filter and the second stage, against plain loops over samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.operators import filters, phase, series

SRC = "source string, f0 double, f1 double, epoch double"
SEG = "detector string, start double, end double"


def plain(x, b, a, compat=False):
    y, z = phase.filter_run(x, b, a)
    y, _ = phase.filter_run(y[::-1], b, a, z if compat else None)
    return y[::-1]


@pytest.mark.parametrize("knee,rate,order", [(0.05, 1.0, 9), (0.5, 16.0, 9), (3.0, 16.0, 4), (0.2, 1.0, 1)])
def test_blocks_equal_the_loop(knee, rate, order):
    rng = np.random.default_rng(2)
    b, a = phase.butterworth(knee, rate, order)
    f = filters.BlockFilter(b, a)
    for n in (1, 5, 63, 64, 65, 640, 1000):
        x = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
        y, z = f.run(x, x[:, :1] * f.steady)
        for k in range(2):
            want, end = phase.filter_run(x[k], b, a)
            assert np.abs(y[k] - want).max() < 1e-10 and np.abs(z[k] - end.ravel()).max() < 1e-10 * max(1, np.abs(end).max())
        assert np.allclose(f.end(x) + (x[:, :1] * f.steady) @ f.over(n).T, z, atol=1e-9)


@pytest.mark.parametrize("compat", [False, True])
def test_a_run_in_pieces_equals_the_whole(spark, compat):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    b, a = phase.butterworth(0.06, 1.0)
    for det, spans in (("H1", [(100, 1300), (1400, 1450)]), ("L1", [(0, 1)])):
        for run, (lo, hi) in enumerate(spans, 1):
            x = rng.normal(size=hi - lo) + 1j * rng.normal(size=hi - lo)
            rows += [(det, run, float(t), float(v.real), float(v.imag)) for t, v in zip(range(lo, hi), x)]
            want |= dict(zip([(det, float(t)) for t in range(lo, hi)], plain(x, b, a, compat)))
    df = spark.createDataFrame(rows, "detector string, run long, t double, re double, im double").repartition(5)
    for piece in (100, 4096):
        got = {(r["detector"], r["t"]): complex(r["re"], r["im"]) for r in phase.low_pass(df, 0.06, 1.0, ["detector"], piece=piece, compat=compat).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-10
    assert phase.low_pass(df.limit(0), 0.06, 1.0, ["detector"]).count() == 0


def brute(raw, sources, segments, rate, resample, knee, crop, factor=1.0):
    """The stage for one source and one run after the other."""
    b, a = phase.butterworth(knee, rate)
    m, out = round(rate / resample), {}
    for name, f0, f1, epoch in sources:
        for det in {r[0] for r in raw}:
            s = sorted((t, x) for d, t, x in raw if d == det and any(g == det and lo <= t < hi for g, lo, hi in segments))
            runs = np.split(np.arange(len(s)), np.flatnonzero(np.diff([t for t, _ in s]) > 1.5 / rate) + 1)
            for run in runs:
                if not len(run):
                    continue
                t, x = (np.array([s[i][k] for i in run]) for k in (0, 1))
                dt = t - (epoch or 0)
                y = plain(x * np.exp(-2j * np.pi * np.mod(factor * ((f0 or 0) * dt + (f1 or 0) * dt**2 / 2), 1)), b, a)
                ok = (t >= t[0] + crop) & (t < t[-1] + 1 / rate - crop)
                t, y = t[ok], y[ok]
                for k in range(len(t) // m):
                    cut = slice(k * m, k * m + m)
                    out[name, det, round(t[cut].mean() + 0.5 / rate, 6)] = y[cut].mean()
    return out


def test_fan_out_equals_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(7)
    raw = [(d, t / 4, float(rng.normal())) for d, spans in (("H1", [(0, 900), (1000, 1500)]), ("L1", [(40, 700)])) for lo, hi in spans for t in range(lo, hi)]
    sources = [("p", 0.21, -1e-5, 3.0), ("q", 1.7, 2e-6, -1000.5), ("r", None, None, None)]
    segments = [("H1", 10.0, 370.0), ("H1", 370.0, 372.0), ("L1", 0.0, 90.0), ("L1", 95.0, 400.0)]
    df = spark.createDataFrame(raw, "detector string, t double, x double").withColumn("source", F.lit("own")).repartition(7)
    src, seg = spark.createDataFrame(sources, SRC), spark.createDataFrame(segments, SEG)
    for factor, piece, slices in ((1.0, 1 << 16, 20_000), (2.0, 128, 1)):
        monkeypatch.setattr(phase, "SLICE_SOURCES", slices)
        monkeypatch.setattr(filters, "AT_ONCE", piece)
        got = {(r["source"], r["detector"], round(r["t"], 6)): complex(r["re"], r["im"]) for r in phase.heterodyne(df, src, seg, 4.0, 0.5, 0.3, crop=6, freqfactor=factor, piece=piece).collect()}
        want = brute(raw, sources, segments, 4.0, 0.5, 0.3, 6, factor)
        assert got.keys() == want.keys() and len(want) > 300 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    none = [phase.heterodyne(a, b, c, 4.0, 0.5, 0.3, crop=6).count() for a, b, c in ((df.limit(0), src, seg), (df, src.limit(0), seg), (df, src, seg.limit(0)))]
    assert none == [0, 0, 0]
    for wrong in ((4.0, 0.3, 0.3, 6), (4.0, 8.0, 0.3, 6), (4.0, 0.5, 2.5, 6), (4.0, 0.5, 0.3, -1)):
        with pytest.raises(ValueError):
            phase.heterodyne(df, src, seg, *wrong[:3], crop=wrong[3])


def test_two_stages_equal_one(spark):
    """A carrier that reaches the detector with a slowly changing delay."""
    f0, f1, epoch, n = 2.31, -3e-8, 500.0, 6000
    delay = lambda t: 3.0 + 2e-3 * t + 1e-7 * t * t
    t = np.arange(4 * n) / 4.0
    u = t + delay(t) - epoch
    x = np.cos(2 * np.pi * np.mod(f0 * u + f1 * u * u / 2, 1))
    raw = spark.createDataFrame([("H1", float(a), float(v)) for a, v in zip(t, x)], "detector string, t double, x double")
    src = spark.createDataFrame([("p", f0, f1, epoch)], SRC)
    seg = spark.createDataFrame([("H1", 0.0, float(n))], SEG)
    nodes = spark.createDataFrame([("p", "H1", k, float(delay(60.0 * k))) for k in range(-2, n // 60 + 4)], "source string, detector string, k int, y double")
    out = phase.two_stage(raw, src, seg, nodes, 4.0, 1.0, 1 / 60, knee=0.4, crop=60.0).collect()
    # one stage: the full phase at once, then the same filter and means
    b, a = phase.butterworth(0.4, 4.0)
    y = plain(x * np.exp(-2j * np.pi * np.mod(f0 * u + f1 * u * u / 2, 1)), b, a)[240 : 4 * (n - 60)]
    want = y[: len(y) // 240 * 240].reshape(-1, 240).mean(1)
    got = [complex(r["re"], r["im"]) for r in sorted(out, key=lambda r: r["t"])]
    assert len(got) == len(want) and np.abs(np.array(got) - want).max() < 2e-4 and abs(np.mean(got) - 0.5) < 1e-4


def test_phase_from_two_sets(spark):
    old, new = [("p", 12.25, -1e-9, 9.0e8), ("q", 3.0, None, None)], [("p", 12.2501, -2e-9, 9.5e8), ("z", 1.0, 0.0, 0.0)]
    a, b = spark.createDataFrame(old, SRC), spark.createDataFrame(new, SRC)
    t = [1.0e9 + 977.0 * k for k in range(200)]
    rows = spark.createDataFrame([("p", v, 120.0 + 1e-7 * (v - 1e9), 121.5) for v in t], "source string, t double, was double, now double")
    from fractions import Fraction as Q

    def cycles(p, v):
        dt = Q(v) - Q(p[3])
        return Q(p[1]) * dt + Q(p[2]) * dt * dt / 2

    for factor in (1.0, 2.0):
        got = rows.join(phase.phase_polynomials(a, b, 2, factor), "source").select("t", "was", "now", phase.phase_difference("t", 2, "was", "now").alias("c")).collect()
        assert len(got) == 200
        for r in got:
            want = Q(factor) * (cycles(new[0], Q(r["t"]) + Q(r["now"])) - cycles(old[0], Q(r["t"]) + Q(r["was"])))
            assert abs(math.remainder(r["c"] - float(want % 1), 1.0)) < 2e-5
    with pytest.raises(ValueError, match="factor"):
        phase.phase_polynomials(a.withColumn("freqfactor", F.lit(1.0)), b, 2, 2.0)
    coarse = spark.createDataFrame([], "source string, detector string, t double, re double, im double")
    assert phase.second_stage(coarse, a, b, 1.0, 0.1, knee=0.2).count() == 0


def test_places_and_runs_in_stretches(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(t)) for s in ("a", "b", None) for t in np.cumsum(rng.choice([1.0, 1.0, 1.0, 7.0, 400.0], 500))]
    df = spark.createDataFrame(rows, "source string, t double").repartition(3)
    whole = sorted(map(tuple, series.contiguous_runs(df, 1.5, ["source"]).collect()), key=str)
    for width in (3, 50, 1e6):
        got = series.contiguous_runs(df, 1.5, ["source"], width=width).drop("bucket")
        assert sorted(map(tuple, got.collect()), key=str) == whole
    places = {}
    for r in series.placed(df, ["source"], [], 50).collect():
        places.setdefault(r["source"], []).append((r["place"], r["t"]))
    assert all([p for p, _ in sorted(v)] == list(range(500)) and sorted(v) == sorted(v, key=lambda x: x[1]) for v in places.values())
