"""Edge rules by hand, invariants, files and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.functions import registry, scalar
from chronolens.operators import changepoints, clean, infer, phase, segments, series
from chronolens.sources import files
from chronolens.streaming import stream


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_special_functions(spark):
    for x in (0.5, 1.0, 4.5, 60.0):
        assert abs(value(spark, scalar.ln_gamma(F.lit(x))) - math.lgamma(x)) < 1e-9
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        assert abs(value(spark, scalar.erfc(F.lit(x))) - math.erfc(x)) < 3e-7


def test_gps_times(spark):
    assert value(spark, scalar.to_gps(F.lit("2017-01-01 00:00:00"))) == 1167264018
    assert value(spark, scalar.to_gps(F.lit("1000000000"))) == 1000000000
    assert value(spark, scalar.gps_to_unix(scalar.unix_to_gps(F.lit(1700000000)))) == 1700000000


def test_running_median_mirrors_edges(spark):
    x = [5.0, 1.0, 9.0, 3.0, 7.0]
    df = spark.createDataFrame([("s", "H1", float(i), v, -v) for i, v in enumerate(x)], "source string, detector string, t double, re double, im double")
    got = [r["med_re"] for r in series.running_median(df, 3).orderBy("t").collect()]
    padded = [1.0, *x, 3.0]
    assert got == [float(np.median(padded[i : i + 3])) for i in range(5)]
    with pytest.raises(ValueError):
        series.running_median(df, 1)


def test_change_point_between_two_variances(spark):
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(0, 1, (720, 2)), rng.normal(0, 50, (720, 2))])
    df = spark.createDataFrame([("s", float(i), float(a), float(b)) for i, (a, b) in enumerate(z)], "source string, t double, re double, im double")
    out = changepoints.change_points(df, ["source"], ["t"], 50.0).groupBy("chunk_start").count().orderBy("chunk_start").collect()
    assert [r["chunk_start"] for r in out][0] == 0 and any(718 <= r["chunk_start"] <= 722 for r in out)
    cut = changepoints.change_points(df, ["source"], ["t"], 50.0, maxlength=360)
    assert cut.agg(F.max("n")).first()[0] <= 360
    assert cut.count() == 1440


def test_segments_partition_the_line(spark):
    a = spark.createDataFrame([("H1", 0, 10), ("H1", 20, 40)], "d string, start long, end long")
    b = spark.createDataFrame([("H1", 5, 25), ("H1", 30, 32)], "d string, start long, end long")
    both, less = segments.intersect_segments(a, b, ["d"], 7), segments.subtract_segments(a, b, ["d"])
    assert sorted((r["start"], r["end"]) for r in both.collect()) == [(5, 10), (20, 25), (30, 32)]
    again = segments.union_segments(both, less, ["d"])
    assert sorted((r["start"], r["end"]) for r in again.collect()) == [(0, 10), (20, 40)]


def test_merge_refuses_overlap(spark):
    a = spark.createDataFrame([("s", "H1", 0.0, 1.0, 1.0), ("s", "H1", 9.0, 1.0, 1.0)], "source string, detector string, t double, re double, im double")
    b = a.withColumn("t", F.col("t") + 5)
    with pytest.raises(ValueError):
        series.merge_series(a, b)
    assert series.merge_series(a, a.withColumn("t", F.col("t") + 10)).count() == 4


def test_zero_amplitude_is_noise(spark):
    rows = [("H1", i % 3, float(i % 5), float(i % 7), 0.5, 0.25 * (i % 2)) for i in range(60)]
    p = infer.chunk_products(spark.createDataFrame(rows, "detector string, chunk int, re double, im double, fp double, fc double"), ["detector", "chunk"])
    zero = spark.createDataFrame([(0.0,) * 4], "a_fp_re double, a_fp_im double, a_fc_re double, a_fc_im double").withColumn("g", F.lit(1))
    a = infer.log_likelihood(zero, p, ["detector"], ["g"]).first()["ln_like"]
    assert abs(a - infer.noise_log_evidence(p, ["detector"]).first()["ln_z_noise"]) < 1e-9


def test_low_pass_keeps_a_slow_tone():
    b, a = phase.butterworth(0.05, 1.0)
    t = np.arange(400)
    slow, fast = np.exp(2j * np.pi * 0.005 * t), np.exp(2j * np.pi * 0.3 * t)
    y, _ = phase.filter_run(slow + fast, b, a)
    assert abs(np.abs(y[200:]) - 1).max() < 0.02


def test_two_stage_removes_the_carrier(spark):
    t = np.arange(4096)
    x = np.cos(2 * np.pi * 0.21 * t)
    raw = spark.createDataFrame([("H1", float(i), float(v)) for i, v in zip(t, x)], "detector string, t double, x double")
    src = spark.createDataFrame([("p", 0.21, 0.0, 0.0)], "source string, f0 double, f1 double, epoch double")
    seg = spark.createDataFrame([("H1", 0.0, 4096.0)], "detector string, start double, end double")
    out = phase.heterodyne(raw, src, seg, 1.0, 1 / 16, 0.05, crop=64, n_freq=2)
    re = [r["re"] for r in out.collect()]
    assert len(re) == (4096 - 128) // 16 and abs(np.mean(re) - 0.5) < 0.02


def lattice(spark, times, names=("s",)):
    return spark.createDataFrame([(n, "H1", t, 1.0, 2.0) for n in names for t in times], "source string, detector string, t long, re double, im double")


def test_zero_pad_takes_its_step_and_refuses_other_times(spark):
    got = sorted(r["t"] for r in series.zero_pad(lattice(spark, [0, 4, 10])).collect())
    assert got == [0, 2, 4, 6, 8, 10]
    with pytest.raises(Exception, match="off the grid"):
        series.zero_pad(lattice(spark, [0, 4, 10]), 4).collect()


def test_three_kinds_of_runs(spark):
    df = lattice(spark, [0, 2, 4, 5, 7, 20])
    bounds = lambda d: sorted((r["start"], r["end"]) for r in d.collect())
    assert bounds(series.run_bounds(df, 2)) == [(0, 7), (20, 20)]
    assert bounds(series.compress_time_segments(df, 2)) == [(0, 4), (5, 7), (20, 20)]
    assert bounds(series.run_segments(df, 2)) == [(-1, 5), (4, 8), (19, 21)]


def chunks_by_hand(p, limit, least):
    """Starts of the chunks of powers p by repeated search for the most likely split of exponential noise."""
    n, best = len(p), []
    for k in range(least, n - least + 1):
        a, b = sum(p[:k]), sum(p[k:])
        best.append(math.lgamma(k) - k * math.log(a) + math.lgamma(n - k) - (n - k) * math.log(b) - math.log(2))
    if not best:
        return [0]
    top = max(best)
    odds = top + math.log(sum(math.exp(s - top) for s in best)) - (math.lgamma(n) - n * math.log(sum(p)))
    if odds <= limit:
        return [0]
    k = least + best.index(top)
    return chunks_by_hand(p[:k], limit, least) + [k + x for x in chunks_by_hand(p[k:], limit, least)]


def test_change_points_by_hand(spark):
    rng = np.random.default_rng(11)
    z = np.concatenate([rng.normal(0, s, (n, 2)) for s, n in ((1, 60), (9, 40), (2, 70))])
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(z)], "source string, t long, re double, im double")
    got = changepoints.change_points(df, ["source"], ["t"], 6.0).select("chunk_start").distinct().collect()
    want = chunks_by_hand((z * z).sum(1).tolist(), 6.0, 5)
    assert sorted(r[0] for r in got) == want and len(want) >= 3


def test_clean_in_order(spark):
    rng = np.random.default_rng(12)
    z = np.concatenate([rng.normal(0, s, (n, 2)) for s, n in ((1, 100), (6, 100))])
    rows = [("s", "H1", 2 * i, float(a), float(b), i) for i, (a, b) in enumerate(z)]
    rows += [("s", "H1", 20, 5e4, 5e4, 900), ("s", "H1", 401, 1e5, 0.0, 901), ("one", "H1", 3, 1.0, 1.0, 902)]
    df = spark.createDataFrame(rows, "source string, detector string, t long, re double, im double, pos int")
    out = clean.clean(df, "pos", thresh=50.0, limit=6.0).collect()
    kept = sorted(r["t"] for r in out if r["source"] == "s")
    assert kept == [2 * i for i in range(200)]  # the repeat of 20 and the outlier at 401 are gone
    assert {r["dt"] for r in out if r["source"] == "s"} == {2} and [r["dt"] for r in out if r["source"] == "one"] == [None]
    starts = sorted({min(r["t"] for r in out if r["source"] == "s" and r["chunk"] == c) for c in {r["chunk"] for r in out if r["source"] == "s"}})
    assert starts[0] == 0 and any(abs(t - 200) <= 6 for t in starts[1:])
    for c in {r["chunk"] for r in out if r["source"] == "s"}:
        own = [v for r in out if r["source"] == "s" and r["chunk"] == c for v in (r["re"], r["im"])]
        assert all(abs(r["var"] - np.var(own, ddof=1)) < 1e-9 * r["var"] and r["n"] == len(own) // 2 for r in out if r["source"] == "s" and r["chunk"] == c)
    assert clean.clean(df.limit(0), "pos").count() == 0


def test_aliases_have_inverses(spark):
    df = spark.createDataFrame([(2.0, -3.0, 9.0)], "F0 double, F1 double, F2 double")
    back = registry.without_alias(registry.with_alias(df, "N_BRAKING").withColumn("F2", F.lit(0.0)), "N_BRAKING").first()
    assert abs(back["F2"] - 9.0) < 1e-12


def test_text_series_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n1 2.5 -1\n2 3 4\n")
    (tmp_path / "b.txt").write_text("% note\n3, 1, 1\n2 9 9\n")
    (tmp_path / "empty.txt").write_text("")
    assert files.read_series_text(spark, str(tmp_path / "a.txt")).where("sigma is null").count() == 2
    assert files.read_comments(spark, str(tmp_path / "a.txt")).first()["comment"] == "note"
    names = [str(tmp_path / n) for n in ("a.txt", "b.txt", "empty.txt", "gone.txt")]
    assert sorted((r["t"], r["re"]) for r in files.read_and_merge(spark, names).collect()) == [(1.0, 2.5), (2.0, 3.0), (3.0, 1.0)]
    assert files.read_and_merge(spark, names[2:]).count() == 0
    (tmp_path / "new one+%").mkdir()
    (tmp_path / "new one+%" / "a.txt").write_text("1 7 7\n5 5 5\n")
    twice = [str(tmp_path / "new one+%" / "a.txt"), names[0]]
    assert sorted((r["t"], r["re"]) for r in files.read_and_merge(spark, twice).collect()) == [(1.0, 7.0), (2.0, 3.0), (5.0, 5.0)]


def test_stream_means_equal_batch_means(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("detector"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    ev.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = stream.stream_block_average(live, ["detector"], "1 day", 2, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = ev.groupBy("detector", F.window("ts", "1 day")).agg(F.avg("re").alias("re"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    got = spark.read.schema("detector string, start long, re double, im double, n long").parquet(str(tmp_path / "out"))
    assert got.count() >= want.count() - 15  # days still open at the end of the stream: those of the watermark's 40 days, at most the last of each detector
    keyed = {(r["detector"], r["s"]): r["re"] for r in want.select("detector", F.unix_micros("window.start").alias("s"), "re").collect()}
    assert all(abs(keyed[r["detector"], r["start"]] - r["re"]) < 1e-9 for r in got.collect())


def test_stream_heterodyne_carries_on(spark, tmp_path):
    t = np.arange(512)
    rows = [("H1", float(i), float(np.cos(2 * np.pi * 0.21 * i))) for i in t]
    raw = spark.createDataFrame(rows, "detector string, t double, x double").withColumn("ts", F.timestamp_seconds("t"))
    src = spark.createDataFrame([("p", 0.21, 0.0)], "source string, f0 double, epoch double")
    for n in range(2):
        raw.where((F.col("t") >= 256 * n) & (F.col("t") < 256 * n + 256)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
        q = stream.stream_heterodyne(live, src, 1.0, 1 / 8, 0.05).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()
    assert len(out) == 64 and abs(np.mean([r["re"] for r in out[16:]]) - 0.5) < 0.03
