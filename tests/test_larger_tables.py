"""Work that has to grow no faster than the tables, with the results of the plain way."""

import math

from pyspark.sql import functions as F

from chronolens.operators import background, filters, phase, population
from chronolens.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_events_are_summed_before_they_meet_sources(spark):
    plan = catalogue.QUERIES["attach_source"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join Cross") :]
    raw = spark.createDataFrame([("a", 1.5), ("a", None), ("b", None), (None, 2.0), ("a", -4.0)], "detector string, re double")
    src = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (None, 5.0)], "source int, f0 double")
    sums = [F.sum("n").alias("n"), F.sum(F.col("re") * F.col("f0")).alias("total")]
    got = phase.attached_sums(raw, src, ["detector"], ["re"]).groupBy("detector", "source").agg(*sums).collect()
    want = phase.attach_source(raw, src).withColumn("n", F.lit(1)).groupBy("detector", "source").agg(*sums).collect()
    assert len(got) == 9 and sorted(map(str, got)) == sorted(map(str, want))


def test_sources_of_a_phase_are_turned_once(spark, monkeypatch):
    turned, reduced = [], filters.reduced
    monkeypatch.setattr(filters, "reduced", lambda pieces, phases, *more: turned.append(len(phases["epoch"])) or reduced(pieces, phases, *more))
    monkeypatch.setattr(phase, "BROADCAST_SOURCES", 5)
    raw = spark.range(80).select(F.lit("H1").alias("detector"), F.col("id").cast("double").alias("t"), F.sin("id").alias("x"))
    seg = spark.createDataFrame([("H1", 0.0, 80.0)], "detector string, start double, end double")
    src = spark.createDataFrame([(f"s{k}", 0.1 + 0.05 * (k % 2), 0.0, None if k == 3 else 0.0) for k in range(12)] + [(None, 0.1, 0.0, 0.0)], "source string, f0 double, f1 double, epoch double")
    got = phase.heterodyne(raw, src, seg, 1.0, 0.125, 0.04, crop=8).collect()
    assert (turned, len(got)) == ([2], 13 * 8)
    alone = phase.heterodyne(raw, src.where("source = 's3'"), seg, 1.0, 0.125, 0.04, crop=8).collect()
    rounded = lambda rows: sorted((r["block"], r["t"], round(r["re"], 9), round(r["im"], 9)) for r in rows)
    assert rounded(r for r in got if r["source"] == "s11") == rounded(alone)
    # in two stages sources share means if their delays are the same, too
    nodes = src.where("source is not null and source <> 's5'").select("source", F.lit("H1").alias("detector"), F.explode(F.sequence(F.lit(-2), F.lit(4))).alias("k"))
    nodes = nodes.withColumn("y", F.col("k") * F.when(F.col("source") == "s1", 0.9).otherwise(0.1))
    both = phase.two_stage(raw, src, seg, nodes, 1.0, 0.25, 1 / 16, node_step=60.0, knee=0.1, crop=8, decimals=6).collect()
    assert (turned, len(both)) == ([2, 1, 2], 11 * 4)
    means = {n: sorted((r["t"], r["re"], r["im"]) for r in both if r["source"] == n) for n in ("s1", "s3", "s7")}
    assert means["s3"] == means["s7"] != means["s1"]


def test_pieces_are_dealt_to_tasks_and_members_unfolded_from_lists(spark):
    """Many short runs in one small file are no single task's work, and no column is worked out again for each source of a phase."""
    raw = spark.range(64 * 24).select(F.lit("H1").alias("detector"), (F.col("id") + 100 * F.floor(F.col("id") / 24)).cast("double").alias("t"), F.sin("id").alias("x")).coalesce(1)
    seg = spark.createDataFrame([("H1", 0.0, 1e6)], "detector string, start double, end double")
    src = spark.createDataFrame([(n, 0.1, 0.0, 0.0) for n in ("a", "b", "b", None)], "source string, f0 double, f1 double, epoch double")
    got = phase.heterodyne(raw, src, seg, 1.0, 0.125, 0.04, crop=8, decimals=6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("round(")
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 4 * filters.TASKS_A_CORE / 2
    of = {n: sorted((r["t"], r["re"], r["im"]) for r in rows if r["source"] == n) for n in ("a", "b", None)}
    assert of["a"] == of[None] and of["b"] == sorted(of["a"] * 2) and len(of["a"]) == 64


def test_second_stage_finds_spans_once_for_all_sources(spark):
    """Runs that join or break in the second stage, nodes that end early, break off or are null: as each source alone, with no window over the sources' rows."""
    times = [t for lo, hi in ((0, 203), (204.4, 371), (372.2, 500), (540, 900)) for t in (lo + k for k in range(int(hi - lo))) if t not in (77, 78, 641)]
    raw = spark.createDataFrame([(d, float(t), math.sin(t * t)) for d in ("H1", "L1") for t in times if d == "H1" or t > 250], "detector string, t double, x double")
    seg = spark.createDataFrame([(d, 0.0, 2000.0) for d in ("H1", "L1")], "detector string, start double, end double")
    src = spark.createDataFrame([(n, 0.1 + 0.02 * k, 1e-7, 3.0) for n, k in (("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 0), ("g", 5))], "source string, f0 double, f1 double, epoch double")
    reach = {"a": range(-1, 17), "b": range(3, 9), "c": [*range(-1, 5), *range(8, 17)], "d": range(-1, 17), "e": range(3), "f": range(-1, 17), "g": range(-1, 17)}
    nodes = [(n, d, k, None if (n, k) == ("d", 6) else 0.3 * k + 0.01 * len(n + d) * k * k) for n, ks in reach.items() for d in ("H1", "L1") for k in ks if (n, d) != ("g", "L1")]
    nodes = spark.createDataFrame(nodes, "source string, detector string, k int, y double")
    got = phase.two_stage(raw, src, seg, nodes, 1.0, 0.25, 1 / 16, node_step=60.0, knee=0.1, crop=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [source" in plan
    coarse = phase.heterodyne(raw, src, seg, 1.0, 0.25, 0.1, crop=0).drop("run", "block")
    want = phase.second_stage(coarse, src, src, 0.25, 1 / 16, nodes=nodes, node_step=60.0, shift=0.5)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    a, b = ({tuple(r)[:4]: tuple(r)[4:] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and max(abs(x - y) for k in a for x, y in zip(a[k], b[k], strict=True)) < 1e-9
    runs = {n: {k[1:3] for k in a if k[0] == n} for n in reach}
    assert runs["a"] == runs["f"] != runs["b"] and "e" not in {k[0] for k in a} and {d for d, _ in runs["g"]} == {"H1"} and len({frozenset(v) for v in runs.values()}) > 3
    assert phase.two_stage(raw, src, seg, nodes.limit(0), 1.0, 0.25, 1 / 16, node_step=60.0, knee=0.1, crop=0).count() == 0
    assert phase.two_stage(raw.limit(0), src, seg, nodes, 1.0, 0.25, 1 / 16, node_step=60.0, knee=0.1, crop=0).count() == 0


def test_responses_are_worked_out_beside_samples(spark):
    src = spark.createDataFrame([("p", 1.0, -0.4), ("q", 5.5, 1.2), ("none", None, 0.1)], "source string, ra double, dec double")
    df = spark.range(300).select(F.element_at(F.array(F.lit("p"), F.lit("q"), F.lit("other"), F.lit("none")), (F.col("id") % 4 + 1).cast("int")).alias("source"), (F.col("id") * 977.7 - 9000).alias("t"))
    names = ["H1", "L1", "V1"]
    got = phase.attach_response(df, src, names, 100.0)
    want = phase.join_response(df.withColumn("detector", F.explode(F.array(*map(F.lit, names)))), phase.response_table(spark, src, names), 100.0)
    a, b = ({(r["source"], r["t"], r["detector"]): (r["fp"], r["fc"]) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) == 900
    assert all(v == b[k] if None in v else max(abs(v[0] - b[k][0]), abs(v[1] - b[k][1])) < 1e-12 for k, v in a.items())
    plan = catalogue.QUERIES["antenna_response"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan


def test_positions_are_ranked_where_they_are_made(spark):
    src = spark.range(50).coalesce(1).select(F.col("id").alias("place"), F.concat(F.lit("s"), "id").alias("name"), (F.col("id") % 6).cast("double").alias("ra"), (F.col("id") / 50).alias("dec"))
    got = background.background_positions(src, 30)
    assert got.count() == 1500 and got.select("name").distinct().count() == 1500 and got.groupBy("place").count().where("count <> 30").count() == 0
    plan = background.background_positions(src, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_refined_points_do_not_shuffle(spark):
    """Terms far below one are kept, whatever slice they come in, and weights follow from all points."""
    like = spark.createDataFrame([(n, float(x), -4000.0 * c - 0.5 * (x - c) ** 2) for n, c in (("a", 3), ("b", 6)) for x in range(0, 11)], "source string, x double, ln_l double")
    grid = spark.createDataFrame([(0, 4.0, 0.05), (1, 7.5, 0.02)], "hid int, mu0 double, sigma0 double")
    got = population.refined_hyper_likelihood(like, grid, population.BoundedGaussian(1), "hid", ["mu0", "sigma0"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source" in plan and "windowspecdefinition(hid" not in plan
    for r in got.collect():
        mu, s = {0: (4.0, 0.05), 1: (7.5, 0.02)}[r["hid"]]
        want = sum(-4000.0 * c - 0.5 * (mu - c) ** 2 / (1 + s * s) - 0.5 * math.log(1 + s * s) for c in (3, 6))
        assert abs(r["ln_like"] - want) < 1e-3
