"""Hyper likelihoods of bounded distributions against brute force."""

import math

from chronolens.operators import population


def test_source_without_a_finite_term(spark):
    like = {"a": {1.0: -1.0, 2.0: -2.0}, "b": {3.0: -1.5, 4.0: -0.5}}
    df = spark.createDataFrame([(s, x, v) for s, g in like.items() for x, v in g.items()], "source string, x double, ln_l double")
    hyper = {0: 1.0, 1: 3.0, 2: 2.5}
    grid = spark.createDataFrame(list(hyper.items()), "hid long, peak double")
    got = {r["hid"]: r["ln_like"] for r in population.log_hyper_likelihood_grid(df, grid, population.distribution("delta"), "hid", ["peak"]).collect()}
    for h, peak in hyper.items():
        want = sum(math.log(0.5) + g[peak] if peak in g else population.FLOOR for g in like.values())
        assert math.isclose(got[h], want)
