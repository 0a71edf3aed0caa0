"""Exact distributed order statistics against numpy (skewed keys, ties, one value, two values)."""

import numpy as np
import pytest

from busguard.operators import baselines
from busguard.operators.quantiles import exact_percentiles, order_statistics


def test_robust_stats_matches_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.exponential(50, 20000)]          # a third-of-all-rows key
    rows += [("ties", 5.0)] * 500 + [("ties", 7.0)] * 499
    rows += [("one", 3.5), ("two", 1.0), ("two", 4.0), ("neg", -1.0), ("neg", 2.0)]
    rows += [("wide", float(v)) for v in np.concatenate([rng.normal(1e-3, 1e-4, 300), rng.normal(1e6, 1, 301)])]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in baselines.robust_stats(df, ["k"], "x").collect()}
    for k in {r[0] for r in rows}:
        a = np.array([v for kk, v in rows if kk == k and v > 0])
        med = np.median(a)
        assert got[k]["median"] == pytest.approx(med, rel=1e-12, abs=1e-12), k
        assert got[k]["mad"] == pytest.approx(np.median(np.abs(a - med)), rel=1e-12, abs=1e-12), k
        assert got[k]["count"] == len(a)
        assert got[k]["std"] == pytest.approx(a.std(), rel=1e-9, abs=1e-12)


def test_every_rank_of_a_small_group(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 9.0, 9.0, 9.0, 0.5]
    df = spark.createDataFrame([("a", v) for v in vals] + [("a", None)], "k string, x double")
    got = {r["i"]: (r["low"], r["high"]) for r in
           order_statistics(df, ["k"], "x", [i / 7 for i in range(8)]).collect()}
    assert all(sorted(vals)[i] in got[i] for i in range(8))


def test_large_group_uses_brackets(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.exponential(1, 30_000), np.full(9_000, 0.25), -rng.exponential(1, 2_000), [1e300, -1e300]])
    df = spark.createDataFrame([("a", float(v)) for v in a], "k string, x double").repartition(5)
    ps = [0.0, 0.0005, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    row = exact_percentiles(df, ["k"], "x", ps).first()
    for i, p in enumerate(ps):
        assert row[f"p{i}"] == pytest.approx(np.percentile(a, p * 100), rel=1e-12, abs=1e-12), p


def test_exact_percentiles_match_numpy(spark):
    from busguard.operators.quantiles import exact_percentiles
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 999)] + [("b", float(v)) for v in [-2.0, 0.0, 0.0, 5.0]]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "x", [0.25, 0.5, 0.75]).collect()}
    for k in ("a", "b"):
        a = np.array([v for kk, v in rows if kk == k])
        for i, p in enumerate([0.25, 0.5, 0.75]):
            assert got[k][f"p{i}"] == pytest.approx(np.percentile(a, p * 100), rel=1e-12, abs=1e-12)


def test_equal_neighbours_are_returned_as_they_are(spark):
    """between two equal order statistics the percentile is that value, bit for bit, as Spark's ``percentile``."""
    from pyspark.sql import functions as F

    from busguard.operators import quantiles

    value = 1234567890123456.7
    df = spark.createDataFrame([("a", value)] * 5, "k string, x double")
    ps = [i / 97 for i in range(1, 97)]
    want = df.agg(F.percentile("x", ps)).first()[0]
    got = quantiles.exact_percentiles(df, ["k"], "x", ps).first()
    assert [got[f"p{i}"] for i in range(len(ps))] == want == [value] * len(ps)
