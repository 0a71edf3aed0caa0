"""Isolation Forest: samples per tree, and the walk over all trees against one written node by node."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busguard.operators import forest
from busguard.params import DetectorParams

PARAMS = DetectorParams(n_trees=12)


def vectors(spark, n, parts):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(n, 5)))]
    return spark.createDataFrame(rows, "_row long, x array<double>").repartition(parts)


def walked(nodes: pd.DataFrame, x, psi: int) -> float:
    """Score of one vector, following the node table tree by tree."""
    paths = []
    for _, tree in nodes.groupby("tree_id"):
        rows = {r.node_id: r for r in tree.itertuples()}
        node = rows[0]
        while node.feature >= 0:
            node = rows[node.left if x[node.feature] <= node.threshold else node.right]
        n = node.size
        rest = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
        paths.append(node.depth + rest)
    c = 2 * (math.log(psi - 1) + 0.5772156649) - 2 * (psi - 1) / psi
    return -2.0 ** (-sum(paths) / len(paths) / c)


@pytest.mark.parametrize("n", [3, 300, 3000])
def test_trees_do_not_depend_on_partitions(spark, n):
    one, psi = forest.fit_forest(vectors(spark, n, 1), PARAMS, n=n)
    many, _ = forest.fit_forest(vectors(spark, n, 7), PARAMS, n=n)
    order = ["tree_id", "node_id"]
    a, b = (df.toPandas().sort_values(order, ignore_index=True) for df in (one, many))
    assert psi == min(256, n) and a.equals(b)
    assert a.groupby("tree_id")["size"].first().eq(psi).all() and a["tree_id"].nunique() == 12


def test_samples_are_the_smallest_hashes(spark):
    df = vectors(spark, 3000, 4)
    got = forest.tree_samples(df, PARAMS, 3000, 256, "_row")
    sent = got.groupBy("tree_id").count().collect()
    assert {r["count"] for r in sent} == {256}
    h = F.xxhash64(F.lit(PARAMS.seed), F.lit(5), "_row")
    want = {tuple(r["x"]) for r in df.orderBy(h, "_row").limit(256).collect()}
    assert {tuple(r["x"]) for r in got.filter("tree_id = 5").collect()} == want


def test_a_bound_that_is_too_low_widens(spark):
    # the table holds fewer rows than announced: the first bounds leave trees short
    got = forest.tree_samples(vectors(spark, 400, 2), PARAMS, 40_000, 256, "_row")
    assert {r["count"] for r in got.groupBy("tree_id").count().collect()} == {256}


@pytest.mark.parametrize("walks", [1, 100, 1 << 16])
def test_walk_of_all_trees(spark, monkeypatch, walks):
    monkeypatch.setattr(forest, "WALKS", walks)
    nodes, psi = forest.fit_forest(vectors(spark, 500, 3), PARAMS, n=500)
    nodes = nodes.toPandas()
    fo = forest.Forest.from_nodes(nodes, psi)
    x = np.random.default_rng(9).normal(size=(40, 5)) * 2
    x[0, 0], x[1, :] = np.nan, np.inf
    got = fo.score_samples(x)
    assert got == pytest.approx([walked(nodes, row, psi) for row in x], rel=1e-12)
    assert len(fo.score_samples(x[:0])) == 0
