"""Isolation Forest (Liu, Ting, Zhou 2008) on Spark.

MLlib has no isolation forest.  Fit: each tree draws psi = min(256, n) rows of the scaled warm-up
vectors without replacement, those of the smallest seeded hashes of (tree, row).  A row goes only to the trees whose
hash lies below a bound that psi rows of n reach with room to spare, so about 1.5 psi rows a tree are ranked, whatever n
is; a tree that the bound leaves short widens it.  ``groupBy(tree_id).applyInPandas`` grows one tree per group (random
feature, uniform split in (min, max), height limit ceil(log2 psi)).  The node table is bounded by
n_trees * (2 psi - 1) rows.  Score: a pandas UDF walks all trees together, level by level, for some rows at a time
(numpy, no loop over trees or rows), with the node arrays shipped once per executor as a broadcast variable.

score_samples = -2^(-E[h(x)] / c(psi)); offset = contamination percentile of the training scores;
decision = score_samples - offset; prediction = -1 when decision < 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busguard.params import DetectorParams

EULER_GAMMA = 0.5772156649
WALKS = 1 << 16  # rows times trees that walk together
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search; c(1)=0, c(2)=1."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def grow_tree(x: np.ndarray, tree_id: int, seed: int, height_limit: int) -> list[tuple]:
    """Grow one isolation tree over rows ``x``; returns node tuples (see NODE_SCHEMA)."""
    rng = np.random.default_rng([seed, tree_id])
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]  # (row indices, depth, parent, side)
    while stack:
        idx, depth, parent, side = stack.pop()
        node_id = len(nodes)
        nodes.append([tree_id, node_id, -1, 0.0, -1, -1, int(len(idx)), depth])
        if parent >= 0:
            nodes[parent][4 if side == 0 else 5] = node_id
        if depth >= height_limit or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] <= thr]
        right = idx[sub[:, f] > thr]
        if left.size == 0 or right.size == 0:
            continue
        nodes[node_id][2], nodes[node_id][3] = f, thr
        stack.append((right, depth + 1, node_id, 1))
        stack.append((left, depth + 1, node_id, 0))
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    feature: np.ndarray     # [trees, max_nodes] int, -1 at leaves
    threshold: np.ndarray   # [trees, max_nodes]
    left: np.ndarray
    right: np.ndarray
    leaf_value: np.ndarray  # depth + c(size) at leaves
    psi: int
    height_limit: int
    offset: float = 0.0

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, psi: int) -> "Forest":
        trees = int(nodes["tree_id"].max()) + 1
        width = int(nodes["node_id"].max()) + 1
        shape = (trees, width)
        feat = np.full(shape, -1, dtype=np.int64)
        thr = np.zeros(shape)
        left = np.zeros(shape, dtype=np.int64)
        right = np.zeros(shape, dtype=np.int64)
        leafv = np.zeros(shape)
        t, n = nodes["tree_id"].to_numpy(), nodes["node_id"].to_numpy()
        feat[t, n] = nodes["feature"].to_numpy()
        thr[t, n] = nodes["threshold"].to_numpy()
        left[t, n] = np.maximum(nodes["left"].to_numpy(), 0)
        right[t, n] = np.maximum(nodes["right"].to_numpy(), 0)
        leafv[t, n] = nodes["depth"].to_numpy() + average_path_length(nodes["size"].to_numpy())
        return Forest(feat, thr, left, right, leafv, psi, int(math.ceil(math.log2(max(psi, 2)))))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and the two children (left, right) of every node, trees one after the other.  A leaf
        is its own child, so a walk of ``height_limit`` steps ends in leaves."""
        trees, width = self.feature.shape
        node = np.arange(trees * width).reshape(trees, width)
        inner = self.feature >= 0
        first = node[:, :1]
        children = np.stack([np.where(inner, self.left + first, node), np.where(inner, self.right + first, node)], axis=2)
        return np.where(inner, self.feature, 0).ravel(), self.threshold.ravel(), children.ravel()

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path length / c(psi)) for each row of x; all trees walk a block of rows one level at a time."""
        trees, width = self.feature.shape
        feature, threshold, children = self.flat()
        leaf_value = self.leaf_value.ravel()
        x = np.ascontiguousarray(x, dtype=np.float64)
        total = np.empty(len(x))
        block = max(1, WALKS // trees)
        for begin in range(0, len(x), block):
            values = x[begin:begin + block]
            row = np.repeat(np.arange(len(values)) * x.shape[1], trees)
            node = np.tile(np.arange(trees) * width, len(values))
            for _ in range(self.height_limit):
                right = ~(values.take(row + feature.take(node)) <= threshold.take(node))
                node = children.take(2 * node + right)
            total[begin:begin + block] = leaf_value.take(node).reshape(-1, trees).sum(axis=1)
        mean_h = total / trees
        return -np.power(2.0, -mean_h / average_path_length(np.array([self.psi]))[0])


def tree_samples(vectors: DataFrame, params: DetectorParams, n: int, psi: int, row_key: str) -> DataFrame:
    """tree_id, x: for each tree the psi rows of the smallest hashes of (tree, row)."""
    spread = psi + 6.0 * math.sqrt(psi) + 20.0
    while True:
        share = min(1.0, spread / max(n, 1))
        bound = F.lit((1 << 63) - 1) if share >= 1 else F.lit(int(-(1 << 63) + share * (1 << 64)))
        order = lambda tree: F.xxhash64(F.lit(params.seed), tree, row_key)
        trees = F.filter(F.sequence(F.lit(0), F.lit(params.n_trees - 1)), lambda tree: order(tree) <= bound)
        drawn = vectors.select(row_key, "x", F.explode(trees).alias("tree_id"))
        if share >= 1:
            break
        got = drawn.groupBy("tree_id").count().agg(F.count(F.lit(1)), F.min("count")).first()  # n_trees counts
        if got[0] == params.n_trees and got[1] >= psi:
            break
        spread *= 2
    rank = Window.partitionBy("tree_id").orderBy(order(F.col("tree_id")), row_key)
    return drawn.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= psi).drop("_r")


def fit_forest(vectors: DataFrame, params: DetectorParams, row_key: str = "_row",
               n: int | None = None) -> tuple[DataFrame, int]:
    """M1: node table grown on Spark, one tree per group.  ``vectors`` has ``row_key`` and ``x``
    (array<double>, scaled); its size is bounded by the warm-up size.  The trees are spread over
    the cluster with an explicit repartition (a tiny shuffle AQE would otherwise fold into one task)."""
    n = vectors.count() if n is None else n
    psi = int(min(256, n))
    height = int(math.ceil(math.log2(max(psi, 2))))
    seed = params.seed
    sample = tree_samples(vectors, params, n, psi, row_key)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        x = np.vstack(pdf["x"].to_numpy()).astype(float)
        cols = ["tree_id", "node_id", "feature", "threshold", "left", "right", "size", "depth"]
        return pd.DataFrame(grow_tree(x, tree_id, seed, height), columns=cols)

    slots = max(1, min(params.n_trees, vectors.sparkSession.sparkContext.defaultParallelism * 2))
    nodes = sample.repartition(slots, "tree_id").groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)
    return nodes, psi


def scoring_udf(spark, forest: Forest):
    """M2: pandas UDF array<double> -> struct(score_samples, decision, prediction)."""
    # plain arrays travel as the broadcast; the class comes with the UDF closure (pickled by value)
    bc = spark.sparkContext.broadcast(dict(vars(forest)))
    schema = T.StructType([T.StructField("score_samples", T.DoubleType()),
                           T.StructField("decision", T.DoubleType()),
                           T.StructField("prediction", T.IntegerType())])

    @F.pandas_udf(schema)
    def score(x: pd.Series) -> pd.DataFrame:
        fo = Forest(**bc.value)
        if len(x) == 0:
            return pd.DataFrame({"score_samples": [], "decision": [], "prediction": []})
        mat = np.vstack(x.to_numpy()).astype(float)
        s = fo.score_samples(mat)
        d = s - fo.offset
        return pd.DataFrame({"score_samples": s, "decision": d, "prediction": np.where(d < 0, -1, 1).astype(np.int32)})

    return score


def scaled_vector(cols: list[str], scaler_rows: list) -> Column:
    """Standardised model vector; ``scaler_rows`` are the (bounded) rows of ``feature_scaler``."""
    stats = {r["feature"]: (r["mean"], r["std"]) for r in scaler_rows}
    return F.array(*[((F.col(c) - F.lit(float(stats[c][0]))) / F.lit(float(stats[c][1]))) for c in cols])


def train(spark, warm_vectors: DataFrame, params: DetectorParams, n: int | None = None) -> tuple[Forest, DataFrame]:
    """Fit the forest, then set its offset from the contamination percentile of training scores."""
    nodes, psi = fit_forest(warm_vectors, params, n=n)
    nodes_pd = nodes.toPandas()  # bounded: n_trees * (2 psi - 1) rows
    forest = Forest.from_nodes(nodes_pd, psi)
    udf = scoring_udf(spark, forest)
    scored = warm_vectors.select(udf("x").alias("s"))
    q = scored.agg(F.percentile(F.col("s.score_samples"), params.contamination).alias("q")).first()["q"]
    forest.offset = float(q)
    return forest, spark.createDataFrame(nodes_pd)
