"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors, padded to a power of two D, go through fast pseudo-random rotations: three times random signs, then
a Hadamard transform.  The hash of a vector in one table is the nearest signed axis after the table's rotation, one
of 2D buckets.  Every vector is indexed in all ``tables``; a query looks into the ``probes`` nearest signed axes of
each table.  Candidates are ranked by their exact inner product with the query, in double precision on the vectors
as given.

Vectors and queries meet per (table, bucket), cut into blocks of at most about ``BLOCK`` vectors and ``BLOCK``
queries from counted bucket sizes (tables x 2D counts at most are broadcast), so a bucket that holds a third of all
vectors is dealt over many tasks, by id and vector, so that one id's rows spread too.  A block returns the best ``top``
distinct ids per query; these lists are merged per query.
A query that finds fewer than ``top`` is searched against all vectors, in blocks.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most
vectors take no part; nor do null ids.  Ties go to the smaller id.  Equal rows of an id
are one; other rows that repeat an id count once, with the best score.  A table of fewer than ``top`` + 1 vectors gives all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, stage_table

TABLES = 16
PROBES = 8
TOP = 20
BLOCK = 4096
SEED = 11

FOUND = "query_id long, vec_ids array<long>, scores array<double>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(units: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors, padded to a power of two, in the axes of one table."""
    n, d = units.shape
    width = 1 << max(0, d - 1).bit_length()
    rng = np.random.default_rng((seed, table, width))
    out = np.zeros((n, width))
    out[:, :d] = units
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], width))
    return out


def nearest_axes(rotated_rows: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first: axis * 2 + (1 if positive)."""
    weight = np.abs(rotated_rows)
    count = min(count, weight.shape[1])
    axes = np.argsort(-weight, axis=1, kind="stable")[:, :count]
    return axes * 2 + (np.take_along_axis(rotated_rows, axes, axis=1) > 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # large components must not overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def hashed(tables: int, probes: int, seed: int):
    """Rows (table, bucket, id, vec) of each vector: its ``probes`` nearest axes in every table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 2000):
                part = frame.iloc[start:start + 2000]
                if not len(part):
                    continue
                vectors = np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]])
                units = unit_rows(vectors)
                packed = [v.tobytes() for v in vectors]
                for table in range(tables):
                    buckets = nearest_axes(rotated(units, table, seed), probes)
                    for probe in range(buckets.shape[1]):
                        yield pd.DataFrame({"table": table, "bucket": buckets[:, probe], "id": part["id"].to_numpy(),
                                            "vec": packed})
    return run


def best_in_block(top: int):
    """Best ``top`` ids of a block's vectors for each of its queries."""

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame(columns=["query_id", "vec_ids", "scores"], dtype=object)
        vectors = vectors.sort_values("id", ignore_index=True)
        matrix = np.frombuffer(b"".join(vectors["vec"])).reshape(len(vectors), -1)
        ids, firsts = np.unique(vectors["id"].to_numpy(np.int64), return_index=True)
        out = []
        for start in range(0, len(queries), 256):
            part = queries.iloc[start:start + 256]
            asked = part["id"].to_numpy(np.int64)
            scores = np.frombuffer(b"".join(part["vec"])).reshape(len(part), -1) @ matrix.T
            if len(firsts) < scores.shape[1]:
                scores = np.maximum.reduceat(scores, firsts, axis=1)  # an id's best row stands for it
            scores[asked[:, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, max(0, len(ids) - top), axis=1)[:, max(0, len(ids) - top)]
            for q, row, floor in zip(asked.tolist(), scores, least):
                at = np.flatnonzero((row >= floor) & (row > -np.inf))
                at = at[np.argsort(-row[at], kind="stable")[:top]]  # ids ascend, so ties go to the smaller
                out.append((q, ids[at], row[at]))
        return pd.DataFrame(out, columns=["query_id", "vec_ids", "scores"])
    return run


def merged_best(top: int):
    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate(lists["vec_ids"].to_list())
        scores = np.concatenate(lists["scores"].to_list())
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:top]
        return pd.DataFrame({"query_id": np.full(len(first), key[0], dtype=np.int64),
                             "rank": np.arange(1, len(first) + 1, dtype=np.int32),
                             "vec_id": ids[first], "score": scores[first]})
    return run


def search_blocks(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Best lists of all (table, bucket) groups, cut into blocks of vectors and queries."""
    keys = ["table", "bucket"]
    cuts = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    sizes = (vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("nv"))
             .join(queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq")), keys)
             .select(*keys, cuts("nv").alias("v_cuts"), cuts("nq").alias("q_cuts")))
    sizes = F.broadcast(sizes)  # a row for each bucket: tables x 2D at most
    dealt = lambda n: F.pmod(F.xxhash64("id", "vec", F.lit(3)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = (vectors.join(sizes, keys).withColumn("v", dealt("v_cuts")).withColumn("q", each("q_cuts"))
         .select(*keys, "v", "q", "id", "vec"))
    q = (queries.join(sizes, keys).withColumn("q", dealt("q_cuts")).withColumn("v", each("v_cuts"))
         .select(*keys, "v", "q", "id", "vec"))
    by = [*keys, "v", "q"]
    return v.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(best_in_block(top), FOUND)


def usable(vec: Column) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, id: str = "vec_id", vec: str = "embedding", top: int = TOP,
            tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found of every row for which ``is_query`` holds."""
    rows = vectors.select(col(vectors, id).cast("long").alias("id"), col(vectors, vec).cast("array<double>").alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec")))
    width = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return vectors.sparkSession.createDataFrame([], shape)
    rows = rows.filter(F.size("vec") == width["n"]).groupBy("id", "vec").agg(F.max("asks").alias("asks"))
    plain, asking = rows.select("id", "vec"), rows.filter("asks").select("id", "vec")
    hash_shape = "table int, bucket long, id long, vec binary"
    index = plain.mapInPandas(hashed(tables, 1, seed), hash_shape)
    probing = asking.mapInPandas(hashed(tables, probes, seed), hash_shape)
    lists = search_blocks(index, probing, top)
    found = stage_table(lists.groupBy("query_id").applyInPandas(merged_best(top), shape), "nearest-found")
    wanted = asking.select("id").distinct()
    counted = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(counted, "id", "left").filter(F.coalesce("n", F.lit(0)) < top).select("id")
    short = stage_table(short, "nearest-short")
    if short.isEmpty():
        return found

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())

    one = lambda df: df.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"),
                               F.col("id").alias("id"), packed("vec").alias("vec"))
    rest = search_blocks(one(plain), one(asking.join(short, "id", "left_semi")), top)
    whole = rest.groupBy("query_id").applyInPandas(merged_best(top), shape)
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(whole)
