"""Hard negatives by an inverted multi-index.

Vectors become whole numbers (``floor(SCALE * x)``) and are cut into two halves.  A codebook for each half divides its
half space; a vector's cell is the pair of its nearest centroids.  The codebooks come from k-means over at most
``SAMPLE`` rows (those of the smallest hashes); every row is indexed, and each cell knows its number of rows and the
largest distance of a row from either centroid.

For an anchor a, the half score of a row whose half lies within r of centroid c is at most a.c + |a| r.  A heap over
the two lists of half bounds, each in descending order (the multi-sequence algorithm), visits cells by the sum of their
half bounds.  The first visits hold at least ``FIRST_ROWS`` rows and give a threshold for each window of scores; the
second turn visits every other cell whose bound reaches a threshold.  Where the heap's bound falls below all thresholds
the windows are certified: no cell beyond can change them.  A cell whose scores all lie above a window is left out too.

An anchor's positives are its best rows of the same label; each positive opens a window of negative scores.  Rows and
visiting anchors meet by cell, cut into blocks of counted size, so a cell that holds a third of all rows is many tasks.
Scores are exact integers.  Only codebooks, cell counts (``MOST_CENTROIDS`` squared at most) and the sample pass through
the driver.

Defined results: rows with null id or label, or with a vector that is null, empty, or holds null or non-finite
components take no part, nor do vectors of another length than most.  Equal rows count once; rows that share an id but
differ are rows of their own, and a row of the anchor's id is never its positive or negative.  Anchors without a
positive, or positives without a negative, give no rows; an empty table gives none.  Integer components must fit in 32
bits (an ArithmeticError says so else).
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, first_of, scratch_path

SCALE = 256
SAMPLE = 20_000
ROWS_PER_CELL = 256
MOST_CENTROIDS = 256
TURNS = 12
FIRST_ROWS = 2048
BLOCK = 4096
VISITS = 8192  # rows of a batch of visits: an anchor may visit every cell
LOW, HIGH = -(1 << 62), 1 << 62
SEED = 5


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * vectors)
    if np.abs(scaled).max(initial=0) >= 1 << 31:
        raise ArithmeticError("components of an integer vector must fit in 32 bits")
    return scaled.astype(np.int64)


def packed(rows: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: two a component where they fit, else four."""
    wide = (rows.min(axis=1, initial=0) < -(1 << 15)) | (rows.max(axis=1, initial=0) >= 1 << 15)
    return [r.astype("<i4" if w else "<i2").tobytes() for r, w in zip(rows, wide)]


def unpacked(values, width: int) -> np.ndarray:
    if all(len(v) == 2 * width for v in values):
        return np.frombuffer(b"".join(values), "<i2").reshape(-1, width).astype(np.float64)
    return np.array([np.frombuffer(v, "<i2" if len(v) == 2 * width else "<i4") for v in values], dtype=np.float64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows, in floating point where that is exact."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most >= 1 << 62:
        raise ArithmeticError("scores must fit in 62 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centroids.T + (centroids**2).sum(axis=1)
    return np.maximum(squares, 0)


def codebook(rows: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Centroids by k-means; a centroid without rows stays where it was."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:size]].astype(np.float64)
    for _ in range(TURNS):
        nearest = np.concatenate([distances(rows[s:s + 4096], centroids).argmin(axis=1) for s in range(0, len(rows), 4096)])
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


class Cells:
    """Codebooks, and per cell the number of rows and their largest distances from either centroid."""

    def __init__(self, first: np.ndarray, second: np.ndarray, stats: list[tuple[int, int, int, float, float]]):
        self.first, self.second = first, second
        shape = (len(first), len(second))
        self.count = np.zeros(shape, np.int64)
        self.radius = np.zeros((2, *shape))
        for i, j, n, r1, r2 in stats:
            self.count[i, j] = n
            self.radius[:, i, j] = r1, r2
        self.widest = self.radius[0].max(axis=1), self.radius[1].max(axis=0)

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int, float, float]]:
        """(bound of this and all later cells, i, j, upper, lower) of the cells with rows, by summed half bounds."""
        cut = self.first.shape[1]
        halves = anchor[:cut], anchor[cut:]
        length = [float(np.linalg.norm(h)) for h in halves]
        score = self.first @ halves[0], self.second @ halves[1]
        half = [s + w * n for s, w, n in zip(score, self.widest, length)]
        order = [np.argsort(-h, kind="stable") for h in half]
        u, v = half[0][order[0]], half[1][order[1]]
        centre = score[0][:, None] + score[1][None, :]
        reach = self.radius[0] * length[0] + self.radius[1] * length[1]
        slack = 1.0 + 1e-9 * (np.abs(centre) + reach)  # scores are whole numbers
        upper, lower = centre + reach + slack, centre - reach - slack
        heap, done = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            i, j = int(order[0][a]), int(order[1][b])
            if self.count[i, j]:
                yield -bound + 1.0 + 1e-9 * abs(bound), i, j, upper[i, j], lower[i, j]
            for x, y in ((a + 1, b), (a, b + 1)):
                if x < len(u) and y < len(v) and (x, y) not in done:
                    done.add((x, y))
                    heapq.heappush(heap, (-(u[x] + v[y]), x, y))


def wanted_cells(cells: Cells, anchor: np.ndarray, lows: list[int], highs: list[int],
                 reached: list[int] | None) -> Iterator[tuple[int, int]]:
    """Cells of the first turn, or (with the scores ``reached`` in each window) all others that are still open."""
    rows, first_turn = 0, True
    for bound, i, j, upper, lower in cells.visits(anchor):
        if first_turn and rows >= FIRST_ROWS:
            if reached is None:
                return
            first_turn = False
        if first_turn:
            if bound < min(lows):
                return
            if any(upper >= lo and lower <= hi for lo, hi in zip(lows, highs)):
                rows += int(cells.count[i, j])
                if reached is None:
                    yield i, j
        else:
            if bound < min(reached):
                return  # certified
            if any(upper >= t and lower <= hi for t, hi in zip(reached, highs)):
                yield i, j


ASK = ["key", "id", "label", "vec", "lows", "highs"]
ASK_TYPE = "key long, id long, label long, vec binary, lows array<long>, highs array<long>"


def visits_of(shared, width: int, second: bool):
    """Arrow batches of asks to one row for each cell to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unpacked(batch.column("vec").to_pylist(), width) if batch.num_rows else []
            reached = batch.column("reached") if second else None
            cells = ((r, *cell) for r, vector in enumerate(vectors) for cell in wanted_cells(
                shared.value, vector, batch.column("lows")[r].as_py(), batch.column("highs")[r].as_py(),
                reached[r].as_py() if second else None))
            while part := list(itertools.islice(cells, VISITS)):
                row, i, j = np.array(part, dtype=np.int64).T
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ASK), pa.array(i.astype(np.int32)),
                                                  pa.array(j.astype(np.int32))], [*ASK, "i", "j"])
    return run


def best_in_block(width: int, same: bool, top: int):
    """The best ``top`` rows of a block for each window of its asks, of the same or of other labels."""

    def run(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows = rows.sort_values("id", ignore_index=True)
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            matrix = unpacked(rows["vec"].to_list(), width)
            for begin in range(0, len(asks), 256):
                part = asks.iloc[begin:begin + 256]
                scores = inner_products(unpacked(part["vec"].to_list(), width), matrix)
                for ask, score in zip(part.itertuples(index=False), scores):
                    fits = ((labels == ask.label) == same) & (ids != ask.id)
                    for window, (low, high) in enumerate(zip(ask.lows, ask.highs)):
                        at = np.flatnonzero(fits & (score >= low) & (score <= high))
                        if len(at) > top:
                            least = np.partition(score[at], len(at) - top)[len(at) - top]
                            at = at[score[at] >= least]
                        for x in at[np.argsort(-score[at], kind="stable")[:top]]:  # ids ascend
                            out.append((ask.key, ask.id, window, ids[x], score[x]))
        return pd.DataFrame(out, columns=["key", "id", "win", "found", "score"]).astype("int64")
    return run


class Index:
    """The staged cells of a table, and the search over them."""

    def __init__(self, rows: DataFrame, width: int):
        """``rows``: id, label, vec (array of doubles), all usable and of one width."""
        self.spark, self.width = rows.sparkSession, width
        cut = width // 2
        n = rows.count()
        size = max(1, min(MOST_CENTROIDS, math.isqrt(n // ROWS_PER_CELL)))
        sample = rows.orderBy(F.xxhash64("id", "label", "vec")).limit(SAMPLE).select("vec").toPandas()["vec"]
        sample = whole_numbers(np.stack(list(sample))).astype(np.float64)
        books = self.spark.sparkContext.broadcast((codebook(sample[:, :cut], size, SEED), codebook(sample[:, cut:], size, SEED + 1)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 4096):
                    part = batch.slice(begin, 4096)
                    vectors = whole_numbers(part.column("vec").flatten().to_numpy().reshape(-1, width))
                    cells, far = [], []
                    for half, book in zip((vectors[:, :cut], vectors[:, cut:]), books.value):
                        half = half.astype(np.float64)
                        nearest = distances(half, book).argmin(axis=1)
                        cells.append(pa.array(nearest.astype(np.int32)))
                        far.append(pa.array(np.linalg.norm(half - book[nearest], axis=1)))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"),
                                                      pa.array(packed(vectors), pa.binary()), *cells, *far],
                                                     ["id", "label", "vec", "i", "j", "r1", "r2"])

        self.rows = self.stage(rows.mapInArrow(place, "id long, label long, vec binary, i int, j int, r1 double, r2 double"))
        stats = self.rows.groupBy("i", "j").agg(F.count(F.lit(1)), F.max("r1"), F.max("r2")).collect()
        self.cells = self.spark.sparkContext.broadcast(Cells(*books.value, [tuple(s) for s in stats]))
        blocks = [(s[0], s[1], -(-s[2] // BLOCK)) for s in stats]
        self.blocks = F.broadcast(self.spark.createDataFrame(blocks, "i int, j int, v_cuts int"))  # a row for each cell

    def stage(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "negatives")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def meet(self, visits: DataFrame, same: bool, top: int) -> DataFrame:
        """Best rows (key, id, win, found, score) of every block for the asks that visit it."""
        cuts = self.blocks.join(F.broadcast(visits.groupBy("i", "j").agg(
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_cuts"))), ["i", "j"])
        cuts = F.broadcast(cuts)  # a row for each visited cell at most
        dealt = lambda n, *by: F.pmod(F.xxhash64(F.lit(3), *by), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        by = ["i", "j", "v", "q"]
        rows = self.rows.select("i", "j", "id", "label", "vec").join(cuts, ["i", "j"]) \
            .withColumn("v", dealt("v_cuts", "id", "vec")).withColumn("q", each("q_cuts")).drop("v_cuts", "q_cuts")
        asks = visits.join(cuts, ["i", "j"]).withColumn("q", dealt("q_cuts", "key")).withColumn("v", each("v_cuts")) \
            .drop("v_cuts", "q_cuts")
        return rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(
            best_in_block(self.width, same, top), "key long, id long, win long, found long, score long")

    def search(self, asks: DataFrame, same: bool, top: int) -> DataFrame:
        """The best ``top`` rows of each window of each ask (``ASK_TYPE``): key, id, win, found, score, rank."""
        keys, order = ["key", "id", "win"], [F.desc("score"), F.asc("found")]
        best = lambda df: first_of(df, keys, order, top, F.xxhash64("found", "score"))
        visits = lambda df, second: self.stage(df.mapInArrow(
            visits_of(self.cells, self.width, second), f"{ASK_TYPE}, i int, j int"))
        early = self.stage(best(self.meet(visits(asks, False), same, top)).drop("rank"))
        last = early.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")) \
            .filter(F.col("n") == top)
        last = last.groupBy("key", "id").agg(F.map_from_entries(F.collect_list(F.struct("win", "least"))).alias("least"))
        reached = F.transform("lows", lambda low, w: F.coalesce(F.col("least")[w.cast("long")], low))
        open_ = asks.join(last, ["key", "id"], "left").withColumn("reached", reached).drop("least")
        return best(early.unionByName(self.meet(visits(open_, True), same, top)))


def usable(vec: Column) -> Column:
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", vec: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A negative fits a positive where low_percent * positive_score <= 100 * negative_score <= high_percent *
    positive_score."""
    spark = vectors.sparkSession
    shape = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = vectors.select(col(vectors, id).cast("long").alias("id"), col(vectors, label).cast("long").alias("label"),
                          col(vectors, vec).cast("array<double>").alias("vec"),
                          F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")) & (F.size("vec") > 0))
    width = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if width is None:
        return spark.createDataFrame([], shape)
    rows = rows.filter(F.size("vec") == width["n"]).groupBy("id", "label", "vec").agg(F.max("asks").alias("asks"))
    index = Index(rows.drop("asks"), width["n"])
    anchors = index.rows.select("id", "label", "vec").join(rows.filter("asks").select("id").distinct(), "id", "left_semi") \
        .withColumn("key", F.xxhash64("id", "label", "vec"))
    anchors = index.stage(anchors)
    one = lambda n: F.array(F.lit(n).cast("long"))
    asks = anchors.select("key", "id", "label", "vec", one(LOW).alias("lows"), one(HIGH).alias("highs"))
    found = index.stage(index.search(asks, True, positives))
    low = F.expr(f"-((-score * {low_percent} - pmod(-score * {low_percent}, 100L)) div 100)")  # rounded up
    high = F.expr(f"(score * {high_percent} - pmod(score * {high_percent}, 100L)) div 100")  # rounded down
    windows = found.groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", low.alias("low"), high.alias("high")))).alias("w"))  # at most ``positives`` of them
    asks = anchors.join(windows, ["key", "id"]).select("key", "id", "label", "vec", F.col("w.low").alias("lows"),
                                                       F.col("w.high").alias("highs"))
    mined = index.search(asks, False, negatives)
    chosen = found.select("key", "id", (F.col("rank") - 1).cast("long").alias("win"), F.col("found").alias("positive_id"),
                          F.col("score").alias("positive_score"))
    return mined.join(chosen, ["key", "id", "win"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
