"""Exact order statistics per key without gathering a key's values in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer; a key holding a third of
all rows would hold a third of the data in one task.  Here two passes suffice at any size.  The first takes a
bracket around each wanted percentile from the bounded quantile summary of ``approx_percentile``, wider than
its error.  The second counts, per key and bracket, the rows below it and the rows of each value inside it;
only those counts cross the shuffle, and a running sum over the values inside picks the one of the wanted
rank.  A bracket that should not hold its rank (its counts tell) is an error, never a wrong value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Half width of a bracket, as a share of the rows, and the error of the summary, ten times smaller.
REACH = 0.001
ACCURACY = 10_000
# Up to this many rows a bracket of that width may hold less than the ranks on both sides: take all values.
FEW = 5_000


def order_statistics(values: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """keys, ``i``, ``n`` and ``low``, ``high``: the values at the floor and the ceiling of (n - 1) ps[i]."""
    x = values.select(*keys, F.col(value).alias("_x")).filter(F.col("_x").isNotNull())
    grid = sorted({min(1.0, max(0.0, p + side)) for p in ps for side in (-REACH, REACH)})
    at = {p: (grid.index(max(0.0, p - REACH)), grid.index(min(1.0, p + REACH))) for p in ps}
    summary = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
                                   F.percentile_approx("_x", grid, ACCURACY).alias("_grid"))
    whole = F.col("n") <= FEW
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("n") - 1).cast("double").alias("last"),
                                  F.when(whole | F.lit(p - REACH <= 0), F.col("_min")).otherwise(F.col("_grid")[at[p][0]]).alias("lo"),
                                  F.when(whole | F.lit(p + REACH >= 1), F.col("_max")).otherwise(F.col("_grid")[at[p][1]]).alias("hi"),
                                  F.lit(float(p)).alias("p"))
                         for i, p in enumerate(ps)])
    # a row for each key: joined to all values, by broadcast where Spark finds it small
    per_key = summary.select(*keys, "n", brackets.alias("_brackets"))
    # per row, the brackets that hold it; those below a bracket are counted by value class instead of one by one
    placed = x.join(per_key, keys).select(
        *keys, "n", F.explode("_brackets").alias("_b"), "_x").filter(F.col("_x") <= F.col("_b.hi"))
    inside = F.when(F.col("_x") >= F.col("_b.lo"), F.col("_x"))
    counts = placed.groupBy(*keys, "n", F.col("_b.i").alias("i"), F.col("_b.p").alias("p"), inside.alias("_v")).agg(
        F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first())
    counts = counts.withColumn("_upto", F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = (F.col("n") - 1) * F.col("p")
    holds = lambda r: (r >= F.col("_upto") - F.col("_rows")) & (r < F.col("_upto"))
    picked = counts.groupBy(*keys, "i", "n", "p").agg(
        F.max(F.when(holds(F.floor(place)), F.col("_v"))).alias("low"),
        F.max(F.when(holds(F.ceil(place)), F.col("_v"))).alias("high"))
    sure = F.when(F.col("low").isNull() | F.col("high").isNull(),
                  F.raise_error(F.lit("a bracket does not hold its rank"))).otherwise(F.col("low"))
    return picked.withColumn("low", sure)


def exact_percentiles(values: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """Interpolated percentiles per key, as ``percentile(x, p)``: position (n - 1) p between the two neighbouring
    order statistics.  Returns keys + one column ``p<i>`` per requested percentile."""
    found = order_statistics(values, keys, value, [float(p) for p in ps])
    pos = (F.col("n") - 1) * F.col("p")
    lo, hi = F.floor(pos), F.ceil(pos)
    mixed = F.when((lo == hi) | (F.col("low") == F.col("high")), F.col("low")).otherwise((hi - pos) * F.col("low") + (pos - lo) * F.col("high"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, mixed)).alias(f"p{i}") for i in range(len(ps))])


def exact_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated median per key, as ``percentile(x, 0.5)``."""
    return exact_percentiles(values, keys, value, [0.5]).withColumnRenamed("p0", "median")
