"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busguard.session import SHUFFLES_GO, checkpoint_dir, settings


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (Spark compares names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def col(df: DataFrame, name: str) -> Column:
    """Column of ``df`` by its exact name, dots included."""
    return df[f"`{name}`"]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: Scratch folders that this driver has named and not deleted.
CREATED: list[str] = []


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    CREATED.append(path)
    return path


def stage_table(df: DataFrame, stem: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.
    ``batch_rows``: most rows sent to a Python worker at once, where they are texts."""
    spark = df.sparkSession
    path = scratch_path(spark, stem)
    batches = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {}
    with settings(spark, SHUFFLES_GO | batches):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, before: int, keep: int = 1) -> None:
    """Delete the scratch folders named since ``CREATED`` had ``before`` entries, but for the last ``keep``."""
    for path in CREATED[before:-keep]:
        drop_folder(spark, path)
    del CREATED[before:-keep]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API (works for any shared store)."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``, chosen within 64 parts of a key before all together."""
    parts = Window.partitionBy(*keys, "part").orderBy(*order)
    some = df.withColumn("part", F.pmod(spread, F.lit(64))).withColumn("rank", F.row_number().over(parts))
    some = some.filter(F.col("rank") <= n).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


#: Bits of the bitmap of ``may_have``.
BITS = 1 << 24


def may_have(keys: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test of a column that holds for every value of ``keys[name]`` and for few others.  It sends a bitmap of 2 MB over
    hashes, whatever the number of keys: with very many of them most values pass, and the exact path takes more rows."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    at = keys.select((slot(F.col(name)) + 1).alias("slot"))  # the bitmap functions count from 1
    for r in (at.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
              .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()):
        bits[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = np.frombuffer(sent.value, dtype=np.uint8)
        for places in batches:
            place = places.to_numpy(np.int64)
            yield pd.Series((known[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool))
        give_back()

    return lambda c: maybe(slot(c))


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system; idle workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (over a task's batches), giving back its memory at the end of the task."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()
    return whole
