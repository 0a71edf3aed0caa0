"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets by a seeded hash of their id; the number of buckets
follows from the bytes of all records and ``bucket_bytes``, so that a bucket fits in a task's memory.  Pass 2
puts each bucket in an order that depends on its records alone and shuffles it by Fisher-Yates with a
generator seeded by (seed, bucket).  The buckets one after the other are a random permutation of all records;
shard s is its s-th stretch, so shard sizes differ by one record at most (law ``rows``) and a bucket meets one
or two shards: it is written without another shuffle.

A lost executor's buckets are computed again with the same result.  Records with equal ids share a bucket;
where one id may hold many records, name further columns in ``spread``.

Defined results: null text has no bytes; null ids hash as one id; repeated rows are separate records; an empty
table gives no rows.  Other columns pass through.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busguard.llm.common import col, free_name

RECORD_BYTES = 16
BUCKET_BYTES = 16 << 20


def text_bytes(c):
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("long")


def fisher_yates(n: int, seed: str) -> np.ndarray:
    """A random permutation of 0..n-1, the same for the same seed."""
    rng = random.Random(seed)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = rng.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_into_shards(docs: DataFrame, n_shards: int, id: str = "doc_id", text: str = "text",
                        spread: tuple[str, ...] = (), seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
                        shard_as: str = "shard", slot_as: str = "slot") -> DataFrame:
    """``docs`` with the shard of every record and its place in the shard (from 0, without gaps)."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    total, n = docs.agg(F.sum(text_bytes(col(docs, text)) + RECORD_BYTES), F.count(F.lit(1))).first()
    n_buckets = max(1, -(-(total or 0) // bucket_bytes))
    bucket, start, tie = (free_name(docs, x) for x in ("bucket", "start", "tie"))
    keys = [col(docs, c).cast("string") for c in (id, *spread)]
    number = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_buckets))
    # the ids alone are read for the buckets' sizes; their running sum has a row for each bucket
    sizes = docs.select(number.alias(bucket)).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    # of equal records the order does not matter; all columns that can be hashed tell records apart
    hashable = [col(docs, f.name) for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    base = docs.withColumn(bucket, number).withColumn(tie, F.xxhash64(F.lit(~seed), *hashable)).drop(shard_as, slot_as)
    kept = T.StructType([f for f in base.schema.fields if f.name not in (bucket, tie)])
    schema = T.StructType([*kept.fields, T.StructField(shard_as, T.IntegerType()), T.StructField(slot_as, T.LongType())])

    def place(key: tuple, records: pa.Table, offset: pa.Table) -> pa.Table:
        order = np.argsort(records[tie].to_numpy(), kind="stable")
        first = offset[start][0].as_py() if len(records) else 0
        rank = first + fisher_yates(len(records), f"{seed}:{key[0].as_py()}")
        shard = rank * n_shards // max(n, 1)
        slot = rank - (shard * n + n_shards - 1) // n_shards
        along = np.lexsort((slot, shard))
        out = records.select(kept.names).take(order[along])
        return (out.append_column(shard_as, pa.array(shard[along], pa.int32()))
                .append_column(slot_as, pa.array(slot[along], pa.int64())))

    return base.groupBy(bucket).cogroup(starts.groupBy(bucket)).applyInArrow(place, schema)


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard, as Parquet.  A bucket writes to the one or two shards that it meets."""
    sharded.write.partitionBy(shard).parquet(path)


def read_shard(spark, path: str, number: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The records of one shard in their order."""
    return spark.read.parquet(path).filter(F.col(shard) == number).orderBy(slot)
