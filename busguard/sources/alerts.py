"""Alert sinks and scans."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busguard.schema import REPORT_COLUMNS


def document_id(alerts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Deterministic id ``sha256(session:sequence:arbitration_id:ordinal)``.

    ``sequence`` is not unique (all frames of a tick share it), so the ordinal numbers the frames
    of one (session, sequence, id) in event order within the frames given.  Frames that carry their source
    position (topic, partition, offset) are named by it instead: such an id does not depend on what else is
    in the batch, so ``dropDuplicates(["document_id"])`` removes exactly what was delivered again.
    """
    if order is None and {"topic", "partition", "offset"} <= set(alerts.columns):
        return alerts.withColumn("document_id", hashed_id("topic", "partition", "offset"))
    order = order or ["event_time_ns"]
    w = Window.partitionBy("session_id", "sequence", "arbitration_id").orderBy(*order)
    ordinal = (F.row_number().over(w) - 1).alias("ordinal")
    numbered = alerts.withColumn("_ordinal", ordinal)
    return numbered.withColumn("document_id", hashed_id("session_id", "sequence", "arbitration_id", "_ordinal")) \
        .drop("_ordinal")


def hashed_id(*columns: str):
    """SHA-256 of the columns' texts; a null is an empty place, so columns never slide into each other."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append", with_id: bool = False) -> None:
    """Alerts as Parquet partitioned by event date and label.  ``mode='overwrite'`` with
    dynamic partition overwrite resets only the partitions being written.  ``with_id``: with their document ids."""
    if with_id:
        alerts = document_id(alerts)
    out = alerts.withColumn("event_date", F.to_date("timestamp"))
    # rebalance: rows of one (date, label) land in few files, and AQE splits a hot label-day over
    # several tasks instead of one (plain repartition) or every task writing every partition value
    out = out.hint("rebalance", "event_date", "attack_type_label")
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "attack_type_label").parquet(path))


def partition_columns(fs, path) -> tuple[str, ...]:
    """Names of the partition columns of a table's folder, from its first folders down (a listing for each level)."""
    names: list[str] = []
    while True:
        inner = [st for st in fs.listStatus(path) if st.isDirectory() and "=" in st.getPath().getName()]
        if not inner:
            return tuple(names)
        path = inner[0].getPath()
        names.append(path.getName().split("=", 1)[0])


def from_path(name: str) -> Column:
    """A partition column's value out of the file's path (escaped by the writer, then as part of a URI)."""
    value = F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]*)/", 1)
    plain = F.url_decode(F.replace(F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B")))
    value = F.when(plain != "__HIVE_DEFAULT_PARTITION__", plain)
    return value.cast("date") if name == "event_date" else value


def read_alerts(spark: SparkSession, pattern: str) -> DataFrame:
    """S3: one index or a wildcard over several (each a partitioned table of its own); columns
    missing in some indices come back NULL.  Indices of one layout are one scan whose schema is merged from the files'
    footers by a job, so a thousand indices plan as one node; only layouts that differ in their partition columns are
    united.  Several partitioned indices have no common root for partition discovery: their partition columns are read
    from the files' paths (a time range still prunes by the files' statistics of ``timestamp``)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = sorted((st.getPath() for st in (fs.globStatus(path) or [])), key=lambda p: str(p.toString()))
    if not matches:
        raise FileNotFoundError(pattern)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for match in matches:
        layouts.setdefault(partition_columns(fs, match), []).append(str(match.toString()))
    out = None
    for names, paths in layouts.items():
        reader = spark.read.option("mergeSchema", len(paths) > 1)
        if names and len(paths) > 1:
            df = reader.option("recursiveFileLookup", True).parquet(*paths)
            df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), *(from_path(c).alias(c) for c in names))
        else:
            df = reader.parquet(*paths)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_report(report: DataFrame, json_path: str, csv_path: str, index: str | None = None, start_time: str | None = None,
                 end_time: str | None = None, normal_total: int | None = None, generated_at: datetime | None = None) -> None:
    """The report as one JSON document (when and over what it was made, the total of normal frames, ``overall`` and
    each attack), and as CSV with the 12 fixed columns, ``overall`` last."""
    ordered = report.orderBy("ord").coalesce(1)  # at most five rows
    rows = {r["attack_type"]: {k: v for k, v in r.asDict().items() if k not in ("ord", "attack_type")}
            for r in ordered.collect()}
    overall = rows.pop("overall", None)
    if overall is not None:
        overall.pop("total")
    document = {"generated_at": (generated_at or datetime.now(timezone.utc)).isoformat(), "index": index,
                "time_range": {"gte": start_time, "lte": end_time}, "normal_total": normal_total, "overall": overall,
                "per_attack": rows}
    spark = report.sparkSession
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(json_path)
    (ordered.select(*[F.col(c).cast("string").alias(c) for c in REPORT_COLUMNS])
     .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(csv_path))
