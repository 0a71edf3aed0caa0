"""Structured Streaming detection.

Warm-up and model fitting are a batch job (``plans.detect``); the stream scores every frame with
those fixed artifacts (T4/T5).  Each micro-batch runs the batch pipeline over

    tail of earlier frames  UNION  the micro-batch

where the tail is bounded: the last ``interarrival_rows`` frames of every (bus, id) and the frames
within ``halo_ns`` and the lateness of each bus's latest time.  Look-backs of unbounded age (first sighting of an
(id, signature), earlier sightings of a 3-gram) are carried in two grouped state tables that enter
the window stage as one chunk before all others, so a frame gets the same features whether it
arrives in one batch or many (T1-T3).  Tail rows are recomputed and dropped, never re-emitted.

Delivery (S6): the source offsets live in ``checkpointLocation``; alerts of batch N go to
``<alerts>/batch_id=N`` and state to ``<state>/v=N`` with overwrite, so a re-run batch replaces
its own output: effectively once.  Frames older than the newest event time minus
``late_ns`` and frames whose payload is not JSON go to a quarantine folder with a reason (T6, S4);
re-delivered frames are dropped within the watermark.  Counters (processed, anomalies,
quarantined, indexed, errors) are collected per batch with ``observe`` (A13).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from busguard.functions.decode import event_time_ns
from busguard.operators import baselines, windows
from busguard.operators.windows import KEY, ORDER
from busguard.params import DetectorParams
from busguard.plans import detect
from busguard.schema import FRAME_COLUMNS, FRAME_SCHEMA
from busguard.session import checkpoint_dir, drop_folder, stage_table
from busguard.sources.frames import spread

SIG_STATE = "_bus string, arbitration_key string, sig bigint, first_t bigint, last_t bigint"
NGRAM_STATE = "_bus string, arbitration_key string, ngram bigint, n bigint, last_t bigint"
MAX_BATCH_ROWS = 1 << 40


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def with_source(batch: DataFrame) -> DataFrame:
    """``batch`` with ``_topic``, ``_part`` and ``_row``: uncut source position of a frame, else partition and row read."""
    if {"partition", "offset"} <= set(batch.columns):
        topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in batch.columns else F.lit("")
        part, row = F.col("partition").cast("bigint"), F.col("offset")
    else:
        read = F.monotonically_increasing_id()
        topic, part, row = F.lit(""), F.shiftright(read, 33), read.bitwiseAND(F.lit((1 << 33) - 1))
    return batch.withColumns({"_topic": topic, "_part": part, "_row": row})


def with_arrival(placed: DataFrame, batch_id: int) -> DataFrame:
    """``_ord`` in place of the source columns: unique over all batches, ascending with the rows of a source partition.

    Every (topic, partition) gets a range of its own from counted spans, one row each on the driver; the order across
    partitions is not defined by the source.  A batch that does not fit its range fails.
    """
    spans = placed.groupBy("_topic", "_part").agg(F.min("_row").alias("lo"), F.max("_row").alias("hi")).collect()
    starts, at = [], 0
    for topic, part, lo, hi in sorted(map(tuple, spans)):
        starts.append((topic, part, at - lo))
        at += hi - lo + 1
    if at > MAX_BATCH_ROWS or not 0 <= batch_id < (1 << 63) // MAX_BATCH_ROWS:
        raise ValueError(f"batch {batch_id} with a span of {at} rows has no arrival numbers: at most {MAX_BATCH_ROWS} "
                         f"rows and {(1 << 63) // MAX_BATCH_ROWS} batches")
    shifts = placed.sparkSession.createDataFrame(starts, "_topic string, _part bigint, _shift bigint")
    return (placed.join(F.broadcast(shifts), ["_topic", "_part"])
            .withColumn("_ord", F.lit(batch_id * MAX_BATCH_ROWS).cast("bigint") + F.col("_row") + F.col("_shift"))
            .drop("_topic", "_part", "_row", "_shift"))


class StreamDetector:
    """foreachBatch body plus helpers to start the query."""

    def __init__(self, spark: SparkSession, params: DetectorParams, artifacts: detect.Artifacts,
                 alerts_dir: str, state_dir: str | None = None, quarantine_dir: str | None = None,
                 processing_ns: Column | None = None, late_ns: int = 10_000_000_000):
        self.spark, self.params, self.art = spark, params, artifacts
        root = checkpoint_dir(spark)
        self.alerts_dir = alerts_dir
        self.state_dir = state_dir or f"{root}/stream-state"
        self.quarantine_dir = quarantine_dir or f"{root}/stream-quarantine"
        self.processing_ns = processing_ns
        self.late_ns = late_ns
        self.stats: Counter = Counter()

    # ------------------------------------------------------------------ state
    def _latest_version(self, before: int) -> int | None:
        path, fs = _fs(self.spark, self.state_dir)
        if not fs.exists(path):
            return None
        versions = [int(st.getPath().getName()[2:]) for st in fs.listStatus(path)
                    if st.getPath().getName().startswith("v=")]
        versions = [v for v in versions if v < before
                    and fs.exists(_fs(self.spark, f"{self.state_dir}/v={v}/_COMMITTED")[0])]
        return max(versions) if versions else None

    def _load_state(self, batch_id: int):
        v = self._latest_version(batch_id)
        if v is None:
            empty_tail = self.spark.createDataFrame([], FRAME_SCHEMA).withColumn("_ord", F.lit(0).cast("bigint"))
            return (empty_tail, self.spark.createDataFrame([], SIG_STATE),
                    self.spark.createDataFrame([], NGRAM_STATE), None)
        base = f"{self.state_dir}/v={v}"
        tail = self.spark.read.parquet(f"{base}/tail")
        max_t = tail.agg(F.max(event_time_ns("simulator_send_time_ns", "event_time_epoch_ms"))).first()[0]
        return (tail, self.spark.read.parquet(f"{base}/sig"), self.spark.read.parquet(f"{base}/ngram"), max_t)

    def _save_state(self, batch_id: int, tail: DataFrame, sig: DataFrame, ngram: DataFrame) -> None:
        base = f"{self.state_dir}/v={batch_id}"
        tail.write.mode("overwrite").parquet(f"{base}/tail")
        sig.write.mode("overwrite").parquet(f"{base}/sig")
        ngram.write.mode("overwrite").parquet(f"{base}/ngram")
        path, fs = _fs(self.spark, f"{base}/_COMMITTED")
        fs.create(path, True).close()
        # the version that this batch read stays for a run of the batch again; older ones go
        root, fs = _fs(self.spark, self.state_dir)
        older = sorted(int(st.getPath().getName()[2:]) for st in fs.listStatus(root)
                       if st.getPath().getName().startswith("v="))
        for v in [v for v in older if v < batch_id][:-1]:
            drop_folder(self.spark, f"{self.state_dir}/v={v}")

    # ------------------------------------------------------------------ one micro-batch
    def process(self, batch: DataFrame, batch_id: int) -> None:
        p = self.params
        proc = self.processing_ns if self.processing_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
        tail, sig_state, ng_state, max_t = self._load_state(batch_id)
        text = F.col("_corrupt_record") if "_corrupt_record" in batch.columns else F.lit(None).cast("string")
        placed = with_source(batch).select(*FRAME_COLUMNS, text.alias("record"), "_topic", "_part", "_row").persist()
        new = with_arrival(placed, batch_id)
        # quarantine: payload text that is not JSON, and frames older than the lateness bound
        t = event_time_ns("simulator_send_time_ns", "event_time_epoch_ms", proc)
        malformed = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
        late = F.lit(False) if max_t is None else t < F.lit(max_t - self.late_ns)
        reason = (F.when(F.col("record").isNotNull(), F.lit("corrupt_record"))
                  .when(malformed, F.lit("malformed_payload")).when(late, F.lit("late")))
        bad_obs = Observation(f"quarantine-{batch_id}")
        (new.withColumn("reason", reason).filter(F.col("reason").isNotNull())
         .observe(bad_obs, F.count(F.lit(1)).alias("quarantined"))
         .write.mode("overwrite").parquet(f"{self.quarantine_dir}/batch_id={batch_id}"))
        self.stats["quarantined"] += int(bad_obs.get.get("quarantined") or 0)
        held = placed
        new = new.filter(reason.isNull()).drop("record")
        frames = tail.withColumn("_hist", F.lit(True)).unionByName(new.withColumn("_hist", F.lit(False)))
        # few files arrive in few partitions; the features are read five times below, each time other columns
        cached = detect.features(spread(frames, "_ord"), p, proc, history=(sig_state, ng_state))
        feats, staged = stage_table(cached, "stream-features")
        windows.release(cached)
        fitted = self.art.fit_key is not None  # without a fit every frame is warm-up, and nothing is flagged
        lf = baselines.learned_features(feats, self.art.timing_baseline, self.art.transitions, p, F.lit(fitted))
        lf = lf.withColumn("detector_phase", F.lit("inference" if fitted else "warmup"))
        decided = detect.score_and_decide(lf, self.art, p)
        alerts = detect.enrich(decided.filter(~F.col("_hist")), proc)
        obs = Observation(f"detector-{batch_id}")
        alerts = alerts.observe(obs, F.count(F.lit(1)).alias("processed"),
                                F.count_if(F.col("is_anomaly")).alias("anomalies"))
        target = f"{self.alerts_dir}/batch_id={batch_id}"
        alerts.write.mode("overwrite").parquet(target)
        for k, v in obs.get.items():
            self.stats[k] += int(v or 0)
        indexed = self.spark.read.schema(alerts.schema).parquet(target).count()
        self.stats["indexed"] += indexed
        self.stats["errors"] += int(obs.get["processed"] or 0) - indexed

        # next state: bounded tail + grouped sightings
        fresh = feats.filter(~F.col("_hist"))
        # a frame may come late_ns after the newest one: it needs the windows that end there, and the rows
        # of its identifier before that time
        newest = feats.groupBy("_bus").agg((F.max("t") - F.lit(p.halo_ns + self.late_ns)).alias("_edge"))
        rows = feats.select(*FRAME_COLUMNS, "_ord", "_bus", KEY, "t").join(newest, "_bus")
        recent = F.col("t") >= F.col("_edge")
        w_id = Window.partitionBy("_bus", KEY, "_recent").orderBy(*[F.col(c).desc() for c in ORDER])
        next_tail = (rows.withColumn("_recent", recent).withColumn("_place", F.row_number().over(w_id))
                     .filter(F.col("_recent") | (F.col("_place") <= p.interarrival_rows)).select(*FRAME_COLUMNS, "_ord"))
        sig_new = fresh.groupBy("_bus", KEY, "sig").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
        next_sig = sig_state.unionByName(sig_new).groupBy("_bus", KEY, "sig").agg(
            F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))
        ng_new = fresh.filter(F.col("ngram").isNotNull()).groupBy("_bus", KEY, "ngram").agg(
            F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))
        next_ng = ng_state.unionByName(ng_new).groupBy("_bus", KEY, "ngram").agg(
            F.sum("n").alias("n"), F.max("last_t").alias("last_t"))
        if p.state_ttl_ms > 0:  # optional bound on signature / 3-gram state (the reference keeps all)
            newest = feats.agg(F.max("t")).first()[0]
            if newest is not None:
                edge = F.lit(newest - p.state_ttl_ms * 1_000_000)
                next_sig, next_ng = next_sig.filter(F.col("last_t") >= edge), next_ng.filter(F.col("last_t") >= edge)
        self._save_state(batch_id, next_tail, next_sig, next_ng)
        held.unpersist()
        drop_folder(self.spark, staged)

    # ------------------------------------------------------------------ query
    def start(self, frames_stream: DataFrame, checkpoint: str, available_now: bool = False,
              processing_time: str = "1 second", dedupe_watermark: str | None = None):
        """``available_now`` drains everything present and stops; otherwise a periodic trigger.
        ``dedupe_watermark``: drop records that the source delivers again, told by their topic, partition and offset (equal
        frames of a flood are different records); without these columns by all that a frame holds."""
        stream = frames_stream
        if dedupe_watermark:
            source = ["topic", "partition", "offset"]
            told = source if set(source) <= set(stream.columns) else stream.columns
            stream = stream.withWatermark("timestamp", dedupe_watermark).dropDuplicatesWithinWatermark(told)
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
        return writer.start()


def live_alert_counts(alerts_stream: DataFrame, window: str = "1 minute", watermark: str = "2 minutes") -> DataFrame:
    """Alert counts per tumbling event-time window and label, finalised by the watermark."""
    return (alerts_stream.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", window).alias("w"), "attack_type_label")
            .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("is_anomaly")).alias("anomalies"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "attack_type_label", "events", "anomalies"))
