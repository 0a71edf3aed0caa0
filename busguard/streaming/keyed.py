"""The detector as one Structured Streaming query with keyed state.

    frames -> decode -> watermark -> transformWithState per bus -> learned features, model, rules -> alert table

Every bus is a key of the state store (RocksDB); a micro-batch reads and writes the state of the buses in it and, on
those, of the identifiers, signatures and 3-grams in it, so its cost does not depend on the stream's history.

*Order.*  Frames wait in their bus's state until the watermark has passed them and are then taken in time order, so
a frame that arrives late, but within ``lateness``, changes its successors' features as if it had come in time; an
event-time timer releases them even when the bus has no new frames.  Frames behind the watermark are dropped by the
engine and counted in the query's progress (``numRowsDroppedByWatermark``).

*State.*  Per bus the frames of the last windows (``halo_ns``) and those that wait; per identifier its last frame and
the last ``interarrival_rows`` gaps; per signature and 3-gram the last sighting.  A timer per bus removes sightings,
and identifiers, not seen for ``ttl`` (default seven days; zero keeps them for ever, as a batch run does).

*Delivery.*  The alert table is a file sink by event date and label: files of a batch become visible with the batch's
entry in the sink's log, a batch that is run again writes none twice, offsets and state versions commit in the
checkpoint.  ``compact_alerts`` rewrites finished days into few files.  ``drain`` stops a query after what is present.

A bus is one task's work here, which suits vehicles.  A whole fleet merged into one bus belongs in
``stream.StreamDetector``, which splits a bus over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from busguard.functions import decode
from busguard.operators import baselines, traffic, windows
from busguard.operators.traffic import KEY
from busguard.params import NS_PER_MS, DetectorParams
from busguard.plans import detect
from busguard.schema import FRAME_COLUMNS, FRAME_SCHEMA
from busguard.session import stage_table
from busguard.sources.alerts import hashed_id, write_alerts

LATENESS = "10 seconds"
SOURCE = ("topic", "partition", "offset")
TTL_MS = 7 * 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNALS = ["speed", "rpm", "coolant_temp", "brake_pressure", "odometer_km"]
PREVIOUS = ["_prev_speed", "_prev_rpm", "_prev_coolant", "_prev_brake", "_prev_odometer"]
WAITING = ["t", "sequence", "arrival", KEY, "sig", *SIGNALS, "frame", "document_id"]
OUT = T.StructType([
    T.StructField("_bus", T.StringType()), T.StructField("frame", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("_ord", T.LongType()), T.StructField("_prev_t", T.LongType()),
    *(T.StructField(c, T.DoubleType()) for c in PREVIOUS),
    T.StructField("_sig1", T.LongType()), T.StructField("_sig2", T.LongType()), T.StructField("_n_gaps", T.LongType()),
    *(T.StructField(c, T.DoubleType()) for c in ("rolling_interarrival_mean", "rolling_interarrival_std", "rolling_cv")),
    *(T.StructField(c, x) for c, x in traffic.FOUND.items())])
CHUNK = T.StructType([T.StructField("_row", T.LongType()), *(T.StructField(c, x) for c, x in traffic.FOUND.items())])
ID_STATE = ("t long, sig1 long, sig2 long, frames long, gaps binary, speed double, rpm double, coolant double, "
            "brake double, odometer double")


def packed(df: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def rolling_gaps(earlier: np.ndarray, gaps: np.ndarray, rows: int) -> pd.DataFrame:
    """Count, mean and population deviation (ms) of the last ``rows`` gaps (ns) up to each of ``gaps`` (NaN: none),
    and the deviation by the mean of the positive ones."""
    every = np.concatenate([np.full(rows, np.nan), earlier[-rows:], gaps])
    views = np.lib.stride_tricks.sliding_window_view(every, rows)[-len(gaps):]
    parts = []
    for begin in range(0, len(gaps), 2000):
        view = views[begin:begin + 2000]
        cols = {"n": np.isfinite(view).sum(axis=1)}
        for name, some in (("all", np.isfinite(view)), ("positive", view > 0)):
            n = some.sum(axis=1)
            mean = np.where(some, view, 0.0).sum(axis=1) / np.maximum(n, 1)
            deviation = np.sqrt((np.where(some, view - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n, 1))
            cols[f"{name}_mean"], cols[f"{name}_std"] = mean / NS_PER_MS, deviation / NS_PER_MS
        parts.append(pd.DataFrame(cols))
    out = pd.concat(parts, ignore_index=True)
    cv = out["positive_std"] / out["positive_mean"].where(out["positive_mean"] > 0)
    return out.assign(cv=cv.fillna(0.0))


class BusFeatures(StatefulProcessor):
    """Features of a bus's frames, in time order behind the watermark."""

    def __init__(self, params: DetectorParams, ttl_ms: int):
        self.params, self.ttl_ms = params, ttl_ms
        names = ["_row"]
        self.arithmetic = (params, names)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "until long, frames binary")
        self.bus = handle.getValueState("bus", "last_id string, frames binary, sweep long")
        self.ids = handle.getMapState("ids", "id string", ID_STATE)
        self.signatures = handle.getMapState("signatures", "id string, sig long", "t long")
        self.grams = handle.getMapState("grams", "id string, a long, b long, c long", "n long, t long")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True).reindex(columns=WAITING).rename(columns={"arrival": "_ord"})
        yield from self.release(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.release(key, None, timerValues.getCurrentWatermarkInMs())

    def release(self, key, new, watermark_ms: int):
        """Take the frames up to the watermark; keep the others and ask for a timer at the last of them."""
        edge = watermark_ms * NS_PER_MS
        held = [unpacked(r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        frames = held + ([new] if new is not None else [])
        if frames:
            frames = pd.concat(frames, ignore_index=True)
            ready = frames["t"].to_numpy() <= edge
            rest = frames[~ready]
            if len(rest):
                until = int(rest["t"].max()) // NS_PER_MS + 1
                self.waiting.put([(until, packed(rest))])
                self.handle.registerTimer(max(until, watermark_ms + 1))
            elif held:
                self.waiting.clear()
            if ready.any():
                yield self.features(key[0], frames[ready].sort_values(["t", "sequence", "_ord"], ignore_index=True))
        if self.ttl_ms:
            self.forget(watermark_ms)

    def forget(self, watermark_ms: int) -> None:
        """Remove what was not seen for the time to live, ten times within it."""
        last_id, frames, sweep = self.bus.get() if self.bus.exists() else (None, None, None)
        if frames is None:
            return
        if sweep is None or watermark_ms >= sweep:
            if sweep is not None:
                edge = (watermark_ms - self.ttl_ms) * NS_PER_MS
                for state, place in ((self.ids, 0), (self.signatures, 0), (self.grams, 1)):
                    for old in [k for k, v in state.iterator() if v[place] < edge]:
                        state.removeKey(old)
            sweep = watermark_ms + max(1, self.ttl_ms // 10)
            self.bus.update((last_id, frames, sweep))
            self.handle.registerTimer(sweep)

    def features(self, bus: str, df: pd.DataFrame) -> pd.DataFrame:
        p = self.params
        n = len(df)
        t, keys = df["t"].to_numpy(), df[KEY].to_numpy()
        out = {"_prev_t": np.full(n, None, object), "_sig1": np.full(n, None, object), "_sig2": np.full(n, None, object)}
        out |= {c: np.full(n, np.nan) for c in PREVIOUS}
        rolling = pd.DataFrame(0.0, index=range(n), columns=["n", "all_mean", "all_std", "cv"])
        for name, rows in df.groupby(KEY, sort=False).indices.items():
            old = self.ids.getValue((name,)) if self.ids.containsKey((name,)) else None
            mine = df.iloc[rows]
            first = [old[0], old[1], old[2]] if old else [None, None, None]
            times = [first[0], *t[rows].tolist()]
            sigs = [first[2], first[1], *mine["sig"].tolist()]
            out["_prev_t"][rows] = times[:-1]
            out["_sig1"][rows], out["_sig2"][rows] = sigs[1:-1], sigs[:-2]
            for c, signal, place in zip(PREVIOUS, SIGNALS, range(5, 10)):
                out[c][rows] = np.concatenate([[np.nan if old is None else old[place]], mine[signal].to_numpy()[:-1]])
            gaps = np.array([np.nan if a is None else float(b - a) for a, b in zip(times, times[1:])])
            earlier = np.frombuffer(old[4], np.float64) if old else np.zeros(0)
            found = rolling_gaps(earlier, gaps, p.interarrival_rows)
            rolling.iloc[rows] = found[["n", "all_mean", "all_std", "cv"]].to_numpy()
            kept = np.concatenate([earlier, gaps[np.isfinite(gaps)]])[-p.interarrival_rows:]
            last = mine.iloc[-1]
            self.ids.updateValue((name,), (int(times[-1]), int(sigs[-1]), None if sigs[-2] is None else int(sigs[-2]),
                                           len(rows), kept.tobytes(), *(float(last[s]) for s in SIGNALS)))

        # sightings of (identifier, signature) and of (identifier, 3-gram)
        before = np.full(n, None, object)
        for (name, sig), rows in df.groupby([KEY, "sig"], sort=False).indices.items():
            k = (name, int(sig))
            seen = self.signatures.getValue(k)[0] if self.signatures.containsKey(k) else None
            before[rows] = [seen, *t[rows][:-1].tolist()]
            self.signatures.updateValue(k, (int(t[rows][-1]),))
        suspicious = np.array([b is not None and a - b > p.replay_suspicion_age_ns for a, b in zip(t.tolist(), before)])
        grams = pd.Series([None if c is None else (k, c, b, a) for k, a, b, c in
                           zip(keys, df["sig"].tolist(), out["_sig1"], out["_sig2"])], dtype=object)
        codes, distinct = pd.factorize(grams)
        marks = []
        for code, k in enumerate(distinct):
            if self.grams.containsKey(k):
                marks.append((code, k[0], *self.grams.getValue(k)))
        last_id, recent, sweep = self.bus.get() if self.bus.exists() else (None, None, None)
        recent = unpacked(recent) if recent is not None else None

        found = self.window_counts(df, codes, suspicious, recent, last_id, marks)
        counts = pd.Series(codes[codes >= 0]).value_counts()
        lasts = pd.Series(t).groupby(codes).max()
        earlier = {m[0]: m[2] for m in marks}
        for code, k in enumerate(distinct):
            self.grams.updateValue(k, (int(earlier.get(code, 0) + counts[code]), int(lasts[code])))
        mine = pd.DataFrame({"t": t, "sequence": df["sequence"], "_ord": df["_ord"], KEY: keys, "sig": df["sig"],
                             "_suspicious": suspicious.astype(np.int64)})
        mine = mine if recent is None else pd.concat([recent, mine], ignore_index=True)
        mine = mine[mine["t"] >= t[-1] - p.halo_ns]
        self.bus.update((keys[-1], packed(mine), sweep))
        result = pd.DataFrame({"_bus": bus, "frame": df["frame"], "document_id": df["document_id"], "_ord": df["_ord"], "_prev_t": out["_prev_t"],
                               **{c: out[c] for c in PREVIOUS}, "_sig1": out["_sig1"], "_sig2": out["_sig2"],
                               "_n_gaps": rolling["n"].astype(np.int64), "rolling_interarrival_mean": rolling["all_mean"],
                               "rolling_interarrival_std": rolling["all_std"], "rolling_cv": rolling["cv"]})
        for c in ("_prev_t", "_sig1", "_sig2"):
            result[c] = result[c].astype("Int64")
        return pd.concat([result, found], axis=1)[OUT.fieldNames()]

    def window_counts(self, df, codes, suspicious, recent, last_id, marks) -> pd.DataFrame:
        """The batch's chunk arithmetic over the frames released now, with the bus's recent frames as copies."""
        params, names = self.arithmetic
        n = len(df)
        own = pd.DataFrame({"_kind": traffic.FRAME, "_at": 1, "_chunk": 1, "_last1": 1, "_last3": 1, "t": df["t"],
                            "sequence": df["sequence"], "_ord": df["_ord"], KEY: df[KEY], "sig": df["sig"],
                            "_suspicious": suspicious.astype(np.int64), "_hist": False, "_row": np.arange(n),
                            "ngram": pd.array(codes, dtype="Int64")})
        own.loc[codes < 0, "ngram"] = pd.NA
        parts = [own]
        if recent is not None and len(recent):
            parts.append(recent.assign(_kind=traffic.FRAME, _at=1, _chunk=0, _last1=1, _last3=1, _hist=False, _row=-1))
        if last_id is not None:
            parts.append(pd.DataFrame({"_kind": [traffic.BUS], "_at": [1], "_mk_id": [last_id]}))
        if marks:
            parts.append(pd.DataFrame([(traffic.NGRAM, 1, *m) for m in marks],
                                      columns=["_kind", "_at", "ngram", KEY, "_mk_n", "_mk_t"]))
        fields = {"_kind": pa.int64(), "_at": pa.int64(), "_chunk": pa.int64(), "_last1": pa.int64(), "_last3": pa.int64(),
                  "t": pa.int64(), "sequence": pa.int64(), "_ord": pa.int64(), KEY: pa.string(), "sig": pa.int64(),
                  "_suspicious": pa.int64(), "_hist": pa.bool_(), "_row": pa.int64(), "ngram": pa.int64(),
                  "_mk_id": pa.string(), "_mk_n": pa.int64(), "_mk_t": pa.int64()}
        schema = pa.schema(fields)
        mine, *others = [pa.table({c: (pa.array(x[c], type=k, from_pandas=True) if c in x else pa.nulls(len(x), k))
                                   for c, k in fields.items()}, schema=schema) for x in parts]
        others = pa.concat_tables(others) if others else schema.empty_table()
        found = traffic.chunk_features(params, names, CHUNK)(mine, others).to_pandas(integer_object_nulls=True)
        found["_ng_t"] = found["_ng_t"].astype("Int64")
        return found.drop(columns="_row")


def keyed_features(frames: DataFrame, params: DetectorParams, processing_ns=None, lateness: str = LATENESS,
                   ttl_ms: int = TTL_MS) -> DataFrame:
    """Baseline-free features of a stream of frames, as ``detect.features`` gives them for a table."""
    text = F.to_json(F.struct(*(F.col(c) for c in FRAME_COLUMNS)))
    decoded = windows.with_bus(detect.decoded_frames(frames, params, processing_ns).withColumn("_ord", F.xxhash64(text)), params)
    # a frame delivered again has the same id: its source position where it has one, else its content
    named = SOURCE if set(SOURCE) <= set(frames.columns) else ("session_id", "sequence", "arbitration_id", "_ord")
    document = hashed_id(*named).alias("document_id")
    narrow = decoded.select("_bus", "t", F.coalesce("sequence", F.lit(traffic.LEAST)).alias("sequence"),
                            F.col("_ord").alias("arrival"), KEY, "sig",
                            *SIGNALS, text.alias("frame"), document, F.timestamp_micros(F.floor(F.col("t") / 1000)).alias("event_time"))
    stream = narrow.withWatermark("event_time", lateness).groupBy("_bus").transformWithStateInPandas(
        BusFeatures(params, ttl_ms), OUT, "Append", "EventTime")
    parsed = stream.withColumn("_f", F.from_json("frame", FRAME_SCHEMA))
    again = parsed.select(*(F.col(f"_f.{c}").alias(c) for c in FRAME_COLUMNS), *(c for c in OUT.fieldNames() if c != "frame"))
    out = decode.decode_frames(again, params, processing_ns)
    out = out.withColumn("ngram", F.when(F.col("_sig2").isNotNull(), F.xxhash64("_sig2", "_sig1", "sig")))
    gap = (F.col("t") - F.col("_prev_t")).cast("double") / NS_PER_MS
    out = out.withColumn("interarrival_ms", F.coalesce(gap, F.lit(0.0)))
    return windows.traffic_columns(windows.add_state_features(out), params)


def keyed_alerts(frames: DataFrame, params: DetectorParams, artifacts: detect.Artifacts, processing_ns=None,
                 lateness: str = LATENESS, ttl_ms: int = TTL_MS) -> DataFrame:
    """Enriched alerts of a stream of frames, with artifacts as ``detect.load_artifacts`` reads them; without a fit all
    frames are warm-up and nothing is flagged."""
    proc = processing_ns if processing_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    fitted = artifacts.fit_key is not None
    out = baselines.learned_features(keyed_features(frames, params, proc, lateness, ttl_ms), artifacts.timing_baseline,
                                     artifacts.transitions, params, F.lit(fitted))
    out = out.withColumn("detector_phase", F.lit("inference" if fitted else "warmup"))
    return detect.enrich(detect.score_and_decide(out, artifacts, params), proc, "document_id")


def rejected(frames: DataFrame) -> DataFrame:
    """What the detector leaves out of a stream, with the reason: a query of its own writes it."""
    return detect.quarantine(frames)


def start_keyed(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "1 second"):
    """Write alerts to a table by event date and label, visible batch by batch."""
    spark = alerts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    dated = alerts.withColumn("event_date", F.to_date("timestamp"))
    writer = dated.writeStream.format("parquet").partitionBy("event_date", "attack_type_label") \
        .option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def start_rejects(rejects: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "1 second"):
    """Write what the detector leaves out."""
    writer = rejects.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def counters(alerts_query, rejects_query) -> dict[str, int]:
    """A13 of the batches that the queries remember: frames read, indexed, anomalies, quarantined, dropped as late."""
    def observed(query, name, field):
        return sum(int((getattr(p.observedMetrics.get(name), field, 0) or 0)) for p in query.recentProgress
                   if p.observedMetrics and name in p.observedMetrics)
    dropped = sum(op.numRowsDroppedByWatermark for p in alerts_query.recentProgress for op in p.stateOperators)
    return {"processed": sum(p.numInputRows for p in alerts_query.recentProgress),
            "indexed": observed(alerts_query, "alerts", "indexed"), "anomalies": observed(alerts_query, "alerts", "anomalies"),
            "quarantined": observed(rejects_query, "rejects", "quarantined"), "late": dropped}


def drain(query, timeout_s: int | None = None) -> None:
    """Graceful stop: finish what is present in the source, then stop between two batches."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(timeout_s)


def compact_alerts(spark: SparkSession, path: str, into: str, before: str) -> int:
    """Rewrite the committed alerts of the days before ``before`` into a table with a file or a few for each day and
    label; only these days are replaced in ``into``.  Returns the number of rows."""
    done, _ = stage_table(spark.read.parquet(path).filter(F.col("event_date") < F.lit(before).cast("date")), "compact")
    write_alerts(done.drop("event_date"), into, "overwrite")
    return done.count()
