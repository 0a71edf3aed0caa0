"""Batch detection (the reference's consumer loop as one Spark job) and its building blocks.

decode -> baseline-free features (3 window stages) -> [checkpoint] -> warm-up set (top-N of the
accepted frames) -> timing baseline, transition counts, scaler, forest (all bounded by N) ->
learned features -> model score (pandas UDF) -> rules -> enriched alerts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busguard.functions import decode, rules
from busguard.operators import baselines, forest, windows
from busguard.params import DetectorParams
from busguard.schema import ALL_FEATURES, FEATURE_COLUMNS, FRAME_COLUMNS
from busguard.session import cut_lineage
from busguard.sources.frames import with_row_id

# Processing time used by the registered queries so latency columns are deterministic:
# 100 s after the fixture's time origin (the end of its compressed time line).
FIXTURE_PROCESSING_NS = 100_000_000_000
FEW_ROWS = 100_000  # row ids that are broadcast (2 MB)


@dataclass
class Artifacts:
    fit_key: tuple | None
    timing_baseline: DataFrame
    transitions: DataFrame
    scaler: DataFrame | None = None
    forest_nodes: DataFrame | None = None
    forest: forest.Forest | None = None
    extra: dict = field(default_factory=dict)


def decoded_frames(frames: DataFrame, params: DetectorParams, processing_ns: Column | None = None) -> DataFrame:
    """Decode and keep valid rows (malformed payload JSON goes to ``quarantine``)."""
    return decode.decode_frames(frames, params, processing_ns).filter(F.col("payload_valid"))


def quarantine(frames: DataFrame) -> DataFrame:
    """What ``decoded_frames`` leaves out, with the reason: records that are no frame (with their text), and
    frames whose payload text is not JSON."""
    text = F.col("_corrupt_record") if "_corrupt_record" in frames.columns else F.lit(None).cast("string")
    reason = F.when(text.isNotNull(), F.lit("corrupt_record")).when(
        F.col("payload").isNotNull() & F.try_parse_json("payload").isNull(), F.lit("malformed_payload"))
    return frames.select(*FRAME_COLUMNS, text.alias("record"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def features(frames: DataFrame, params: DetectorParams, processing_ns: Column | None = None,
             keep_text: bool = False, history=None) -> DataFrame:
    """Baseline-free per-frame features."""
    return windows.frame_features(decoded_frames(frames, params, processing_ns), params, keep_text=keep_text,
                                  history=history)


@dataclass
class Features:
    """The features of a table of frames: ``narrow`` (``windows.NARROW`` and the window features) is a stage table, and
    ``wide`` joins it with the decoded frames where it is read, so a reader decodes and joins the columns it names."""
    frames: DataFrame
    params: DetectorParams
    processing_ns: Column | None
    narrow: DataFrame

    @property
    def wide(self) -> DataFrame:
        return self._joined(self.frames, self.narrow)

    def of(self, rows: DataFrame) -> DataFrame:
        """``wide`` for a few rows of ``narrow`` (small enough to broadcast); only their frames are decoded."""
        return self._joined(self.frames.join(F.broadcast(rows.select("_ord")), "_ord", "left_semi"), rows)

    def some(self, rows: DataFrame) -> DataFrame:
        """``wide`` for any rows of ``narrow``; where they are few, only their frames are decoded."""
        if rows.limit(FEW_ROWS + 1).count() > FEW_ROWS:
            return self._joined(self.frames, rows)
        return self.of(cut_lineage(rows))

    def _joined(self, frames: DataFrame, narrow: DataFrame) -> DataFrame:
        # the join keeps the valid frames: ``narrow`` has no others
        return windows.with_decoded(decode.decode_frames(frames, self.params, self.processing_ns), narrow)


def staged_features(frames: DataFrame, params: DetectorParams, processing_ns: Column | None = None,
                    keep_text: bool = False) -> Features:
    """``features`` whose window stages are a stage table."""
    frames = frames if "_ord" in frames.columns else with_row_id(frames)
    decoded = windows.with_bus(decoded_frames(frames, params, processing_ns), params)
    return Features(frames, params, processing_ns, windows.staged_narrow(decoded, params, keep_text=keep_text))


def learn(feats: DataFrame | Features, params: DetectorParams, materialize: bool = True) -> tuple[DataFrame, Artifacts]:
    """Warm-up set and the tables learned from it (no model)."""
    if isinstance(feats, Features):
        # the order of all accepted frames is found on a few columns, the others are read for the first ones alone
        keys = feats.narrow.select(*windows.ORDER, "label", "bus_frequency_1s")
        keys = cut_lineage(baselines.warmup_set(keys, params).select("_ord"))
        first = baselines.warmup_set(feats.narrow.join(F.broadcast(keys), "_ord", "left_semi"), params)
    else:
        first = baselines.warmup_set(feats, params)
    if materialize:
        first = cut_lineage(first)
    point = baselines.fit_point(first, params)
    art = Artifacts(point.key, baselines.timing_baseline(first, params), baselines.transition_matrix(first))
    return feats.of(first) if isinstance(feats, Features) else first, art


def warmup_rows(feats: Features, art: Artifacts) -> DataFrame:
    """The wide frames of the warm-up phase."""
    return feats.some(feats.narrow.filter(baselines.detector_phase(baselines.FitPoint(art.fit_key)) == "warmup"))


def learned(feats: DataFrame, art: Artifacts, params: DetectorParams) -> DataFrame:
    ready = baselines.after_fit(baselines.FitPoint(art.fit_key))
    out = baselines.learned_features(feats, art.timing_baseline, art.transitions, params, ready)
    return out.withColumn("detector_phase", baselines.detector_phase(baselines.FitPoint(art.fit_key)))


def neutral_learned(feats: DataFrame, params: DetectorParams) -> DataFrame:
    """All 56 features with transition and timing features neutral (no baseline, model not ready)."""
    spark = feats.sparkSession
    base = spark.createDataFrame([], "arbitration_id string, median double, mad double, mean double, std double, "
                                     "cv double, count double")
    trans = spark.createDataFrame([], "prev_id string, next_id string, n long, total long, next_ids long")
    return baselines.learned_features(feats, base, trans, params, ready=F.lit(False))


def fit_model(warm: DataFrame, art: Artifacts, params: DetectorParams) -> Artifacts:
    spark = warm.sparkSession
    scaler_df = baselines.feature_scaler(warm)
    scaler_rows = scaler_df.collect()  # 32 rows
    vec = forest.scaled_vector(FEATURE_COLUMNS, scaler_rows)
    warm_vec = warm.select(F.xxhash64(*windows.ORDER).alias("_row"), vec.alias("x"))
    fo, nodes = forest.train(spark, warm_vec, params, n=params.warmup_samples)
    art.scaler, art.forest, art.forest_nodes = scaler_df, fo, nodes
    art.extra["scaler_rows"] = scaler_rows
    return art


def score_and_decide(df: DataFrame, art: Artifacts, params: DetectorParams) -> DataFrame:
    """M2-M4 + rules: model prediction/score (inference phase only), rules, ensemble, reasons."""
    ready = F.col("detector_phase") == "inference"
    if params.use_model and art.forest is not None:
        udf = forest.scoring_udf(df.sparkSession, art.forest)
        vec = forest.scaled_vector(FEATURE_COLUMNS, art.extra["scaler_rows"])
        df = df.withColumn("_m", udf(vec))
        pred = F.when(ready, F.col("_m.prediction")).otherwise(F.lit(1))
        score = F.when(ready, F.col("_m.decision")).otherwise(F.lit(0.0))
    else:
        pred, score = F.lit(1), F.lit(0.0)
    df = df.withColumns({"model_prediction": pred.cast("int"), "anomaly_score": score.cast("double")})
    return decide(df, params).drop("_m")


def decide(df: DataFrame, params: DetectorParams) -> DataFrame:
    """M3, M4, rules and reasons for frames that carry ``model_prediction`` and ``anomaly_score``."""
    ready = F.col("detector_phase") == "inference"
    trig = F.when(ready, rules.triggered_rules(params, F.col("model_prediction"))) \
        .otherwise(F.array().cast("array<string>"))
    df = df.withColumn("triggered_rules", trig)
    mflag = ready & rules.model_flag(F.col("model_prediction"), F.col("anomaly_score"), params)
    df = df.withColumns({
        "model_flag": mflag,
        "rule_flag": F.size("triggered_rules") > 0,
        "rule_score": rules.rule_score(F.col("triggered_rules")),
    })
    df = df.withColumns({
        "is_anomaly": F.col("model_flag") | F.col("rule_flag"),
        "rule_flags": F.col("triggered_rules"),
        "decision_reasons": rules.decision_reasons(F.col("model_flag"), F.col("triggered_rules")),
    })
    return df.withColumn("anomaly_prediction", F.when(F.col("is_anomaly"), F.lit(-1)).otherwise(F.lit(1)))


def enrich(df: DataFrame, processing_ns: Column, *others: str) -> DataFrame:
    """Frame columns + detector fields + the 56-feature struct + latency (and ``others``)."""
    feats = F.struct(*[F.col(c).cast("double").alias(c) for c in ALL_FEATURES])
    return df.select(
        *FRAME_COLUMNS,
        F.col("t").alias("event_time_ns"),
        F.timestamp_micros((processing_ns / 1000).cast("bigint")).alias("detector_timestamp"),
        "detector_phase", "is_anomaly", "anomaly_prediction", "model_prediction", "model_flag",
        "anomaly_score", "rule_flag", "rule_score", "rule_flags", "triggered_rules", "decision_reasons",
        feats.alias("features"),
        decode.pipeline_latency_ms("simulator_send_time_ns", processing_ns).alias("pipeline_latency_ms"),
        *others,
    )


def detect(frames: DataFrame, params: DetectorParams, processing_ns: Column | None = None,
           materialize: bool = True) -> tuple[DataFrame, Artifacts]:
    """Full batch detection; returns (alerts, learned artifacts)."""
    if processing_ns is None:
        processing_ns = F.unix_micros(F.current_timestamp()) * 1000
    if materialize:
        feats = staged_features(frames, params, processing_ns)
        warm, art = learn(feats, params)
        wide = feats.wide
    else:
        wide = features(frames, params, processing_ns)
        warm, art = learn(wide, params, materialize=False)
    if params.use_model and art.fit_key is not None:
        art = fit_model(cut_lineage(warm) if materialize else warm, art, params)
    decided = score_and_decide(learned(wide, art, params), art, params)
    return enrich(decided, processing_ns), art


def save_artifacts(art: Artifacts, path: str) -> None:
    """Learned tables as Parquet plus one small JSON row of scalars (fit point, forest constants)."""
    spark = art.timing_baseline.sparkSession
    art.timing_baseline.write.mode("overwrite").parquet(f"{path}/timing_baseline")
    art.transitions.write.mode("overwrite").parquet(f"{path}/transitions")
    if art.scaler is not None:
        art.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    if art.forest_nodes is not None:
        art.forest_nodes.write.mode("overwrite").parquet(f"{path}/forest_nodes")
    meta = {"fit_key": list(art.fit_key) if art.fit_key else None,
            "psi": art.forest.psi if art.forest else None, "offset": art.forest.offset if art.forest else None}
    spark.createDataFrame([(json_dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_artifacts(spark, path: str) -> Artifacts:
    import json

    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    art = Artifacts(tuple(meta["fit_key"]) if meta["fit_key"] else None,
                    spark.read.parquet(f"{path}/timing_baseline"), spark.read.parquet(f"{path}/transitions"))
    if meta["psi"] is not None:
        nodes = spark.read.parquet(f"{path}/forest_nodes")
        fo = forest.Forest.from_nodes(nodes.toPandas(), meta["psi"])  # bounded node table
        fo.offset = meta["offset"]
        art.forest, art.forest_nodes = fo, nodes
        art.scaler = spark.read.parquet(f"{path}/scaler")
        art.extra["scaler_rows"] = art.scaler.collect()  # 32 rows
    return art


def json_dumps(obj) -> str:
    import json
    return json.dumps(obj)
