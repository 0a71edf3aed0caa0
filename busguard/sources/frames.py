"""Frame sources and the ``events`` table adapter (FIXTURES 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from busguard.schema import FRAME_COLUMNS, FRAME_SCHEMA

# Fixed values of the adapter: time origin and compression, event type -> identifier, fuzz id.
EPOCH_2024_US = 1704067200000000
TIME_COMPRESSION = 25920
EVENT_TYPE_IDS = {"view": "0x110", "click": "0x220", "purchase": "0x330", "signup": "0x550", "error": "0x000"}
FUZZ_ID = "0x7A1"


def with_row_id(df: DataFrame) -> DataFrame:
    """``_ord``: unique row id fixed at the scan (before any shuffle, so every branch of a plan that
    re-reads the source sees the same ids); also the last tiebreak of the event order."""
    return df.withColumn("_ord", F.monotonically_increasing_id())


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread an input that arrives in fewer partitions than the cluster has cores (one small
    file); a large input keeps its scan partitioning and pays no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


#: Text of a JSON line that could not be read; null for good frames and for other formats.
CORRUPT = "_corrupt_record"
JSON_SCHEMA = StructType([*FRAME_SCHEMA.fields, StructField(CORRUPT, StringType())])
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Frames from files with the declared schema (no inference); JSON keeps payload as text and the
    text of lines that are no frame in ``_corrupt_record``, for the quarantine."""
    reader = spark.read.schema(JSON_SCHEMA).options(**JSON_OPTIONS) if fmt == "json" else spark.read
    df = reader.format(fmt).load(path)
    df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(JSON_SCHEMA[c].dataType).alias(c)
                     for c in [*FRAME_COLUMNS, CORRUPT]])
    return spread(with_row_id(df), "_ord")


def stream_frames(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """S2 as a stream: file source with the declared schema."""
    reader = spark.readStream.schema(JSON_SCHEMA).options(**JSON_OPTIONS) if fmt == "json" \
        else spark.readStream.schema(FRAME_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def kafka_options(servers: str, topic: str, starting_offsets: str = "latest", max_offsets: int | None = None,
                  username: str | None = None, password: str | None = None,
                  ca_location: str | None = None,
                  fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the frame stream source (SASL_SSL + PLAIN).

    Expired offsets fail the query unless ``fail_on_data_loss`` is off; ``max_offsets`` bounds the records
    per trigger of all partitions together.  The connector jar is supplied at submit time; the value column
    holds the JSON frame.
    """
    opts = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets:
        opts["maxOffsetsPerTrigger"] = str(max_offsets)
    if username is not None:
        jaas = ("org.apache.kafka.common.security.plain.PlainLoginModule required "
                f'username="{username}" password="{password}";')
        opts.update({"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN",
                     "kafka.sasl.jaas.config": jaas})
    if ca_location:
        opts["kafka.ssl.truststore.type"] = "PEM"
        opts["kafka.ssl.truststore.location"] = ca_location
    return opts


def frames_from_kafka_value(raw: DataFrame) -> DataFrame:
    """Kafka rows -> frame columns; keeps topic/partition/offset for the document id and order."""
    text = F.col("value").cast("string")
    v = F.from_json(text, JSON_SCHEMA, JSON_OPTIONS)
    out = raw.select(v.alias("f"), text.alias("_text"), "topic", "partition", "offset")
    # a null value has no frame either
    return out.select(*[F.col(f"f.{c}").alias(c) for c in FRAME_COLUMNS],
                      F.when(F.col("_text").isNull(), F.lit("")).otherwise(F.col(f"f.{CORRUPT}")).alias(CORRUPT),
                      "topic", "partition", "offset")


def read_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The frames of a topic as a stream; needs the connector on the class path."""
    return frames_from_kafka_value(spark.readStream.format("kafka").options(**options).load())


def write_kafka(frames: DataFrame, options: dict[str, str], topic: str) -> None:
    """Publish frames to a topic."""
    frame_key_value(frames).write.format("kafka").options(**options).option("topic", topic).save()


def frame_key_value(frames: DataFrame) -> DataFrame:
    """Publish form, key ``vehicle_id:arbitration_id`` and the JSON frame as value."""
    return frames.select(F.concat_ws(":", "vehicle_id", "arbitration_id").alias("key"),
                         F.to_json(F.struct(*[F.col(c) for c in frames.columns if c != CORRUPT])).alias("value"))


def frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 7: labelled frames derived from the driver's ``events`` table (integer arithmetic)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = ev.select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    m = F.pmod(F.col("k"), F.lit(4))
    label = (F.when(F.col("event_type") == "error", F.lit("dos"))
             .when(F.col("k") >= 97, F.lit("injection"))
             .when(F.col("k").between(92, 94), F.lit("replay"))
             .when(F.col("k").between(90, 91), F.lit("fuzz"))
             .otherwise(F.lit("normal")))
    arb = F.when(F.col("label") == "fuzz", F.lit(FUZZ_ID))
    for et, aid in EVENT_TYPE_IDS.items():
        arb = arb.when(F.col("event_type") == et, F.lit(aid))
    ev = ev.withColumn("label", label).withColumn("arb", arb)
    inj = F.col("label") == "injection"
    s = lambda c: c.cast("string")
    raw_k = F.concat_ws(",", F.array_repeat(s(F.col("k")), 8))
    zero_raw = '{"brake_pressure":0,"coolant_temp":0,"raw_bytes":[0,0,0,0,0,0,0,0],"rpm":0,"speed":0}'
    payload = (
        F.when(F.col("arb") == "0x110",
               F.when(inj, F.lit('{"rpm":7800}')).otherwise(F.concat(F.lit('{"rpm":'), s(1000 + 100 * m), F.lit("}"))))
        .when(F.col("arb") == "0x220",
              F.concat(F.lit('{"brake_pressure":'), F.when(inj, F.lit("0")).otherwise(s(10 + m)),
                       F.lit(',"wheel_speed_fl":80,"wheel_speed_fr":80}')))
        .when(F.col("arb") == "0x330",
              F.when(inj, F.lit('{"acceleration":9,"speed":250}'))
              .otherwise(F.concat(F.lit('{"acceleration":0,"speed":'), s(40 + m), F.lit("}"))))
        .when(F.col("arb") == "0x550",
              F.when(inj, F.lit('{"battery_voltage":11,"coolant_temp":155}'))
              .otherwise(F.concat(F.lit('{"battery_voltage":14,"coolant_temp":'), s(86 + m), F.lit("}"))))
        .when(F.col("arb") == FUZZ_ID,
              F.concat(F.lit('{"brake_pressure":0,"coolant_temp":0,"raw_bytes":['), raw_k,
                       F.lit('],"rpm":0,"speed":0}')))
        .otherwise(F.lit(zero_raw))
    )
    # microseconds since 2024-01-01 on the wall-clock (NTZ) value: independent of the session time zone
    send_ns = F.expr(f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', "
                     f"cast(ts as timestamp_ntz)) * 1000) div {TIME_COMPRESSION}")
    frames = ev.select(
        F.col("ts").alias("timestamp"),
        (send_ns.cast("bigint") / F.lit(1_000_000)).cast("bigint").alias("event_time_epoch_ms"),
        send_ns.cast("bigint").alias("simulator_send_time_ns"),
        F.concat(F.lit("V"), s(F.col("user_id") % 3)).alias("vehicle_id"),
        F.lit("fixture").alias("session_id"),
        F.col("event_id").alias("sequence"),
        F.col("arb").alias("arbitration_id"),
        F.lit(8).alias("dlc"),
        payload.alias("payload"),
        F.col("label").alias("attack_type_label"),
        F.lit(None).cast("string").alias("attack_phase"),
        F.when(F.col("label") == "replay", F.col("event_id") % 2 == 0).alias("benchmark_scored"),
        F.lit(None).cast("bigint").alias("replayed_original_sequence"),
    )
    # the row id comes last: no filter on decoded columns is pushed below it, where it would build the payload again
    return spread(with_row_id(frames), "sequence")


# DuckDB text of the same adapter (used by the oracle SQL).
FRAMES_SQL = f"""
frames_ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), frames_lab AS (
  SELECT *, k % 4 AS m,
    CASE WHEN event_type = 'error' THEN 'dos' WHEN k >= 97 THEN 'injection'
         WHEN k BETWEEN 92 AND 94 THEN 'replay' WHEN k BETWEEN 90 AND 91 THEN 'fuzz' ELSE 'normal' END AS label
  FROM frames_ev
), frames_arb AS (
  SELECT *, CASE WHEN label = 'fuzz' THEN '{FUZZ_ID}'
    {' '.join(f"WHEN event_type = '{et}' THEN '{aid}'" for et, aid in EVENT_TYPE_IDS.items())} END AS arb
  FROM frames_lab
), frames AS (
  SELECT ts AS "timestamp",
    (((epoch_us(ts) - {EPOCH_2024_US}) * 1000) // {TIME_COMPRESSION}) // 1000000 AS event_time_epoch_ms,
    ((epoch_us(ts) - {EPOCH_2024_US}) * 1000) // {TIME_COMPRESSION} AS simulator_send_time_ns,
    'V' || CAST(user_id % 3 AS VARCHAR) AS vehicle_id,
    'fixture' AS session_id, event_id AS "sequence", arb AS arbitration_id, 8 AS dlc,
    CASE
      WHEN arb = '0x110' THEN CASE WHEN label = 'injection' THEN '{{"rpm":7800}}'
                                   ELSE '{{"rpm":' || CAST(1000 + 100 * m AS VARCHAR) || '}}' END
      WHEN arb = '0x220' THEN '{{"brake_pressure":' || CASE WHEN label = 'injection' THEN '0' ELSE CAST(10 + m AS VARCHAR) END
                              || ',"wheel_speed_fl":80,"wheel_speed_fr":80}}'
      WHEN arb = '0x330' THEN CASE WHEN label = 'injection' THEN '{{"acceleration":9,"speed":250}}'
                                   ELSE '{{"acceleration":0,"speed":' || CAST(40 + m AS VARCHAR) || '}}' END
      WHEN arb = '0x550' THEN CASE WHEN label = 'injection' THEN '{{"battery_voltage":11,"coolant_temp":155}}'
                                   ELSE '{{"battery_voltage":14,"coolant_temp":' || CAST(86 + m AS VARCHAR) || '}}' END
      WHEN arb = '{FUZZ_ID}' THEN '{{"brake_pressure":0,"coolant_temp":0,"raw_bytes":['
          || array_to_string(list_transform(range(8), lambda i: CAST(k AS VARCHAR)), ',') || '],"rpm":0,"speed":0}}'
      ELSE '{{"brake_pressure":0,"coolant_temp":0,"raw_bytes":[0,0,0,0,0,0,0,0],"rpm":0,"speed":0}}'
    END AS payload,
    label AS attack_type_label,
    CAST(NULL AS VARCHAR) AS attack_phase,
    CASE WHEN label = 'replay' THEN event_id % 2 = 0 END AS benchmark_scored,
    CAST(NULL AS BIGINT) AS replayed_original_sequence
  FROM frames_arb
)"""


# ---- the same frames with their times, identifiers and payloads laid anew from the sequence number, so that regular and
# hurried traffic, unseen transitions, odometer rollbacks, flags and unsorted payload keys occur
ROUGH_CYCLE = 5000
ROUGH_IDS = ["0x110", "0x220", "0x330", "0x440", "0x550"]
ROUGH_POS, ROUGH_TURN = f"(\"sequence\" % {ROUGH_CYCLE})", f"(\"sequence\" // {ROUGH_CYCLE})"
ROUGH_SQL = FRAMES_SQL.replace("), frames AS (", "), frames_plain AS (") + f""", frames_laid AS (
  SELECT *, {ROUGH_POS} AS pos, "sequence" // 5 AS tick,
    {ROUGH_TURN} * 50000000000 + CASE
      WHEN {ROUGH_POS} < 1500 OR {ROUGH_POS} >= 4400 THEN {ROUGH_POS} * 8000000 + (("sequence" * 7919) % 13) * 500000
      WHEN {ROUGH_POS} < 3400 THEN 12000000000 + ({ROUGH_POS} - 1500) * 8000000
      WHEN {ROUGH_POS} < 3800 THEN 27200000000 + ({ROUGH_POS} - 3400) * 4000000
      ELSE 28800000000 + ({ROUGH_POS} - 3800) * 8370000 END AS laid
  FROM frames_plain
), frames_valued AS (
  SELECT *, CASE WHEN pos BETWEEN 3400 AND 4399 THEN 4 - "sequence" % 5 ELSE "sequence" % 5 END AS place,
    CASE WHEN pos BETWEEN 3400 AND 3799 THEN 10 + tick % 40 WHEN pos BETWEEN 3800 AND 4399 THEN 60 + tick % 4
         ELSE tick % 4 END AS p
  FROM frames_laid
), frames AS (
  SELECT "timestamp", laid // 1000000 AS event_time_epoch_ms, laid AS simulator_send_time_ns, vehicle_id, session_id, "sequence",
    CASE place {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ROUGH_IDS))} END AS arbitration_id, dlc,
    CASE place
      WHEN 0 THEN '{{"engine_load":' || (20 + p) || ',"gear":' || (1 + p % 5) || ',"rpm":' || (1000 + 10 * p)
                  || ',"throttle_position":' || p || '}}'
      WHEN 1 THEN '{{"abs_active":' || CASE WHEN p % 2 = 0 THEN 'true' ELSE 'false' END || ',"brake_pressure":' || (10 + p)
                  || ',"wheel_speed_fl":80,"wheel_speed_fr":81}}'
      WHEN 2 THEN '{{"acceleration":0,"odometer_km":' || (100 + "sequence" % 700) || ',"speed":' || (40 + p % 4) || '}}'
      WHEN 3 THEN '{{"lane_assist_active":' || CASE WHEN p % 3 = 0 THEN 'true' ELSE 'false' END || ',"steering_angle":' || p
                  || ',"yaw_rate":' || (p + 1) || '}}'
      ELSE '{{"ambient_temp":' || (20 + p) || ',"battery_voltage":14,"coolant_temp":86}}' END AS payload,
    CASE WHEN pos < 1500 OR pos >= 4400 THEN 'normal' ELSE 'replay' END AS attack_type_label, attack_phase,
    CAST(NULL AS BOOLEAN) AS benchmark_scored, replayed_original_sequence
  FROM frames_valued
)"""


def rough_frames(frames: DataFrame) -> DataFrame:
    """``frames`` laid anew as ``ROUGH_SQL`` does; payload keys come unsorted and spaced."""
    seq = F.col("sequence")
    pos, tick = seq % ROUGH_CYCLE, F.floor(seq / 5)
    jitter = pos * 8_000_000 + (seq * 7919 % 13) * 500_000
    at = F.floor(seq / ROUGH_CYCLE) * 50_000_000_000 + F.when((pos < 1500) | (pos >= 4400), jitter) \
        .when(pos < 3400, 12_000_000_000 + (pos - 1500) * 8_000_000) \
        .when(pos < 3800, 27_200_000_000 + (pos - 3400) * 4_000_000).otherwise(28_800_000_000 + (pos - 3800) * 8_370_000)
    place = F.when(pos.between(3400, 4399), 4 - seq % 5).otherwise(seq % 5)
    p = F.when(pos.between(3400, 3799), 10 + tick % 40).when(pos.between(3800, 4399), 60 + tick % 4).otherwise(tick % 4)
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    texts = [F.format_string('{"throttle_position": %d, "rpm": %d, "gear": %d, "engine_load": %d}', p, 1000 + 10 * p, 1 + p % 5, 20 + p),
             F.format_string('{"wheel_speed_fr": 81, "wheel_speed_fl": 80, "brake_pressure": %d, "abs_active": %s}', 10 + p, flag(p % 2 == 0)),
             F.format_string('{"speed": %d, "odometer_km": %d, "acceleration": 0}', 40 + p % 4, 100 + seq % 700),
             F.format_string('{"yaw_rate": %d, "steering_angle": %d, "lane_assist_active": %s}', p + 1, p, flag(p % 3 == 0)),
             F.format_string('{"coolant_temp": 86, "battery_voltage": 14, "ambient_temp": %d}', 20 + p)]

    def pick(values):
        """The value of the row's place, without building the others."""
        found = F.when(place == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            found = found.when(place == i, v)
        return found

    return frames.withColumns({
        "event_time_epoch_ms": F.floor(at / 1_000_000), "simulator_send_time_ns": at.cast("bigint"),
        "arbitration_id": pick([F.lit(x) for x in ROUGH_IDS]), "payload": pick(texts),
        "attack_type_label": F.when((pos < 1500) | (pos >= 4400), F.lit("normal")).otherwise(F.lit("replay")),
        "benchmark_scored": F.lit(None).cast("boolean")})
