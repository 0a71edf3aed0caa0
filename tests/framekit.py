"""Small frame factory for tests (the reference's unit tests build frames the same way)."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from busguard.schema import FRAME_SCHEMA

T0 = 1_700_000_000_000_000_000


def frame(arbitration_id="0x110", payload=None, send_ns=T0, sequence=1, label="normal", vehicle="bus-7",
          scored=None, raw_payload: str | None = None):
    if raw_payload is None:
        payload = payload if payload is not None else {"rpm": 1200.0, "throttle_position": 15.0, "engine_load": 20.0,
                                                       "gear": 2}
        raw_payload = json.dumps(payload)
    return (datetime.fromtimestamp(send_ns / 1e9, tz=timezone.utc).replace(tzinfo=None), send_ns // 1_000_000, send_ns,
            vehicle, "small", sequence, arbitration_id, 8, raw_payload, label, None, scored, None)


def frames_df(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, FRAME_SCHEMA)
    return df.withColumn("_ord", F.monotonically_increasing_id())
