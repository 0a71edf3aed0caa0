"""Command line: detect -> artifacts -> evaluate -> gates on the sf0.001 fixture."""

import glob
import json
import tempfile

from pyspark.sql import functions as F

from busguard.__main__ import main
from busguard.plans import detect
from busguard.schema import FRAME_COLUMNS, FRAME_SCHEMA
from busguard.sources.frames import frames_from_events


def test_cli_round_trip(spark):
    d = tempfile.mkdtemp(prefix="bg-cli-")
    frames = frames_from_events(spark, "/root/testdata/sf0.001")
    frames.select(*[F.col(c).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_COLUMNS]) \
        .write.parquet(f"{d}/frames")
    assert main(["detect", "--frames", f"{d}/frames", "--alerts", f"{d}/alerts-a", "--artifacts", f"{d}/art",
                 "--warmup-samples", "200", "--bus-keys"]) == 0
    art = detect.load_artifacts(spark, f"{d}/art")
    assert art.fit_key is None  # sf0.001 never reaches the default warm-up gate of 100 frames/s
    assert main(["evaluate", "--alerts", f"{d}/alerts-*", "--json-out", f"{d}/r.json", "--csv-out", f"{d}/r.csv"]) == 0
    assert glob.glob(f"{d}/r.csv/*.csv")
    assert main(["gates", "--alerts", f"{d}/alerts-*"]) == 1  # no anomalies flagged -> gates fail
    # a lower gate reaches the model; the saved forest scores like the fitted one
    assert main(["detect", "--frames", f"{d}/frames", "--alerts", f"{d}/alerts-b", "--artifacts", f"{d}/art2",
                 "--warmup-samples", "200", "--min-warmup-bus-frequency", "5", "--bus-keys"]) == 0
    art2 = detect.load_artifacts(spark, f"{d}/art2")
    assert art2.fit_key is not None and art2.forest is not None and len(art2.extra["scaler_rows"]) == 32
    import numpy as np
    x = np.random.default_rng(1).normal(size=(50, 32))
    again = detect.load_artifacts(spark, f"{d}/art2").forest
    assert np.allclose(art2.forest.score_samples(x), again.score_samples(x))
    assert spark.read.parquet(f"{d}/alerts-b").filter("detector_phase = 'inference'").count() > 0


def test_cli_stream_with_saved_artifacts(spark):
    d = tempfile.mkdtemp(prefix="bg-cli-stream-")
    frames = frames_from_events(spark, "/root/testdata/sf0.001")
    frames.select(*[F.col(c).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_COLUMNS]) \
        .coalesce(1).write.parquet(f"{d}/frames")
    assert main(["detect", "--frames", f"{d}/frames", "--alerts", f"{d}/alerts-batch", "--artifacts", f"{d}/art",
                 "--warmup-samples", "200", "--min-warmup-bus-frequency", "5", "--bus-keys"]) == 0
    assert main(["stream", "--frames", f"{d}/frames", "--format", "parquet", "--alerts", f"{d}/alerts-stream",
                 "--artifacts", f"{d}/art", "--checkpoint", f"{d}/ckpt", "--available-now",
                 "--min-warmup-bus-frequency", "5", "--warmup-samples", "200", "--bus-keys"]) == 0
    got = spark.read.parquet(f"{d}/alerts-stream")
    assert got.count() == 1000 and got.filter(F.col("anomaly_score") != 0).count() > 0
    assert spark.read.parquet(f"{d}/alerts-batch").select("document_id").distinct().count() == 1000


def test_cli_stream_per_vehicle(spark, capsys):
    d = tempfile.mkdtemp(prefix="bg-cli-keyed-")
    frames = frames_from_events(spark, "/root/testdata/sf0.001")
    plain = frames.select(*[F.col(c).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_COLUMNS])
    for i in range(4):  # four batches in time order, the second with a line that is no frame
        plain.filter(f"sequence div 250 = {i}").coalesce(1).write.mode("append").json(f"{d}/frames")
        if i == 1:
            with open(f"{d}/frames/broken.json", "w") as f:
                f.write("no frame\n")
    assert main(["detect", "--frames", f"{d}/frames", "--format", "json", "--alerts", f"{d}/alerts-batch", "--artifacts",
                 f"{d}/art", "--warmup-samples", "150", "--min-warmup-bus-frequency", "3"]) == 0
    assert main(["stream", "--frames", f"{d}/frames", "--alerts", f"{d}/alerts", "--artifacts", f"{d}/art", "--checkpoint",
                 f"{d}/ckpt", "--available-now", "--lateness", "2 seconds", "--max-files", "1"]) == 0
    got = spark.read.parquet(f"{d}/alerts")
    n = got.count()
    # the newest frames wait for the watermark to pass them
    assert 500 < n < 1000 and got.select("document_id").distinct().count() == n
    assert set(got.select("detector_phase").distinct().toPandas()["detector_phase"]) == {"inference"}
    counted = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counted["indexed"] == n and counted["processed"] == 1001 and counted["quarantined"] == 1
    assert spark.read.parquet(f"{d}/ckpt-quarantine").count() == 1
    assert main(["evaluate", "--alerts", f"{d}/alerts", "--json-out", f"{d}/r.json", "--csv-out", f"{d}/r.csv"]) == 0
    assert main(["gates", "--alerts", f"{d}/alerts", "--produced", "5000"]) == 1
    assert "outside 4900..5100" in capsys.readouterr().out
