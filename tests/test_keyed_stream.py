"""The keyed streaming query: shuffled arrival, restart, time to live, commits and compaction."""

import glob
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from busguard.params import REFERENCE_BUS
from busguard.plans import detect
from busguard.schema import ALL_FEATURES, FRAME_COLUMNS, FRAME_SCHEMA
from busguard.sources.frames import frames_from_events
from busguard.streaming import keyed

P = REFERENCE_BUS.with_(bus_keys=("vehicle_id",), min_warmup_bus_frequency=3.0, warmup_samples=150)
PROC = detect.FIXTURE_PROCESSING_NS
S = 1_000_000_000


def plain(frames):
    return frames.select(*[F.col(c).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in FRAME_COLUMNS])


@pytest.fixture(scope="module")
def batch_run(spark, tmp_path_factory):
    frames = frames_from_events(spark, "/root/testdata/sf0.001")
    alerts, art = detect.detect(frames, P, F.lit(PROC), materialize=False)
    saved = str(tmp_path_factory.mktemp("fit"))
    detect.save_artifacts(art, saved)
    return plain(frames), alerts.persist(), detect.load_artifacts(spark, saved)


def write_shuffled(spark, frames, folder, parts, lo=0, hi=None, flush=True):
    """Files of frames whose arrival is up to four seconds from their time; a last file far ahead moves the watermark."""
    rows = [tuple(r) for r in frames.collect()]
    at = FRAME_COLUMNS.index("simulator_send_time_ns")
    rng = random.Random(3)
    rows.sort(key=lambda r: r[at] + rng.randrange(4 * S))
    size = -(-len(rows) // parts)
    for i in range(lo, parts if hi is None else hi):
        one = spark.createDataFrame(rows[i * size:(i + 1) * size], FRAME_SCHEMA)
        put(one, folder, i)
    if flush:
        buses = {r[FRAME_COLUMNS.index("vehicle_id")]: r for r in rows}
        late = [tuple(x + 3600 * S if j == at else -1 if c == "sequence" else x for j, (c, x) in
                      enumerate(zip(FRAME_COLUMNS, r))) for r in buses.values()]
        put(spark.createDataFrame(late, FRAME_SCHEMA), folder, 1000)


def put(df, folder, number):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}-tmp{number}")
    [src] = glob.glob(f"{folder}-tmp{number}/*.parquet")
    os.makedirs(folder, exist_ok=True)
    os.replace(src, f"{folder}/part-{number:04d}.parquet")


def run(spark, folder, art, root, **kw):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STATE_STORE)
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = keyed.start_keyed(keyed.keyed_alerts(stream, P, art, F.lit(PROC), lateness="5 seconds", **kw), f"{root}/alerts",
                              f"{root}/ckpt", available_now=True)
    query.awaitTermination(900)
    return query


def compare(spark, alerts, root):
    got = {r["sequence"]: r for r in spark.read.parquet(f"{root}/alerts").collect() if r["sequence"] >= 0}
    want = alerts.filter("detector_phase = 'inference'").collect()
    assert len(got) == 1000 and len(want) > 100
    bad = []
    for w in want:
        g = got[w["sequence"]]
        if list(g["triggered_rules"]) != list(w["triggered_rules"]) or g["is_anomaly"] != w["is_anomaly"]:
            bad.append((w["sequence"], g["triggered_rules"], w["triggered_rules"]))
        fg, fw = g["features"].asDict(), w["features"].asDict()
        bad += [(w["sequence"], c, fg[c], fw[c]) for c in ALL_FEATURES if fg[c] != pytest.approx(fw[c], rel=1e-9, abs=1e-9)]
    assert not bad, bad[:10]


def test_shuffled_arrival_and_restart_give_the_batch_values(spark, batch_run, tmp_path):
    frames, alerts, art = batch_run
    folder = str(tmp_path / "in")
    write_shuffled(spark, frames, folder, 4, 0, 2, flush=False)
    run(spark, folder, art, tmp_path)
    first = spark.read.parquet(f"{tmp_path}/alerts").count()
    assert 100 < first < 600  # some still wait for the watermark
    write_shuffled(spark, frames, folder, 4, 2, 4)
    query = run(spark, folder, art, tmp_path)
    compare(spark, alerts, tmp_path)
    assert max(p["batchId"] for p in query.recentProgress) >= 4
    # the table's log names the files of finished batches: a stray file of an unfinished one is not read
    some = glob.glob(f"{tmp_path}/alerts/*/*/*.parquet")
    os.link(some[0], some[0].replace("part-", "part-9"))
    assert spark.read.parquet(f"{tmp_path}/alerts").filter("sequence >= 0").count() == 1000
    n = keyed.compact_alerts(spark, f"{tmp_path}/alerts", f"{tmp_path}/days", "2999-01-01")
    days = spark.read.parquet(f"{tmp_path}/days")
    assert n == days.count() and days.filter("sequence >= 0").count() == 1000
    assert len(glob.glob(f"{tmp_path}/days/*/*/*.parquet")) < len(some)


def test_without_a_fit_all_frames_are_warm_up(spark, batch_run, tmp_path):
    frames, _, art = batch_run
    write_shuffled(spark, frames.limit(60), str(tmp_path / "in"), 1)
    nothing = detect.Artifacts(None, art.timing_baseline.limit(0), art.transitions.limit(0))
    run(spark, str(tmp_path / "in"), nothing, tmp_path)
    rows = spark.read.parquet(f"{tmp_path}/alerts").collect()
    assert rows and {(r["detector_phase"], r["is_anomaly"]) for r in rows} == {("warmup", False)}


class Memory:
    """A state variable in memory, for the processor alone."""

    def __init__(self):
        self.map, self.one, self.items = {}, None, []

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]

    def iterator(self):
        return iter(list(self.map.items()))

    def exists(self):
        return self.one is not None or bool(self.items)

    def update(self, v):
        self.one = v

    def get(self):
        return iter(self.items) if self.items else self.one

    def put(self, items):
        self.items = items

    def clear(self):
        self.items, self.one = [], None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, *_):
        return self.states.setdefault(name, Memory())

    getValueState = getMapState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_state_stays_flat_in_a_long_stream(spark):
    import pandas as pd
    bus = keyed.BusFeatures(P, ttl_ms=60_000)
    handle = Handle()
    bus.init(handle)
    sizes, n = [], 0
    for step in range(60):
        t0 = step * 10 * S
        rows = pd.DataFrame({"t": t0 + np.arange(40) * 250_000_000, "sequence": np.arange(40), "arrival": np.arange(n, n + 40),
                             "arbitration_key": [f"0x{(step * 40 + i) // 8:03x}" for i in range(40)],
                             "sig": step * 1000 + np.arange(40) % 20, "frame": ["{}"] * 40,
                             **{s: 1.0 for s in keyed.SIGNALS}})
        n += 40
        out = list(bus.handleInputRows(("v",), iter([rows]), Clock((t0 + 9 * S) // 1_000_000)))
        assert sum(map(len, out)) > 0
        sizes.append(sum(len(s.map) for s in handle.states.values()) + sum(len(r[1]) for r in handle.states["waiting"].items) / 1e4)
    assert max(sizes[20:]) <= 1.2 * max(sizes[10:20]) and sizes[-1] < 1000
    assert handle.timers


def test_frames_wait_for_the_watermark_and_leave_in_order(spark):
    import pandas as pd
    bus = keyed.BusFeatures(P, ttl_ms=0)
    bus.init(Handle())

    def sent(times, watermark):
        rows = pd.DataFrame({"t": [t * S for t in times], "sequence": 0, "arrival": list(times), "arbitration_key": "0x110",
                             "sig": 1, "frame": [json.dumps({"t": t}) for t in times], **{s: 0.0 for s in keyed.SIGNALS}})
        out = list(bus.handleInputRows(("v",), iter([rows]), Clock(watermark * 1000)))
        return [int(x) for o in out for x in o["_ord"]], [x for o in out for x in o["_prev_t"]]

    assert sent([5, 3], 0) == ([], [])
    order, before = sent([4, 9], 5)
    assert order == [3, 4, 5] and before[1:] == [3 * S, 4 * S] and before[0] is pd_na()
    later = list(bus.handleExpiredTimer(("v",), Clock(10_000), None))
    assert [int(x) for o in later for x in o["_ord"]] == [9] and int(later[0]["_prev_t"].iloc[0]) == 5 * S


def pd_na():
    import pandas as pd
    return pd.NA
