"""Chunks by a budget of rows: a burst that holds a third of all frames, and the column arithmetic inside a chunk."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from busguard.operators import chunks, traffic, windows
from busguard.params import REFERENCE_BUS
from busguard.plans import detect
from tests import rowcheck
from tests.framekit import T0, frame, frames_df

BUDGET = 120
IDS = ["0x110", "0x220", "0x330", "0x000", "0x7aa"]


def burst_rows():
    """900 frames over 90 s, but a third of them inside one hundredth of a second."""
    rows = []
    for i in range(900):
        late = i >= 300
        t = T0 + (i * 100_000_000 if i < 300 else 30_000_000_000 + (i - 300) * 33_000 if i < 600 else 50_000_000 + (i - 300) * 100_000_000)
        k = (i * 7 + i // 11) % 5
        payload = {"rpm": 900 + (i // 4) % 3 * 50} if k else {"speed": 40 + i % 2}
        rows.append(frame(IDS[k], payload, t, sequence=i, label="normal" if late or i % 13 else "replay"))
    return rows


PARAMS = REFERENCE_BUS.with_(min_warmup_bus_frequency=5.0, warmup_samples=200, use_model=False, chunk_rows=BUDGET,
                             block_rows=350)


def narrow(spark, params):
    wide = windows.with_bus(detect.decoded_frames(frames_df(spark, burst_rows()), params, F.lit(T0)), params)
    return wide.select(*windows.NARROW)


def test_a_burst_runs_in_tasks_of_the_budget(spark):
    frames = narrow(spark, PARAMS).persist()
    cuts = chunks.time_cuts(frames, PARAMS)
    placed = chunks.with_chunk(frames, PARAMS, cuts)
    at = F.explode(F.array_distinct(F.array("_chunk", "_last1", "_last3")))
    seq = windows.add_sequence_features(placed, PARAMS).withColumn("_hist", F.lit(False)).persist()
    sent = seq.withColumn("_at", at)
    own = placed.groupBy("_chunk").count().collect()
    assert max(r["count"] for r in own) <= BUDGET and len(own) > 8
    assert max(r["count"] for r in sent.groupBy("_at").count().collect()) <= BUDGET
    # what comes for frames that stand in a window all the time: keys of the chunk's frames and a summary
    standing = traffic.standing(seq, sent)
    assert standing.filter(F.col("_kind") == traffic.COUNT).count() > 0
    assert max(r["count"] for r in standing.groupBy("_at").count().collect()) <= BUDGET


def test_no_cuts_without_dense_cells(spark):
    assert chunks.time_cuts(narrow(spark, PARAMS), PARAMS.with_(chunk_rows=100_000)) is None


@pytest.mark.parametrize("ties", [False, True])
def test_burst_values_match_row_checker(spark, ties):
    p = PARAMS.with_(arrival_ties=ties)
    rows = burst_rows()
    if ties:  # the checker goes by arrival; one moment holds more than the budget
        rows += [frame("0x7aa", {"rpm": 1}, rows[450][2], sequence=900 + i) for i in range(150)]
    alerts, _ = detect.detect(frames_df(spark, rows), p, F.lit(T0), materialize=False)
    got = {r["sequence"]: r["features"].asDict() for r in alerts.select("sequence", "features").collect()}
    recs = [{"sequence": r[5], "t": r[2], "key": r[6], "payload": json.loads(r[8]), "label": r[9], "vehicle_id": r[3]}
            for r in rows]
    want = rowcheck.check(recs, lambda r: "", p)
    assert len(got) == len(want) == len(rows)
    columns = ["id_frequency_1s", "bus_frequency_1s", "id_entropy_1s", "dominant_id_ratio", "unique_ids_per_second",
               "payload_repeat_ratio", "bus_utilization", "repeated_id_ratio", "replay_signature_repeats_1s",
               "payload_signature_repeats_3s", "payload_sequence_repeat_count", "payload_sequence_age_ms",
               "transition_probability"]
    bad = [(f["sequence"], c, got[f["sequence"]][c], f[c]) for f in want for c in columns
           if got[f["sequence"]][c] != pytest.approx(f[c], rel=1e-9, abs=1e-9)]
    assert not bad, bad[:10]
    assert max(f["bus_frequency_1s"] for f in want) > 300


def test_envelope_and_counts():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 64, 65):
        begin = rng.integers(0, size, 40)
        end = np.minimum(size, begin + rng.integers(0, size + 1, 40))
        value = rng.integers(-2, 30, 40)
        want = [max([0] + [int(v) for b, e, v in zip(begin, end, value) if b <= x < e]) for x in range(size)]
        assert traffic.envelope(begin, end, value, size, 0).tolist() == want
    key, enters = rng.integers(0, 4, 60), np.sort(rng.integers(0, 20, 60))
    leaves = np.minimum(enters + rng.integers(1, 9, 60), 20)
    base = np.array([0, 3, 0, 1])
    asked = [(k, g) for k in range(4) for g in range(20)]
    want = [sum(1 for a, b, c in zip(key, enters, leaves) if a == k and b <= g < c) for k, g in asked]
    ask = np.array(asked)
    assert traffic.key_counts(key, enters, leaves, 20, ask[:, 0], ask[:, 1]).tolist() == want
    for k, g, before, after, _, _ in zip(*traffic.key_steps(key, enters, leaves, 20, base)):
        here = lambda x: base[k] + sum(1 for a, b, c in zip(key, enters, leaves) if a == k and b <= x < c)  # noqa: B023, E731
        assert after == here(g) and before == (here(g - 1) if g else base[k])


def test_places_among_many_cuts(spark):
    """F2-F16: counts of the cuts at or before a moment, as a binary search finds them; no cuts, one, and many."""
    rng = np.random.default_rng(5)
    rows = [(sorted(rng.choice(400, size=n, replace=False).tolist()) if n else None, int(rng.integers(-5, 405)))
            for n in [0, 1, 2, 3, 7, 8, 9, 217] * 20]
    df = spark.createDataFrame(rows, "cuts array<bigint>, u bigint")
    found = chunks.with_passed(df, {"n": (F.col("cuts"), F.col("u"))}, 217).collect()
    assert all(r["n"] == np.searchsorted(r["cuts"] or [], r["u"], "right") for r in found)


def test_a_frame_finds_its_chunk_by_slot(spark):
    """Cuts at the begin of a slot, inside one, and in the next cell, against counting them all."""
    cell, slot = PARAMS.chunk_ns, PARAMS.chunk_ns // chunks.FINER
    cuts = {0: [0, 3 * slot, 3 * slot + 5, 3 * slot + 9, 700 * slot, cell - 1], 1: [cell + slot, cell + slot + 1]}
    times = sorted({c + d for x in cuts.values() for c in x for d in (-1, 0, 1) if c + d >= 0} | {cell - 10 ** 9, 2 * cell})

    def passed(u):
        return u // cell * chunks.SUB + sum(c <= u for c in cuts.get(u // cell, []))

    for inside in (True, False):
        if not inside:
            cuts = {0: [3 * slot, 700 * slot], 1: [cell + slot]}
        table = spark.createDataFrame([("", k, v) for k, v in cuts.items()], "_bus string, _cell long, cuts array<long>")
        got = chunks.with_chunk(spark.createDataFrame([("", t) for t in times], "_bus string, t long"), PARAMS, table)
        # no cut inside a slot: nothing is searched
        assert ("_of_chunk" in got._jdf.queryExecution().analyzed().toString()) is inside
        for r in got.collect():
            w1, w3 = chunks.spans(PARAMS)
            assert (r["_chunk"], r["_last1"], r["_last3"]) == (passed(r["t"]), passed(r["t"] + w1), passed(r["t"] + w3))
            assert r["_parts"] == len(cuts.get(r["t"] // cell, []))


def test_window_features_are_read_without_the_payload(spark):
    frames = frames_df(spark, burst_rows()[::3])
    staged = detect.staged_features(frames, PARAMS, F.lit(T0))
    assert set(windows.STAGE_OUTPUTS) <= set(staged.narrow.columns) and "payload" not in staged.narrow.columns
    want = detect.features(frames, PARAMS, F.lit(T0))
    assert sorted(want.columns) == sorted(c for c in staged.wide.columns)
    of = lambda df: {r["_ord"]: r.asDict() for r in df.select(sorted(want.columns)).collect()}
    assert of(staged.wide) == of(want)
