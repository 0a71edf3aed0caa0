"""Per-frame trailing-window and sequence features.

The reference keeps one process-wide state and walks frames one by one.  Here every feature is a
window expression, and no window is ever partitioned by a key that can hold a large share of the
rows on its own (one bus, one identifier, one payload):

chunks   ``chunks.with_chunk``: time chunks of a bus, cut further where a cell of the grid exceeds a budget of rows.
stage 1  ``sequence_position``: the 0-based position of a frame inside its (bus, id) sequence, from
         per-(bus, id, time chunk) counts, a running sum over the small count table, and
         ``row_number`` inside the chunk.
stage 2  ``add_sequence_features``: rows are cut into blocks of ``block_rows`` positions; the last
         ``interarrival_rows`` rows of each block are copied into the next block (a row halo), so
         ``lag`` and the 300-row rolling frames are exact inside (bus, id, block) partitions.  The last
         earlier sighting of an (id, signature) enters a block as one row from a running aggregate over blocks.
stage 3  ``add_traffic_features``: one grouped pass per chunk over whole columns (``traffic``).

All stages run on a narrow projection (``NARROW``); ``frame_features`` joins the results
back to the wide decoded frame once, on the scan row id.  Streaming passes earlier sightings in
as ``history`` (before all blocks and chunks).

Frames with equal event time are peers of a time window (``arrival_ties``: only those already arrived count); ``lag``
and running counts order by (t, sequence, _ord).  Bounds on windows are off unless parameters set them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busguard.operators import traffic
from busguard.operators.chunks import floor_div, time_cuts, with_chunk
from busguard.operators.traffic import KEY, ORDER
from busguard.params import NS_PER_MS, NS_PER_S, DetectorParams
from busguard.session import stage_table


def with_bus(df: DataFrame, params: DetectorParams) -> DataFrame:
    """Single ``_bus`` key column (constant when ``bus_keys`` is empty: one merged bus)."""
    if params.bus_keys:
        bus = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in params.bus_keys])
    else:
        bus = F.lit("")
    out = df.withColumn("_bus", bus)
    if "_ord" not in out.columns:
        out = out.withColumn("_ord", F.monotonically_increasing_id())
    return out


# --------------------------------------------------------------------------- stage 1
def sequence_position(df: DataFrame, keys: list[str], pos_col: str = "_pos") -> DataFrame:
    """0-based position of each row inside ``keys`` ordered by ORDER; needs ``_chunk``.

    A key holding a third of all rows is still split into one task per time chunk: only the
    count table (one row per key and chunk) is ordered per key.  ``_end``: the last row of its key in its chunk.
    """
    counts = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = df.join(offsets, on=[*keys, "_chunk"], how="inner")
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER)
    joined = joined.withColumn("_nth", F.row_number().over(in_chunk))
    return joined.withColumns({pos_col: F.col("_base") + F.col("_nth") - 1, "_end": F.col("_nth") == F.col("_n")}) \
        .drop("_base", "_n", "_nth")


# --------------------------------------------------------------------------- stage 2
def earlier_sightings(df: DataFrame, keys: list[str], history: DataFrame | None) -> DataFrame:
    """One row per (id, signature, block) with the last sighting in earlier blocks (``_seen``) and the first one in
    earlier runs (``_seen_first``).  ``history`` rows come before all blocks."""
    seen = df.groupBy(*keys, "sig", "_blk").agg(F.max("t").alias("_t"), F.lit(None).cast("bigint").alias("_first"))
    if history is not None:
        seen = seen.unionByName(history.select(*keys, "sig", F.lit(None).cast("bigint").alias("_blk"),
                                               F.lit(None).cast("bigint").alias("_t"), F.col("first_t").alias("_first")))
    w = Window.partitionBy(*keys, "sig").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.select(*keys, "sig", "_blk", F.max("_t").over(w).alias("_seen"), F.min("_first").over(w).alias("_seen_first"))
    return seen.filter(F.col("_blk").isNotNull() & (F.col("_seen").isNotNull() | F.col("_seen_first").isNotNull()))


def add_sequence_features(df: DataFrame, params: DetectorParams, keep_text: bool = False,
                          history: DataFrame | None = None) -> DataFrame:
    """W1, W10 (+ positive-gap cv for W23), W14 (3-gram key), W25-W27 per (bus, id) sequence, and the frames whose
    signature was seen before with some distance (``_suspicious``, counted by W11).

    Input needs ``_bus``, ``_chunk``, ``t``, signals, ``sig``.  Adds ``_pos`` (position in the id
    sequence) and the columns below; rows are unchanged.

    The rolling gap statistics are exact: gaps are integer nanoseconds, their sums (bigint: a sum of
    gaps is a stretch of event time) and sums of squares (decimal(38,0)) over the last
    ``interarrival_rows`` gaps are taken as the difference of two running totals (both growing frames,
    O(1) per row), and mean / population std come from one final floating division.  Gaps of zero add
    nothing to either sum, so all gaps and the positive ones share them; only the counts differ.
    """
    rows = params.interarrival_rows
    block = params.block_rows
    if block <= rows:
        raise ValueError("block_rows must exceed interarrival_rows")
    keys = ["_bus", KEY]
    df = sequence_position(df, keys)
    df = df.withColumn("_blk", floor_div(F.col("_pos"), block))
    copy = F.when(F.pmod(F.col("_pos"), F.lit(block)) >= block - rows, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    ext = (df.withColumn("_copy", F.explode(copy))
             .withColumn("_blk", F.col("_blk") + F.col("_copy"))
             .withColumn("_rhalo", F.col("_copy") == 1).drop("_copy"))
    seen = earlier_sightings(df, keys, history).withColumn("_mark", F.lit(True))
    # one exchange for all windows; the sightings are a partition of their own in the first
    ext = ext.withColumn("_mark", F.lit(False)).unionByName(seen, allowMissingColumns=True).repartition(*keys, "_blk")

    by_sig = Window.partitionBy(*keys, "_blk", "sig").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    ext = ext.withColumns({
        "_before": F.last(F.when(F.col("_mark"), F.col("_seen")).otherwise(F.col("t")), ignorenulls=True).over(by_sig),
        "_first": F.last("_seen_first", ignorenulls=True).over(by_sig)}).filter(~F.col("_mark"))
    # a sighting of an earlier run that no kept frame shows is older than every window
    suspicious = F.when(F.col("_before").isNotNull(), F.col("t") - F.col("_before") > params.replay_suspicion_age_ns) \
        .otherwise(F.coalesce(F.col("_first") < F.col("t"), F.lit(False)))
    ext = ext.withColumn("_suspicious", suspicious.cast("bigint")).drop("_before", "_first", "_seen", "_seen_first", "_mark")

    w = Window.partitionBy(*keys, "_blk").orderBy("_pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    older = w.rowsBetween(Window.unboundedPreceding, -rows)
    ext = ext.withColumn("_prev_t", F.lag("t").over(w))
    gap_ns = F.col("t") - F.col("_prev_t")
    dec = "decimal(38,0)"
    ext = ext.withColumns({"_g": gap_ns, "_g2": gap_ns.cast(dec) * gap_ns.cast(dec)})
    g = F.col("_g")
    sums = {}
    for name, expr, zero in (("_an", F.count(g), F.lit(0)), ("_pn", F.count(F.when(g > 0, g)), F.lit(0)),
                             ("_s1", F.sum(g), F.lit(0)), ("_s2", F.sum("_g2"), F.lit(0).cast(dec))):
        sums[name] = F.coalesce(expr.over(upto), zero) - F.coalesce(expr.over(older), zero)
    lag1, lag2 = F.lag("sig", 1).over(w), F.lag("sig", 2).over(w)
    cols = {
        "interarrival_ms": F.coalesce(gap_ns.cast("double") / NS_PER_MS, F.lit(0.0)),
        **sums,
        "ngram": F.when(lag2.isNotNull(), F.xxhash64(lag2, lag1, F.col("sig"))),
        "_prev_speed": F.lag("speed").over(w),
        "_prev_rpm": F.lag("rpm").over(w),
        "_prev_coolant": F.lag("coolant_temp").over(w),
        "_prev_brake": F.lag("brake_pressure").over(w),
        "_prev_odometer": F.lag("odometer_km").over(w),
    }
    if keep_text:
        cols["ngram_text"] = F.when(
            lag2.isNotNull(),
            F.array(F.lag("payload_signature", 2).over(w), F.lag("payload_signature", 1).over(w),
                    F.col("payload_signature")))
    ext = ext.withColumns(cols)

    def mean_std(count: str) -> tuple[Column, Column]:
        n, s1, s2 = F.col(count), F.col("_s1").cast(dec), F.col("_s2")
        mean = s1.cast("double") / n.cast("double") / NS_PER_MS
        var = (n.cast(dec) * s2 - s1 * s1).cast("double") / (n.cast("double") * n.cast("double"))
        return (F.when(n > 0, mean).otherwise(F.lit(0.0)),
                F.when(n > 0, F.sqrt(var) / NS_PER_MS).otherwise(F.lit(0.0)))

    g_mean, g_std = mean_std("_an")
    p_mean, p_std = mean_std("_pn")
    ext = ext.withColumns({
        "_n_gaps": F.col("_an"),
        "rolling_interarrival_mean": g_mean,
        "rolling_interarrival_std": g_std,
        "rolling_cv": F.when(p_mean > 0, p_std / p_mean).otherwise(F.lit(0.0)),
    })
    ext = add_state_features(ext)
    return ext.filter(~F.col("_rhalo")).drop("_rhalo", "_blk", "_g", "_g2", *sums.keys())


def add_state_features(df: DataFrame) -> DataFrame:
    """W25-W27 from the previous frame of the same id (columns ``_prev_*``, ``_prev_t``)."""
    first = F.col("_prev_t").isNull()
    elapsed = F.greatest(F.lit(1e-3), (F.col("t") - F.col("_prev_t")).cast("double") / NS_PER_S)
    speed_d = (F.col("speed") - F.col("_prev_speed")) * F.lit(0.277778) / elapsed
    rpm_d = F.abs(F.col("rpm") - F.col("_prev_rpm")) / elapsed
    cool_d = F.abs(F.col("coolant_temp") - F.col("_prev_coolant")) / elapsed
    brake_d = (F.col("_prev_brake") - F.col("brake_pressure")) / elapsed
    rollback = ((F.col("odometer_km") >= 0) & (F.col("_prev_odometer") >= 0)
                & (F.col("odometer_km") + F.lit(0.001) < F.col("_prev_odometer")))
    score = (F.when(F.abs(speed_d) > 12.0, 0.45).otherwise(0.0)
             + F.when(rpm_d > 4500.0, 0.30).otherwise(0.0)
             + F.when(cool_d > 8.0, 0.25).otherwise(0.0)
             + F.when((brake_d > 500.0) & (F.col("brake_pressure") <= 0.1), 0.30).otherwise(0.0)
             + F.when(rollback, 0.50).otherwise(0.0))
    zero = F.lit(0.0)
    return df.withColumns({
        "speed_delta_mps2": F.when(first, zero).otherwise(speed_d),
        "rpm_delta_per_second": F.when(first, zero).otherwise(rpm_d),
        "coolant_delta_per_second": F.when(first, zero).otherwise(cool_d),
        "brake_drop_per_second": F.when(first, zero).otherwise(brake_d),
        "odometer_rollback_flag": F.when(first, zero).when(rollback, F.lit(1.0)).otherwise(zero),
        "state_transition_violation_score": F.when(first, zero).otherwise(F.least(F.lit(1.0), score)),
    })


# --------------------------------------------------------------------------- stage 3
def capped(count: Column, cap: int | None) -> Column:
    """``count``, saturated at an optional bound."""
    return count if cap is None else F.least(count, F.lit(cap))


def add_traffic_features(seq: DataFrame, params: DetectorParams, with_cuts: bool,
                         history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """W2-W9, W11, W12, W15, W16, W19 over time chunks; ``seq`` is a stage-2 output."""
    out = traffic_columns(traffic.chunk_table(seq, params, with_cuts, history), params)
    keep = [c for c in out.columns if not c.startswith("_") or c in ("_ord", "_bus", "_pos", "_n_gaps")]
    return out.select(*keep)


def traffic_columns(out: DataFrame, params: DetectorParams) -> DataFrame:
    """The features from a chunk's counts (``traffic.FOUND``)."""
    n = F.col("_d_n").cast("double")
    id_total = capped(F.col("_d_idn"), params.id_arrival_cap).cast("double")
    entropy = F.log2(n) - F.col("_d_s") / n
    norm = F.log2(F.greatest(F.lit(2.0), F.col("_d_k").cast("double")))
    has_ng = F.col("ngram").isNotNull()
    sightings = None if params.ngram_sighting_cap is None else params.ngram_sighting_cap - 1
    out = out.withColumns({
        "id_frequency_1s": id_total,
        "bus_frequency_1s": n,
        "id_entropy_1s": F.when(F.col("_d_n") <= 1, F.lit(0.0)).otherwise(entropy / norm),
        "dominant_id_ratio": F.when(n > 0, F.col("_d_idmax") / n).otherwise(F.lit(0.0)),
        "unique_ids_per_second": F.col("_d_k").cast("double"),
        "bus_utilization": F.least(F.lit(1.0), n / F.lit(params.bus_capacity_per_s)),
        "repeated_id_ratio": F.when(n > 0, id_total / n).otherwise(F.lit(0.0)),
        "payload_repeat_ratio": F.when(n > 0, F.col("_d_sigmax") / n).otherwise(F.lit(0.0)),
        "replay_signature_repeats_1s": capped(F.col("_replay_n"), params.replay_suspicion_cap).cast("double"),
        "payload_signature_repeats_3s": (capped(F.col("_sig_n3"), params.signature_time_cap) - 1).cast("double"),
        "previous_bus_id": F.col("_prev_bus_id"),
        "payload_sequence_repeat_count": F.when(has_ng, capped(F.col("_ng_n"), sightings).cast("double"))
        .otherwise(F.lit(0.0)),
        "payload_sequence_age_ms": F.when(has_ng & F.col("_ng_t").isNotNull(),
                                          (F.col("t") - F.col("_ng_t")).cast("double") / NS_PER_MS).otherwise(F.lit(0.0)),
    })
    return out.withColumn("payload_repeat_score", F.least(F.lit(1.0), F.col("payload_signature_repeats_3s") / 12.0))


# Columns the window stages read (and the label, for the warm-up gate); everything else is joined back on ``_ord``.
NARROW = ["_bus", "t", "sequence", "_ord", KEY, "label", "sig", "speed", "rpm", "coolant_temp",
          "brake_pressure", "odometer_km"]
STAGE_OUTPUTS = ["interarrival_ms", "_n_gaps", "rolling_interarrival_mean", "rolling_interarrival_std", "rolling_cv",
                 "ngram", "speed_delta_mps2", "rpm_delta_per_second", "coolant_delta_per_second",
                 "brake_drop_per_second", "odometer_rollback_flag", "state_transition_violation_score",
                 "id_frequency_1s", "bus_frequency_1s", "id_entropy_1s", "dominant_id_ratio", "unique_ids_per_second",
                 "bus_utilization", "repeated_id_ratio", "payload_repeat_ratio", "replay_signature_repeats_1s",
                 "payload_signature_repeats_3s", "payload_repeat_score", "previous_bus_id",
                 "payload_sequence_repeat_count", "payload_sequence_age_ms"]


def narrow_features(wide: DataFrame, params: DetectorParams, keep_text: bool = False,
                    history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``NARROW`` and ``STAGE_OUTPUTS`` (and ``ngram_text``) of decoded frames ``with_bus``: the features of SURVEY 2.D
    without the decoded columns that no window reads.

    The narrow frame feeds the cuts, stage 1 and the carries, and the stage-2 rows feed stage 3 and the 3-gram carries,
    so both are persisted (recomputed from lineage if an executor is lost).
    """
    cols = NARROW + (["payload_signature"] if keep_text else []) + (["_hist"] if "_hist" in wide.columns else [])
    frames = wide.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    cuts = time_cuts(frames, params)
    narrow = with_chunk(frames, params, cuts)
    signatures = history[0] if history is not None else None
    seq = add_sequence_features(narrow, params, keep_text=keep_text, history=signatures)
    seq = seq.drop("payload_signature").persist(StorageLevel.MEMORY_AND_DISK)
    feats = add_traffic_features(seq, params, cuts is not None, history)
    out = feats.select(*NARROW, *STAGE_OUTPUTS, *(["ngram_text"] if keep_text else []))
    # released by callers that materialise ``out``
    out._busguard_cached = (frames, seq, *(() if cuts is None else (cuts,)))
    return out


def with_decoded(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """``narrow_features`` joined with the decoded frames they were made of; what both have is taken from ``narrow``."""
    return wide.drop(*(c for c in NARROW if c != "_ord")).join(narrow, "_ord")


def frame_features(decoded: DataFrame, params: DetectorParams, keep_text: bool = False,
                   history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All baseline-free features of SURVEY 2.D for decoded frames: the window stages see only the narrow columns, and
    the wide frame (payload text, decoded signals, labels) is joined back once on ``_ord``."""
    wide = with_bus(decoded, params)
    narrow = narrow_features(wide, params, keep_text, history)
    out = with_decoded(wide, narrow)
    out._busguard_cached = narrow._busguard_cached
    return out


def staged_narrow(wide: DataFrame, params: DetectorParams, keep_text: bool = False) -> DataFrame:
    """``narrow_features`` as a stage table (columns are pruned where it is read again); nothing stays cached."""
    narrow = narrow_features(wide, params, keep_text)
    staged, _ = stage_table(narrow, "features")
    release(narrow)
    return staged


def release(df: DataFrame) -> None:
    """Unpersist the intermediate tables a ``frame_features`` result keeps cached."""
    for c in getattr(df, "_busguard_cached", ()):
        c.unpersist()
