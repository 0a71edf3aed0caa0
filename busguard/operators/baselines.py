"""Warm-up gate, learned baselines and the features that read them (SURVEY 2.C F1, 2.E A1-A4, 2.F M5,
2.D W13, W17, W18, W20-W24).

Everything learned comes from the warm-up set: the first ``warmup_samples`` accepted frames.  That
set is a top-k of a filter, so its size is bounded by a parameter, and every table derived from it
(timing baseline: one row per identifier seen in it; transition counts: at most N pairs; scaler:
one row) carries that bound.  Those tables are the only ones we broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busguard.operators import quantiles
from busguard.operators.windows import KEY, ORDER
from busguard.params import DetectorParams
from busguard.schema import FEATURE_COLUMNS


# --------------------------------------------------------------------------- F1 / M5
def accepted_frames(features: DataFrame, params: DetectorParams) -> DataFrame:
    """Frames the warm-up may learn from: label normal (missing counts as normal), stable bus rate."""
    return features.filter((F.col("label") == "normal")
                           & (F.col("bus_frequency_1s") >= F.lit(float(params.min_warmup_bus_frequency))))


def warmup_set(features: DataFrame, params: DetectorParams) -> DataFrame:
    """the first N accepted frames in event order (a bounded top-k, not a global sort)."""
    return accepted_frames(features, params).orderBy(*ORDER).limit(params.warmup_samples)


@dataclass
class FitPoint:
    """Order key of the frame that completes the warm-up set (None: the model never gets ready)."""
    key: tuple | None


def fit_point(warm: DataFrame, params: DetectorParams) -> FitPoint:
    row = warm.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*ORDER)).alias("k")).first()
    if row is None or row["n"] < params.warmup_samples:
        return FitPoint(None)
    return FitPoint(tuple(row["k"]))


def after_fit(point: FitPoint) -> Column:
    """True for frames that come after the warm-up set was complete (inference phase)."""
    if point.key is None:
        return F.lit(False)
    t, seq, ordv = point.key
    c_t, c_s, c_o = F.col("t"), F.col("sequence"), F.col("_ord")
    return ((c_t > F.lit(t)) | ((c_t == F.lit(t)) & ((c_s > F.lit(seq))
                                                     | ((c_s == F.lit(seq)) & (c_o > F.lit(ordv))))))


def detector_phase(point: FitPoint) -> Column:
    """M5: 'warmup' while fewer than N accepted frames precede the frame, else 'inference'."""
    return F.when(after_fit(point), F.lit("inference")).otherwise(F.lit("warmup"))


# --------------------------------------------------------------------------- A1 / A2
def robust_stats(samples: DataFrame, keys: list[str], value: str, bounded: bool = False) -> DataFrame:
    """A1 per key over positive values: exact interpolated median, MAD, mean, population std, cv.

    ``bounded=True`` (groups of a known small size, such as the warm-up samples) uses ``percentile``
    directly; otherwise the medians come from ``quantiles.exact_median``, which never gathers one
    key's values in one task."""
    pos = samples.filter(F.col(value) > 0).select(*keys, value)
    if bounded:
        med = pos.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"),
                                     F.stddev_pop(value).alias("std"), F.count(F.lit(1)).cast("double").alias("count"))
        dev = pos.join(med.select(*keys, "median"), keys).groupBy(*keys).agg(
            F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    else:
        pos = pos.persist()  # two narrow columns, read five times; recomputed where an executor is lost
        moments = pos.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                         F.count(F.lit(1)).alias("n"))
        median = quantiles.exact_median(pos, keys, value)
        med = moments.join(median, keys).withColumn("count", F.col("n").cast("double"))
        devs = pos.join(median, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_d"))
        dev = quantiles.exact_median(devs, keys, "_d").withColumnRenamed("median", "mad")
    out = med.join(dev, keys)
    return out.select(*keys, "median", "mad", "mean", "std",
                      F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)).alias("cv"),
                      "count")


def timing_baseline(warm: DataFrame, params: DetectorParams) -> DataFrame:
    """A2: per identifier, robust stats of its last 1000 positive gaps among warm-up frames."""
    pos = warm.filter(F.col("interarrival_ms") > 0)
    w = Window.partitionBy(KEY).orderBy(*[F.col(c).desc() for c in ORDER])
    recent = pos.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= params.baseline_sample_cap)
    # bounded: at most baseline_sample_cap samples per id, and the warm-up set itself has N rows
    return robust_stats(recent, [KEY], "interarrival_ms", bounded=True).withColumnRenamed(KEY, "arbitration_id")


def transition_matrix(warm: DataFrame) -> DataFrame:
    """A3: counts of (previous accepted id -> id) over the warm-up set, with per-previous totals."""
    w = Window.partitionBy("_bus").orderBy(*ORDER)
    pairs = warm.select(F.lag(KEY).over(w).alias("prev_id"), F.col(KEY).alias("next_id")) \
        .filter(F.col("prev_id").isNotNull() & (F.col("prev_id") != ""))
    counts = pairs.groupBy("prev_id", "next_id").agg(F.count(F.lit(1)).alias("n"))
    totals = Window.partitionBy("prev_id")
    return counts.select("prev_id", "next_id", "n", F.sum("n").over(totals).alias("total"),
                         F.count(F.lit(1)).over(totals).alias("next_ids"))


def feature_scaler(warm: DataFrame) -> DataFrame:
    """A4: one row per model feature with mean and population std (std 0 scales by 1)."""
    aggs = []
    for c in FEATURE_COLUMNS:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = warm.agg(*aggs)
    stack = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in FEATURE_COLUMNS)
    return row.selectExpr(f"stack({len(FEATURE_COLUMNS)}, {stack}) as (feature, mean, std)") \
        .withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


# --------------------------------------------------------------------------- W20-W24, W13, W17, W18
def join_baselines(features: DataFrame, baseline: DataFrame, transitions: DataFrame,
                   ready: Column, baseline_ready: Column | None = None) -> DataFrame:
    """Attach the timing baseline (by id) and transition counts (by previous id) to every frame.

    ``ready``: model ready (transition features are live); ``baseline_ready``: timing baseline is
    live (defaults to ``ready``).  Both lookup tables are bounded by the warm-up size: broadcast.
    """
    baseline_ready = ready if baseline_ready is None else baseline_ready
    b = F.broadcast(baseline.select(F.col("arbitration_id").alias("_b_id"), F.col("median").alias("b_median"),
                                    F.col("mad").alias("b_mad"), F.col("cv").alias("b_cv"),
                                    F.col("count").alias("b_count")))
    pair = F.broadcast(transitions.select(F.col("prev_id").alias("_t_prev"), F.col("next_id").alias("_t_next"),
                                          F.col("n").alias("t_n")))
    tot = F.broadcast(transitions.select(F.col("prev_id").alias("_u_prev"), F.col("total").alias("t_total"),
                                         F.col("next_ids").alias("t_k")).dropDuplicates(["_u_prev"]))
    out = features.withColumns({"_ready": ready, "_bready": baseline_ready})
    out = out.join(b, (F.col(KEY) == F.col("_b_id")) & F.col("_bready"), "left")
    out = out.join(pair, (F.col("previous_bus_id") == F.col("_t_prev")) & (F.col(KEY) == F.col("_t_next"))
                   & F.col("_ready"), "left")
    out = out.join(tot, (F.col("previous_bus_id") == F.col("_u_prev")) & F.col("_ready"), "left")
    return out.drop("_b_id", "_t_prev", "_t_next", "_u_prev")


def add_transition_features(df: DataFrame, params: DetectorParams) -> DataFrame:
    """W20 (neutral without previous id, before the model is ready, or with fewer than 20 samples)."""
    total = F.coalesce(F.col("t_total"), F.lit(0))
    k = F.greatest(F.lit(1), F.coalesce(F.col("t_k"), F.lit(0)))
    p = (F.coalesce(F.col("t_n"), F.lit(0)) + F.lit(params.transition_alpha)) / (total + F.lit(params.transition_alpha) * k)
    neutral = (~F.col("_ready") | F.col("previous_bus_id").isNull() | (F.col("previous_bus_id") == "")
               | (total < params.transition_min_total))
    return df.withColumns({
        "transition_probability": F.when(neutral, F.lit(1.0)).otherwise(p),
        "transition_surprise": F.when(neutral, F.lit(0.0)).otherwise(-F.log(F.greatest(p, F.lit(1e-9)))),
        "rare_transition_flag": F.when(neutral, F.lit(0.0))
        .when(p < F.lit(params.transition_rare_below), F.lit(1.0)).otherwise(F.lit(0.0)),
    })


def add_timing_features(df: DataFrame, params: DetectorParams) -> DataFrame:
    """W21-W24 from the baseline columns, then W13 (payload timing replay) and W17/W18 (3-gram)."""
    gap = F.col("interarrival_ms")
    neutral = (F.col("b_count").isNull() | (F.col("b_count") < params.baseline_min_timing_samples) | (gap <= 0))
    mad = F.greatest(F.col("b_mad"), F.lit(0.5))
    z = (gap - F.col("b_median")) / (F.lit(1.4826) * mad)
    ratio = F.col("rolling_cv") / F.greatest(F.col("b_cv"), F.lit(0.01))
    exact = ((F.least(F.col("_n_gaps"), F.lit(params.interarrival_rows)) >= params.baseline_min_timing_samples)
             & (F.col("b_cv") >= 0.03) & (ratio <= F.lit(params.exactness_cv_ratio)))
    score = F.least(F.lit(1.0), F.greatest(F.abs(z) / 8.0,
                                           F.when(exact, F.lit(1.0) - F.least(F.lit(1.0), ratio)).otherwise(F.lit(0.0))))
    zero, one = F.lit(0.0), F.lit(1.0)
    df = df.withColumns({
        "iat_robust_z": F.when(neutral, zero).otherwise(z),
        "iat_drop_flag": F.when(neutral, zero).when(z <= -params.iat_robust_z, one).otherwise(zero),
        "iat_spike_flag": F.when(neutral, zero).when(z >= params.iat_robust_z, one).otherwise(zero),
        "iat_exactness_ratio": F.when(neutral, one).otherwise(ratio),
        "iat_exactness_flag": F.when(neutral, zero).when(exact, one).otherwise(zero),
        "timing_anomaly_score": F.when(neutral, zero).otherwise(score),
    })
    boosted = F.col("timing_anomaly_score")
    boosted = F.when(F.col("iat_spike_flag") == 1.0, F.greatest(boosted, F.lit(0.75))).otherwise(boosted)
    boosted = F.when(F.col("iat_exactness_flag") == 1.0, F.greatest(boosted, F.lit(0.65))).otherwise(boosted)
    df = df.withColumn("payload_timing_replay_score", F.col("payload_repeat_score") * boosted)
    med = F.coalesce(F.col("b_median"), F.lit(0.0))
    tighter = (med > 0) & (gap > 0) & (gap <= med * F.lit(params.ngram_tight_ratio))
    tight = tighter | (F.col("iat_drop_flag") == 1.0) | (F.col("iat_exactness_flag") == 1.0)
    has_ng = F.col("ngram").isNotNull()
    rep = F.col("payload_sequence_repeat_count")
    replay = (F.when(rep >= params.ngram_min_repeats, 0.45).otherwise(0.0)
              + F.when((rep >= params.ngram_min_repeats) & tight, 0.45).otherwise(0.0)
              + F.when((rep >= 1) & (F.col("timing_anomaly_score") >= 0.65), 0.25).otherwise(0.0))
    return df.withColumns({
        "payload_sequence_tight_timing_flag": F.when(has_ng & tight, one).otherwise(zero),
        "payload_sequence_replay_score": F.when(has_ng, F.least(one, replay)).otherwise(zero),
    })


def learned_features(features: DataFrame, baseline: DataFrame, transitions: DataFrame,
                     params: DetectorParams, ready: Column, baseline_ready: Column | None = None) -> DataFrame:
    out = join_baselines(features, baseline, transitions, ready, baseline_ready)
    out = add_transition_features(out, params)
    out = add_timing_features(out, params)
    return out.drop("b_median", "b_mad", "b_cv", "b_count", "t_n", "t_total", "t_k", "_bready")
