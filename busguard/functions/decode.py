"""Per-frame scalar functions (JVM-side column expressions, no Python UDFs).

Each function maps columns to a column; ``decode_frames`` applies them all in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busguard.params import NS_PER_MS, DetectorParams
from busguard.schema import BOOL_SIGNALS, NUMERIC_SIGNALS

_NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL", "BOOLEAN")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_arbitration_id(arb) -> Column:
    """Null -> -1; '0x..' (any case) -> base 16; plain integer -> base 10; anything else -> -1.

    No input raises: a value beyond 63 bits has no place on a bus (identifiers have 11 or 29 bits) and
    counts as malformed, -1, like text padded with blanks.
    """
    a = _c(arb)
    none = F.lit(-1).cast("bigint")
    digits = F.regexp_replace(F.substring(a, 3, 1 << 30), "^0+(?=.)", "")
    short = (F.length(digits) < 16) | ((F.length(digits) == 16) & F.substring(digits, 1, 1).rlike("[0-7]"))
    # the guard stands inside the argument: conv and the cast never see a value that they reject
    hexa = F.conv(F.when(short, digits).otherwise(F.lit("0")), 16, 10).try_cast("bigint")
    return (
        F.when(a.rlike("^0[xX][0-9A-Fa-f]+$"), F.when(short, F.coalesce(hexa, none)).otherwise(none))
        .when(a.rlike("^[+-]?[0-9]+$"), F.coalesce(a.try_cast("bigint"), none))
        .otherwise(none)
    )


def payload_variant(payload) -> Column:
    """Parsed payload; a valid JSON value that is not an object counts as the empty object.  The text of an object begins
    with a brace after white space, so each payload is parsed once."""
    p = _c(payload)
    return F.when(F.ltrim(p, F.lit(" \t\n\r")).startswith("{"), F.try_parse_json(p))


def numeric_signal(v: Column, key: str, default: float = 0.0) -> Column:
    """Booleans 0/1, numbers and numeric strings parse; missing, null, NaN, Inf, other -> default."""
    return finite_or(F.try_variant_get(v, f"$.{key}", "double"), default)


def finite_or(x: Column, default: float) -> Column:
    """``x`` where it is a finite number (NaN sorts above infinity), else ``default``."""
    return F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(float(default)))


def signal_struct(v: Column) -> Column:
    """The numeric signals (and ``odometer_km``) of a payload as doubles, read in one pass over the object: a field
    that is missing or no number is null, as ``try_variant_get`` of its own path."""
    fields = ", ".join(f"{k}: double" for k in [*NUMERIC_SIGNALS, "odometer_km"])
    return F.try_variant_get(v, "$", f"struct<{fields}>")


def bool_signal(v: Column, key: str) -> Column:
    """Truthiness of the value (missing, null, false, 0, '', [] and {} are false)."""
    return truth_score(F.try_variant_get(v, f"$.{key}", "variant"))


def truth_score(item: Column) -> Column:
    """P3 of a value already taken out of the payload."""
    t = F.schema_of_variant(item)
    num = F.try_variant_get(item, "$", "double")
    truthy = (
        F.when(item.isNull(), F.lit(False))
        .when(t == "VOID", F.lit(False))
        .when(t == "BOOLEAN", F.try_variant_get(item, "$", "boolean"))
        .when(t.startswith("ARRAY"), F.size(F.try_variant_get(item, "$", "array<variant>")) > 0)
        .when(t.startswith("OBJECT"), t != "OBJECT<>")
        .when(t == "STRING", F.length(F.try_variant_get(item, "$", "string")) > 0)
        .otherwise(F.isnan(num) | (num != 0))
    )
    return F.when(F.coalesce(truthy, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def raw_byte_values(v: Column) -> Column:
    """Numeric (and boolean) items of ``raw_bytes`` as array<double>; strings and nulls are skipped.

    Homogeneous numeric or boolean arrays (the usual case) are read directly as array<double>;
    only mixed arrays pay for a per-item type check."""
    t = F.schema_of_variant(F.try_variant_get(v, "$.raw_bytes", "variant"))
    homogeneous = F.regexp_like(t, F.lit(r"^ARRAY<(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\)|BOOLEAN)>$"))
    return F.when(homogeneous, F.try_variant_get(v, "$.raw_bytes", "array<double>")).otherwise(_raw_byte_values_mixed(v))


def _raw_byte_values_mixed(v: Column) -> Column:
    items = F.try_variant_get(v, "$.raw_bytes", "array<variant>")
    typed = F.transform(items, lambda e: F.struct(F.schema_of_variant(e).alias("t"),
                                                   F.try_variant_get(e, "$", "double").alias("x")))
    numeric = F.filter(typed, lambda s: F.regexp_extract(s["t"], r"^([A-Z]+)", 1).isin(*_NUMERIC_TYPES))
    return F.transform(numeric, lambda s: s["x"])


def payload_signature(v: Column) -> Column:
    """P5: canonical JSON text with sorted keys (non-object payload -> '{}')."""
    return F.coalesce(F.to_json(v), F.lit("{}"))


def event_time_ns(send_ns, epoch_ms, processing_ns: Column | None = None) -> Column:
    """Send time in ns, else ms x 1e6, else the processing time passed in as a column."""
    fallback = processing_ns if processing_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    return F.coalesce(_c(send_ns), _c(epoch_ms) * F.lit(NS_PER_MS), fallback).cast("bigint")


def reserved_id_flag(id_num) -> Column:
    """1 for ids <= 0x00F (unparsable -1 included)."""
    return F.when(_c(id_num) <= 0x00F, F.lit(1.0)).otherwise(F.lit(0.0))


def arbitration_priority_score(id_num) -> Column:
    """0 for negative ids, else 1 - min(id, 0x7FF) / 0x7FF."""
    x = _c(id_num)
    return F.when(x < 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.least(x, F.lit(0x7FF)).cast("double") / 0x7FF)


def pipeline_latency_ms(send_ns, processing_ns: Column) -> Column:
    """max(0, processing - send) / 1e6, or 0 without a send time."""
    s = _c(send_ns)
    return F.when(s.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (processing_ns - s).cast("double") / NS_PER_MS))


def decode_frames(frames: DataFrame, params: DetectorParams | None = None,
                  processing_ns: Column | None = None) -> DataFrame:
    """Frame columns + event time ``t``, label, signature and the 20 payload/id features.

    Rows whose payload text is not valid JSON get ``payload_valid = false`` (quarantine upstream).
    """
    v = payload_variant("payload")
    whole = F.col("_corrupt_record").isNull() if "_corrupt_record" in frames.columns else F.lit(True)
    cols = {
        "t": event_time_ns("simulator_send_time_ns", "event_time_epoch_ms", processing_ns),
        "arbitration_key": F.coalesce(F.col("arbitration_id"), F.lit("None")),
        "label": F.coalesce(F.col("attack_type_label"), F.lit("normal")),
        "payload_valid": whole & (F.col("payload").isNull() | F.try_parse_json("payload").isNotNull()),
        "_pv": v,
    }
    out = frames.withColumns(cols)
    pv = F.col("_pv")
    has_raw = F.try_variant_get(pv, "$.raw_bytes", "variant").isNotNull()
    # array and mean as columns first: a lambda would re-evaluate an outer mean for every item
    out = out.withColumns({"_raw": F.when(has_raw, raw_byte_values(pv)), "_signals": signal_struct(pv), "_has_raw": has_raw}
                          | {f"_is_{k}": F.try_variant_get(pv, f"$.{k}", "variant") for k in BOOL_SIGNALS})
    n_raw = F.size("_raw")
    out = out.withColumn("_rmean", F.when(n_raw > 0, F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x) / n_raw))
    rss = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + (x - F.col("_rmean")) * (x - F.col("_rmean")))
    raw_mean = F.coalesce(F.col("_rmean"), F.lit(0.0))
    raw_std = F.when(F.col("_rmean").isNotNull(), F.sqrt(rss / n_raw)).otherwise(F.lit(0.0))
    feats = {"arbitration_id_numeric": parse_arbitration_id("arbitration_id").cast("double")}
    for k in NUMERIC_SIGNALS:
        feats[k] = finite_or(F.col("_signals")[k], 0.0)
    for k in BOOL_SIGNALS:
        feats[k] = truth_score(F.col(f"_is_{k}"))
    feats["odometer_km"] = finite_or(F.col("_signals")["odometer_km"], -1.0)
    feats["raw_byte_mean"] = raw_mean
    feats["raw_byte_std"] = raw_std
    feats["payload_signature"] = payload_signature(pv)
    feats["has_raw_bytes"] = F.col("_has_raw")
    out = out.withColumns(feats)
    out = out.withColumns({
        "sig": F.xxhash64("payload_signature"),
        "reserved_id_flag": reserved_id_flag("arbitration_id_numeric"),
        "arbitration_priority_score": arbitration_priority_score("arbitration_id_numeric"),
    })
    return out.drop("_pv", "_raw", "_rmean", "_signals", "_has_raw", *(f"_is_{k}" for k in BOOL_SIGNALS))
