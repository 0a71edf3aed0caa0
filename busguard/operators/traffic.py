"""Bus-window features (W2-W9, W11 count, W12, W15, W16, W19) per time chunk.

A chunk's task (``chunks``) gets its own frames and copies of the frames that are for the last time inside one of its
windows there.  Frames that stand in a window during the whole chunk but begin before and end after it come as counts
per key, and keys that neither enter nor leave in the chunk come as one summary row (sum of c log2 c, keys, largest
count): the state that a chunk needs from earlier ones merges from counts, so a chunk's task never holds more than its
budget, however dense its time is.  Look-backs of any age (previous frame of the bus, earlier sightings of a 3-gram)
come as one row per key and chunk from running aggregates over chunks.

Inside a chunk everything is arithmetic on whole columns.  A frame stands in the windows of the time groups
[enters, leaves); a key's count changes at the groups where its frames enter or leave.  Sums of c log2 c and numbers of
keys are running sums of these changes; the largest count is the upper envelope of the keys' steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from busguard.operators.chunks import between
from busguard.params import DetectorParams

KEY = "arbitration_key"
ORDER = ["t", "sequence", "_ord"]
FRAME, BUS, NGRAM, COUNT, SUMMARY = range(5)  # kinds of rows of a chunk
FOUND = {"_d_n": T.LongType(), "_d_idn": T.LongType(), "_d_s": T.DoubleType(), "_d_k": T.LongType(),
         "_d_idmax": T.LongType(), "_d_sigmax": T.LongType(), "_sig_n3": T.LongType(), "_replay_n": T.LongType(),
         "_prev_bus_id": T.StringType(), "_ng_n": T.LongType(), "_ng_t": T.LongType()}
LEAST = -(1 << 63)
SHARED = [*ORDER, KEY, "sig", "_suspicious", "_last1", "_last3"]  # what a frame and its copies have


# --------------------------------------------------------------------------- inside a chunk
def log_weight(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, dtype=np.float64)
    return c * np.log2(np.maximum(c, 1.0))


def key_counts(key: np.ndarray, enters: np.ndarray, leaves: np.ndarray, groups: int, ask_key: np.ndarray,
               ask_group: np.ndarray) -> np.ndarray:
    """Frames of a key that have entered and not left, at a group."""
    def seen(moments: np.ndarray) -> np.ndarray:
        places = np.sort(key * (groups + 1) + moments)
        first = ask_key * (groups + 1)
        return np.searchsorted(places, first + ask_group, "right") - np.searchsorted(places, first, "left")
    return seen(enters) - seen(leaves)


def key_steps(key: np.ndarray, enters: np.ndarray, leaves: np.ndarray, groups: int, base: np.ndarray):
    """Changes of the keys' counts: key, group, count before, count after, group of the key's next change, and
    whether it is the key's first."""
    stays = leaves < groups
    place = np.concatenate([key * (groups + 1) + enters, (key * (groups + 1) + leaves)[stays]])
    change = np.concatenate([np.ones(len(key), np.int64), np.full(int(stays.sum()), -1, np.int64)])
    order = np.argsort(place, kind="stable")
    place, change = place[order], change[order]
    at = np.flatnonzero(np.diff(place, prepend=-1))
    net = np.add.reduceat(change, at) if len(at) else change
    k, g = place[at] // (groups + 1), place[at] % (groups + 1)
    total = np.cumsum(net)
    first = np.diff(k, prepend=-1) != 0
    opening = np.repeat((total - net)[first], np.diff(np.append(np.flatnonzero(first), len(k))))
    after = total - opening + base[k]
    following = np.full(len(k), groups)
    following[:-1] = np.where(first[1:], groups, g[1:])
    return k, g, after - net, after, following, first


def envelope(begin: np.ndarray, end: np.ndarray, value: np.ndarray, size: int, floor: int) -> np.ndarray:
    """For each place below ``size`` the largest value of the stretches [begin, end) that hold it, at least ``floor``."""
    some = (end > begin) & (value > floor)
    begin, end, value = begin[some], end[some], value[some]
    level = np.frexp((end - begin).astype(np.float64))[1] - 1  # the largest power of two inside the stretch
    tables = {}
    for x in np.unique(level).tolist():
        here = level == x
        table = tables[x] = np.full(size, floor, np.int64)
        np.maximum.at(table, begin[here], value[here])
        np.maximum.at(table, end[here] - (1 << x), value[here])
    for x in range(max(tables, default=0), 0, -1):
        table = tables.pop(x, None)
        if table is None:
            continue
        below = tables.setdefault(x - 1, np.full(size, floor, np.int64))
        np.maximum(below, table, out=below)
        half = 1 << (x - 1)
        np.maximum(below[half:], table[:size - half], out=below[half:])
    return tables.get(0, np.full(size, floor, np.int64))


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, LEAST).to_numpy()


def chunk_features(params: DetectorParams, names: list[str], schema: T.StructType):
    """A chunk's own frames and the other rows of its task (``OTHERS``) to the frames with ``names`` and ``FOUND``."""
    nothing = to_arrow_schema(schema).empty_table()
    w1, w3 = params.traffic_window_ns, params.repeat_window_ns
    ties, cap = params.arrival_ties, params.bus_arrival_cap

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        n = mine.num_rows
        if not n:
            return nothing
        at = mine["_at"][0].as_py()
        kind = others["_kind"].to_numpy()
        marks = {k: others.filter(pa.array(kind == k)) for k in (BUS, NGRAM, COUNT, SUMMARY) if (kind == k).any()}
        copies = others.filter(pa.array(kind == FRAME)) if marks else others
        frames = pa.concat_tables([x.select(SHARED) for x in (mine, copies)], promote_options="permissive")
        t, seq, row = (numbers(frames[c]) for c in ORDER)
        order = np.lexsort((row, seq, t))
        own = order < n
        names_of_ids = pc.fill_null(frames[KEY], "").combine_chunks().dictionary_encode()
        ids = {v: i for i, v in enumerate(names_of_ids.dictionary.to_pylist())}
        key = names_of_ids.indices.to_numpy().astype(np.int64)[order]
        sig_values = numbers(frames["sig"])[order]
        t = t[order]

        def codes(values: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
            found, distinct = pd.factorize(np.concatenate([values, extra]))
            return found[:len(values)].astype(np.int64), found[len(values):].astype(np.int64), len(distinct)

        # counts of keys that stand in a window during the whole chunk
        held = {d: (np.zeros(0, np.int64),) * 3 for d in ("id", "sig", "pair", "suspect")}
        if COUNT in marks:
            rows = marks[COUNT]
            domain = np.array(rows["_domain"].to_pylist())
            held_id = np.array([ids.setdefault(x, len(ids)) for x in pc.fill_null(rows[KEY], "").to_pylist()], np.int64)
            held_sig, held_n = numbers(rows["sig"]), numbers(rows["_n"])
            held = {d: tuple(x[domain == d] for x in (held_id, held_sig, held_n)) for d in held}
        rest = {"id": (0, 0.0, 0, 0), "sig": (0, 0.0, 0, 0)}  # frames, sum of c log2 c, keys, largest count
        if SUMMARY in marks:
            rows = marks[SUMMARY]
            rest |= {d: (a, b, c, m) for d, a, b, c, m in zip(*(rows[x].to_pylist() for x in
                                                               ("_domain", "_n", "_s", "_k", "_most")))}
        sig, held_sig, n_sigs = codes(sig_values, held["sig"][1])
        pair_extra = held["pair"]
        both, both_extra, n_pairs = codes(sig_values, pair_extra[1])
        n_ids = len(ids)
        pair, pair_held, n_pairs = codes(both * n_ids + key, both_extra * n_ids + pair_extra[0])
        id_base, sig_base, pair_base, suspect_base = (np.zeros(max(1, x), np.int64) for x in (n_ids, n_sigs, n_pairs, n_ids))
        id_base[held["id"][0]] = held["id"][2]
        sig_base[held_sig] = held["sig"][2]
        pair_base[pair_held] = pair_extra[2]
        suspect_base[held["suspect"][0]] = held["suspect"][2]

        own_t = t[own]
        if ties:
            group = np.arange(n)
        else:
            group = np.cumsum(np.diff(own_t, prepend=own_t[0]) > 0)
        last_of = np.flatnonzero(np.append(np.diff(group) > 0, True))
        groups = len(last_of)
        group_t = own_t[last_of]

        def window(span: int, last: str, most: int | None = None):
            """The frames of a window of ``span``: which, group of entering, group of leaving; frames before each group
            that have left, and that have entered."""
            in_it = own | (numbers(frames[last])[order] == at)
            time = t[in_it]
            begin = np.zeros(len(time), np.int64)
            begin[own[in_it]] = group
            gone = np.searchsorted(time, group_t - span, "left")
            entered = len(time) - n + last_of + 1
            if most is not None:
                gone = np.maximum(gone, entered - most)
            return in_it, begin, np.searchsorted(gone, np.arange(len(time)), "right"), gone, entered

        in1, begin1, end1, gone1, entered1 = window(w1, "_last1")
        id_n = key_counts(key[in1], begin1, end1, groups, key[own], group) + id_base[key[own]]
        flagged = numbers(frames["_suspicious"])[order][in1] > 0
        replay = key_counts(key[in1][flagged], begin1[flagged], end1[flagged], groups, key[own], group) + suspect_base[key[own]]
        in3, begin3, end3, _, _ = window(w3, "_last3")
        repeats = key_counts(pair[in3], begin3, end3, groups, pair[own], group) + pair_base[pair[own]]
        if cap is not None:
            in1, begin1, end1, gone1, entered1 = window(w1, "_last1", cap)

        def steps(of: np.ndarray, base: np.ndarray):
            return key_steps(of[in1], begin1, end1, groups, base)

        def largest(changes, base: np.ndarray, held_codes: np.ndarray, floor: int) -> np.ndarray:
            k, g, _, after, following, first = changes
            until = np.full(len(base), groups)
            until[k[first]] = g[first]
            return envelope(np.concatenate([g, np.zeros(len(held_codes), np.int64)]),
                            np.concatenate([following, until[held_codes]]),
                            np.concatenate([after, base[held_codes]]), groups, floor)

        of_ids = steps(key, id_base)
        k, g, before, after, _, _ = of_ids
        run_of = lambda change: np.cumsum(np.bincount(g, weights=change, minlength=groups)[:groups])
        stand = held["id"][2]
        total = entered1 - gone1 + int(stand.sum()) + rest["id"][0]
        log_sum = run_of(log_weight(after) - log_weight(before)) + log_weight(stand).sum() + rest["id"][1]
        distinct = np.rint(run_of((after > 0).astype(np.int64) - (before > 0))).astype(np.int64) + len(stand) + rest["id"][2]
        id_most = largest(of_ids, id_base, held["id"][0], rest["id"][3])
        sig_most = largest(steps(sig, sig_base), sig_base, held_sig, rest["sig"][3])

        # earlier frames of the chunk: the bus, then the 3-gram of the identifier
        own_key = key[own]
        id_names = np.array([None] * len(ids), dtype=object)
        for name, i in ids.items():
            id_names[i] = name
        previous = np.empty(n, dtype=object)
        previous[1:] = id_names[own_key[:-1]]
        previous[0] = marks[BUS]["_mk_id"][0].as_py() if BUS in marks else None
        ng_n, ng_t = np.zeros(n, np.int64), np.full(n, LEAST)
        grams = mine["ngram"]
        known = ~grams.is_null().to_numpy()[order[own]]
        gram_values = numbers(grams)[order[own]]
        extra = marks[NGRAM] if NGRAM in marks else None
        extra_values = numbers(extra["ngram"]) if extra else np.zeros(0, np.int64)
        extra_id = np.array([ids.setdefault(x, len(ids)) for x in pc.fill_null(extra[KEY], "").to_pylist()], np.int64) \
            if extra else np.zeros(0, np.int64)
        value, value_extra, _ = codes(gram_values, extra_values)
        gram, gram_extra, n_grams = codes(value * len(ids) + own_key, value_extra * len(ids) + extra_id)
        base_n, base_t = np.zeros(max(1, n_grams), np.int64), np.full(max(1, n_grams), LEAST)
        if extra:
            base_n[gram_extra], base_t[gram_extra] = numbers(extra["_mk_n"]), numbers(extra["_mk_t"])
        along = np.flatnonzero(known)
        along = along[np.argsort(gram[along], kind="stable")]
        sorted_gram = gram[along]
        begins = np.diff(sorted_gram, prepend=-1) != 0
        fresh = ~mine["_hist"].to_numpy()[order[own]][along]
        before_n = np.cumsum(fresh) - fresh
        opening = np.repeat(before_n[begins], np.diff(np.append(np.flatnonzero(begins), len(along))))
        ng_n[along] = before_n - opening + base_n[sorted_gram]
        earlier = own_t[np.concatenate([along[:1], along[:-1]])] if len(along) else own_t[:0]
        ng_t[along] = np.where(begins, base_t[sorted_gram], earlier)

        out = mine.select(names).take(pa.array(order[own]))
        columns = {"_d_n": total[group], "_d_idn": id_n, "_d_s": log_sum[group], "_d_k": distinct[group],
                   "_d_idmax": id_most[group], "_d_sigmax": sig_most[group], "_sig_n3": repeats, "_replay_n": replay,
                   "_ng_n": ng_n}
        for c in FOUND:
            if c == "_prev_bus_id":
                out = out.append_column(c, pa.array(previous, pa.string()))
            elif c == "_ng_t":
                out = out.append_column(c, pa.array(ng_t, pa.int64(), mask=ng_t == LEAST))
            else:
                out = out.append_column(c, pa.array(columns[c]))
        return out

    return run


# --------------------------------------------------------------------------- rows of the chunks
def carries(seq: DataFrame, history: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """One row per chunk with the last frame's identifier before it, and one per (identifier, 3-gram, chunk) with the
    number and last time of earlier sightings.  ``history``: sightings of earlier runs, before all chunks."""
    upto = [Window.unboundedPreceding, -1]
    bus = seq.filter("_end").groupBy("_bus", "_chunk").agg(F.max_by(F.col(KEY), F.struct(*ORDER)).alias("_last_id"))
    bus = bus.select("_bus", F.col("_chunk").alias("_at"), F.lit(BUS).alias("_kind"),
                     F.lag("_last_id").over(Window.partitionBy("_bus").orderBy("_chunk")).alias("_mk_id")) \
        .filter(F.col("_mk_id").isNotNull())
    # frames kept from earlier runs are part of the history
    counted = seq.filter(~F.col("_hist") & F.col("ngram").isNotNull())
    grams = counted.groupBy("_bus", KEY, "ngram", "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("t").alias("_t"))
    if history is not None:
        grams = grams.unionByName(history[1].select("_bus", KEY, "ngram", F.lit(None).cast("bigint").alias("_chunk"),
                                                    F.col("n").alias("_n"), F.col("last_t").alias("_t")))
    w = Window.partitionBy("_bus", KEY, "ngram").orderBy("_chunk").rowsBetween(*upto)
    grams = grams.select("_bus", F.col("_chunk").alias("_at"), F.lit(NGRAM).alias("_kind"), KEY, "ngram",
                         F.sum("_n").over(w).alias("_mk_n"), F.max("_t").over(w).alias("_mk_t"))
    grams = grams.filter(F.col("_mk_n").isNotNull() & F.col("_at").isNotNull())
    return bus.unionByName(grams, allowMissingColumns=True)


def keyed(frames: DataFrame, *others: str) -> DataFrame:
    """A row for each row (alike frames) and key that is counted: _domain, identifier, sig, last chunk, and ``others``."""
    def one(domain: str, key: bool, sig: bool, last: str):
        return F.struct(F.lit(domain).alias("_domain"), (F.col(KEY) if key else F.lit("")).alias(KEY),
                        (F.col("sig") if sig else F.lit(0).cast("bigint")).alias("sig"), F.col(last).alias("_last"))
    domains = F.array(one("id", True, False, "_last1"), one("sig", False, True, "_last1"), one("pair", True, True, "_last3"))
    suspect = F.array(one("suspect", True, False, "_last1"))
    rows = F.explode(F.when(F.col("_suspicious") > 0, F.concat(domains, suspect)).otherwise(domains))
    return frames.select("_bus", *others, rows.alias("_row")).select("_bus", *others, "_row.*")


def standing(seq: DataFrame, placed: DataFrame) -> DataFrame:
    """Counts per key of the frames that stand in a window during a whole chunk: rows for the keys that have frames in
    the chunk's task (``placed``), a summary of all others."""
    key = ["_domain", KEY, "sig"]
    # alike frames first, then partial counts: one row for each key and pair of chunks
    suspect = (F.col("_suspicious") > 0).cast("int").alias("_suspicious")
    alike = seq.groupBy("_bus", KEY, "sig", suspect, "_chunk", "_last1", "_last3", "_parts").agg(F.count(F.lit(1)).alias("_n"))
    counts = keyed(alike, "_chunk", "_parts", "_n").groupBy("_bus", *key, "_chunk", "_last", "_parts").agg(F.sum("_n").alias("_n"))
    counts = counts.select("_bus", *key, "_n", F.explode(between("_last")).alias("_at"))
    counts = counts.groupBy("_bus", "_at", *key).agg(F.sum("_n").alias("_n"))
    # any frame asks for its identifier's suspicious ones
    every = placed.select("_bus", "_at", KEY, "sig").distinct().withColumns(
        {"_suspicious": F.lit(1), "_last1": F.lit(0), "_last3": F.lit(0)})
    here = keyed(every, "_at").select("_bus", "_at", *key).distinct().withColumn("_here", F.lit(True))
    counts = counts.join(here, ["_bus", "_at", *key], "left")
    # a key of the chunk's task keeps its row; all others add up
    counts = counts.withColumns({c: F.when(F.col("_here"), F.col(c)) for c in (KEY, "sig")})
    n = F.col("_n").cast("double")
    some = counts.filter(F.col("_here") | F.col("_domain").isin("id", "sig")).groupBy("_bus", "_at", *key, "_here").agg(
        F.sum("_n").alias("_n"), F.sum(n * F.log2(n)).alias("_s"), F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_most"))
    kind = F.when(F.col("_here"), F.lit(COUNT)).otherwise(F.lit(SUMMARY))
    return some.withColumn("_kind", kind).drop("_here")


def chunk_table(seq: DataFrame, params: DetectorParams, with_cuts: bool,
                history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``seq`` with the columns of ``FOUND``."""
    if "_hist" not in seq.columns:
        seq = seq.withColumn("_hist", F.lit(False))
    names = [c for c in seq.columns if c not in ("_chunk", "_last1", "_last3", "_parts", "_suspicious", "_hist", "_end")]
    # a copy in a later chunk only leaves a window there: it carries its time, its keys and no feature
    later = F.explode(F.array_distinct(F.filter(F.array("_last1", "_last3"), lambda c: c != F.col("_chunk"))))
    # columns of their own names: the two sides of the cogroup come from one table
    copies = seq.select(F.col("_bus").alias("_bus"), later.alias("_at"), F.lit(FRAME).alias("_kind"),
                        *(F.col(c).alias(c) for c in SHARED))
    others = copies.unionByName(carries(seq, history), allowMissingColumns=True)
    if with_cuts:
        placed = seq.select("_bus", F.col("_chunk").alias("_at"), KEY, "sig").unionByName(copies.select("_bus", "_at", KEY, "sig"))
        others = others.unionByName(standing(seq, placed), allowMissingColumns=True)
    schema = T.StructType([*(seq.schema[c] for c in names), *(T.StructField(c, x) for c, x in FOUND.items())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    mine = seq.select(*names, F.col("_chunk").alias("_at"), "_last1", "_last3", "_suspicious", "_hist")
    return mine.groupBy("_bus", "_at").cogroup(others.groupBy("_bus", "_at")).applyInArrow(
        chunk_features(params, names, schema), schema)
