"""Removal of long repeated substrings with suffix arrays.

A byte goes when a string of ``window`` bytes that covers it also starts anywhere else, in the same text or in another
one.  Strings are judged on the texts as given.

1. *Fingerprints.*  The smallest hash of the k-byte strings inside a window is the same wherever the window occurs.
   The starts of a text are cut into runs of equal smallest hash (the run's key, at most ``MAX_RUN`` starts); a row for
   each run holds its key and a 128-bit digest of the bytes its windows cover.  Keys met once hold no repeated window
   and go.  Runs of equal digests repeat as a whole.
2. *Shards.*  Of the other keys every distinct run is cut from one text that holds it and dealt to shards by its key,
   so all places of a window lie in one shard.  A shard leaves out the runs whose keys at a longer k stand once in it
   and builds one suffix array by induced sorting (``suffix_array``); a start repeats where the common prefix with a neighbour in the array reaches the window.
3. *Hot keys*, whose distinct runs would not fit in a shard (``hot_bytes``), are cut again with longer k (the levels
   ``k_parts``), among themselves.  At the last level k is the window itself and equal digests decide alone.
4. The repeated starts come back to their texts as ranges of bytes; every text is cut once.

Windows are counted over all rows.  Nothing is gathered but a text's own ranges, and shards of counted size.  Copies
of a text or a passage are partial counts before they shuffle; joins on a key or a text go through Spark's skew
handling.  Stage tables lie in the shared checkpoint folder and are deleted when the result has been staged.

Defined results: null text is empty; texts shorter than the window, empty ones included, lose nothing; rows that
repeat an id with different texts are different texts, rows that repeat both are copies of each other; null ids are
ids like others.  An empty table gives no rows.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busguard.llm.common import col, drop_folder, free_name, scratch_path, text_or_empty
from busguard.llm.suffix_array import permuted_prefixes, suffix_array

WINDOW = 400
K_PARTS = (0.16, 0.8, 1.0)  # k of each level as a part of the window; the last is the window itself
NARROW_PART = 0.8  # k inside a shard, as a part of the window
MAX_RUN = 1024
SHARD_BYTES = 4 << 20
HOT_BYTES = 4 << 20
STRETCH = 1 << 19  # starts of a text that are hashed together
PLACE_BITS = 21  # for places in twice that many bytes
BASE = 0x9E3779B97F4A7C15 | 1

RUN = "k1 long, k2 long, start long, n int, key long, times int, digest binary"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes that start at each place, where k bytes follow."""
    up, down = _powers(1 << (len(data)).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
        h = (sums[k:] - sums[:len(sums) - k]) * down[:len(sums) - k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    have = 1
    out = h
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[:len(h) - width + 1], out[width - have:])


def runs_of(pieces: list[bytes], k: int, window: int, most: int) -> tuple[np.ndarray, ...]:
    """Runs of the window starts of each piece: piece number, start in the piece, number of starts, key, and 2 where
    the key's string stands twice in the run's windows (only then can two of them be equal), else 1."""
    empty = np.zeros(0, np.int64)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    n_starts = np.maximum(lengths - window + 1, 0)
    if not n_starts.sum():
        return empty, empty, empty, empty, empty
    h = string_hashes(data, k)
    # the low bits give way to the place, counted down: among equal hashes the last one is the least
    places = np.uint64((1 << PLACE_BITS) - 1)
    marked = (h & ~places) | (places - np.arange(len(h), dtype=np.uint64))
    least = sliding_least(marked, window - k + 1)
    begins = np.cumsum(lengths) - lengths
    number = np.repeat(np.arange(len(pieces)), n_starts)
    inside = np.arange(len(number)) - (np.cumsum(n_starts) - n_starts)[number]
    place = (places - (least[begins[number] + inside] & places)).astype(np.int64)
    key = h[place]
    new = np.ones(len(number), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
    run_begins = np.flatnonzero(new)
    new |= (np.arange(len(number)) - run_begins[np.cumsum(new) - 1]) % most == 0
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(number)))
    times = 1 + (place[at] != place[at + sizes - 1])
    return number[at], inside[at], sizes, key[at].view(np.int64), times


def digest_of(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(k1, k2, offset, bytes) of the stretches to look at, some megabytes at a time."""
    held, size = [], 0
    for batch in batches:
        ranged = "ranges" in batch.schema.names
        k1s, k2s, texts = (batch.column(c).to_pylist() for c in ("k1", "k2", "text"))
        ranges = batch.column("ranges") if ranged else None
        for row, (k1, k2, text) in enumerate(zip(k1s, k2s, texts)):
            data = text.encode("utf-8", "surrogatepass")
            parts = ([(r["start"], r["n"]) for r in ranges[row].as_py()] if ranged
                     else [(0, len(data) - window + 1)])
            for start, n in parts:
                for begin in range(start, start + n, STRETCH):
                    piece = data[begin:min(begin + STRETCH, start + n) + window - 1]
                    held.append((k1, k2, begin, piece))
                    size += len(piece)
                    if size >= STRETCH:
                        yield held
                        held, size = [], 0
    if held:
        yield held


def fingerprints(k: int, window: int, most: int):
    """Arrow batches of (k1, k2, text[, ranges]) to their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(batches, window):
            pieces = [h[3] for h in held]
            number, start, n, key, times = runs_of(pieces, k, window, most)
            views = [memoryview(p) for p in pieces]
            digests = [digest_of(views[p][s:s + m + window - 1])
                       for p, s, m in zip(number.tolist(), start.tolist(), n.tolist())]
            k1, k2, offset = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[number]), pa.array(k2[number]), pa.array(offset[number] + start),
                 pa.array(n.astype(np.int32)), pa.array(key), pa.array(times.astype(np.int32)),
                 pa.array(digests, pa.binary())],
                ["k1", "k2", "start", "n", "key", "times", "digest"])
    return run


def cut_runs(window: int):
    """Arrow batches of (k1, k2, text, ranges with shards) to the bytes that the runs' windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("text")[row].as_py().encode("utf-8", "surrogatepass")
                wanted = batch.column("ranges")[row].as_py()
                for part in range(0, len(wanted), 4096):
                    some = wanted[part:part + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["shard"] for w in some], pa.int32()),
                         pa.array([batch.column("k1")[row].as_py()] * len(some), pa.int64()),
                         pa.array([batch.column("k2")[row].as_py()] * len(some), pa.int64()),
                         pa.array([w["start"] for w in some], pa.int64()),
                         pa.array([data[w["start"]:w["start"] + w["n"] + window - 1] for w in some], pa.binary())],
                        ["shard", "k1", "k2", "start", "bytes"])
    return run


def repeated_starts(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """Of each piece, the starts whose window also starts elsewhere in the pieces, by one suffix array."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    joined = np.frombuffer(b"\xff".join(pieces), dtype=np.uint8).astype(np.int32) + 2
    stops = np.cumsum(lengths + 1) - 1  # of the separators, and of the end
    joined = np.append(joined, 0)
    joined[stops[:-1]] = 1
    sa = suffix_array(joined)
    begins = np.concatenate([[0], stops[:-1] + 1])
    marks = np.zeros(len(joined), dtype=bool)
    marks[begins] = True
    phi, common = permuted_prefixes(joined, sa, marks, int(lengths.max()) + 1)
    hit = common >= window
    hit[phi[hit]] = True
    return [np.flatnonzero(hit[b:b + max(0, n - window + 1)]) for b, n in zip(begins.tolist(), lengths.tolist())]


def narrowed(pieces: list[bytes], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of a shard's pieces whose windows' keys, at a longer k, stand twice in the shard: piece number,
    first start, number of starts.  All others hold no repeated window."""
    number, start, n, key, times = (np.concatenate(x) for x in zip(
        *_runs_in_parts(pieces, k, window), strict=True))
    _, which = np.unique(key, return_inverse=True)
    shared = np.bincount(which, weights=times)[which] > 1
    number, start, n = number[shared], start[shared], n[shared]
    if not len(number):
        return number, start, n
    new = np.ones(len(number), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(number)) - 1
    return number[at], start[at], start[last] + n[last] - start[at]


def _runs_in_parts(pieces: list[bytes], k: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    begin, size = 0, 0
    for i, piece in enumerate([*pieces, b""]):
        if i == len(pieces) or size + len(piece) > 2 * STRETCH:
            number, *rest = runs_of(pieces[begin:i], k, window, MAX_RUN)
            yield (number + begin, *rest)
            begin, size = i, 0
        size += len(piece)


def mark_shard(window: int, k: int):
    def run(shard: pa.Table) -> pa.Table:
        whole = shard["bytes"].to_pylist()
        number, first, n = narrowed(whole, k, window)
        pieces = [whole[p][f:f + m + window - 1] for p, f, m in zip(number.tolist(), first.tolist(), n.tolist())]
        del whole
        rows, begins, ends = [], [], []
        origin = shard["start"].to_numpy()[number] + first
        for i, at in enumerate(repeated_starts(pieces, window) if pieces else ()):
            if len(at):
                opens = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                closes = np.append(opens[1:], len(at)) - 1
                rows += [number[i]] * len(opens)
                begins.append(origin[i] + at[opens])
                ends.append(origin[i] + at[closes] + window)
        take = np.array(rows, dtype=np.int64)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"k1": shard["k1"].take(take), "k2": shard["k2"].take(take),
                         "begin": pa.array(join(begins), pa.int64()), "end": pa.array(join(ends), pa.int64())})
    return run


def cut_out(names: list[str], text: str, marks: str):
    """Arrow batches to the same rows with the kept bytes and the removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            for value, found in zip(batch.column(text), batch.column(marks)):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[int] = []
                for begin, end in sorted((m["begin"], m["end"]) for m in found.as_py() or ()):
                    if merged and begin <= merged[-1]:
                        merged[-1] = max(merged[-1], end)
                    else:
                        merged += [begin, end]
                edges = [0, *merged, len(data)]
                kept.append(b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                spans.append(merged)
                sizes.append(len(data))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.large_binary() if sum(sizes) >= 1 << 31 else pa.binary()),
                 pa.array(spans, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                [*names, "kept", "spans", "n_bytes"])
    return run


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW,
                   k_parts: tuple[float, ...] = K_PARTS, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES,
                   kept_as: str = "kept", spans_as: str = "removed_spans", n_bytes_as: str = "n_bytes") -> DataFrame:
    """``docs`` with the bytes that stay, the removed spans (begin, end, begin, end, ...) and the number of bytes."""
    spark = docs.sparkSession
    folders: list[str] = []

    def stage(df: DataFrame, stem: str) -> DataFrame:
        path = scratch_path(spark, f"repeats-{stem}")
        folders.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    whole = text_or_empty(col(docs, text))
    name = col(docs, id).cast("string")
    keyed = docs.withColumns({k1: F.xxhash64(name, whole), k2: F.xxhash64(F.lit(1), whole, name)})
    texts = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), whole.alias("text")) \
        .filter(F.octet_length("text") >= window)
    marks = None
    todo = texts  # with ranges from the second level on
    for level, part in enumerate(k_parts):
        last = level == len(k_parts) - 1
        k = window if last else max(1, round(window * part))
        cut = todo.mapInArrow(fingerprints(k, window, 1 if last else MAX_RUN), RUN)
        runs = stage(cut, f"runs{level}")
        shared = runs.groupBy("key").agg(F.sum("times").alias("c")).filter("c > 1").select("key")
        runs = stage(runs.join(shared, "key"), f"shared{level}")  # read twice
        rep = F.min(F.struct("k1", "k2", "start", "n")).alias("rep")
        # stage: the distinct runs of shared keys, far fewer than all runs
        distinct = stage(runs.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("c"), F.max("times").alias("times"), rep),
                         f"distinct{level}")
        copied = runs.join(distinct.filter("c > 1").select("key", "digest"), ["key", "digest"], "left_semi")
        found = copied.select("k1", "k2", F.col("start").alias("begin"),
                              (F.col("start") + F.col("n") + (window - 1)).alias("end"))
        marks = found if marks is None else marks.unionByName(found)
        if last:
            break
        bytes_of = F.sum(F.col("rep.n") + F.lit(window - 1)).alias("bytes")
        keys = distinct.groupBy("key").agg(F.sum("times").alias("d"), bytes_of).filter("d > 1")
        asked = stage(distinct.join(keys, "key").select("rep.*", "key", (F.col("bytes") > hot_bytes).alias("hot")),
                      f"asked{level}")
        total = asked.groupBy("hot").agg(F.sum(F.col("n") + F.lit(window - 1)).alias("bytes")).collect()
        total = {r["hot"]: r["bytes"] for r in total}
        if False in total:
            shards = -(-total[False] // shard_bytes)
            dealt = asked.filter(~F.col("hot")).groupBy("k1", "k2").agg(F.collect_list(F.struct(
                "start", "n", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))).alias("ranges"))
            pieces = texts.join(dealt, ["k1", "k2"]) \
                .mapInArrow(cut_runs(window), "shard int, k1 long, k2 long, start long, bytes binary")
            found = pieces.groupBy("shard").applyInArrow(mark_shard(window, round(window * NARROW_PART)), "k1 long, k2 long, begin long, end long")
            marks = marks.unionByName(stage(found, f"marks{level}"))
        if True not in total:
            break
        again = asked.filter("hot").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
        todo = texts.join(again, ["k1", "k2"])

    mk = free_name(docs, "marks")
    grouped = marks.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)) \
        .agg(F.collect_list(F.struct("begin", "end")).alias(mk))
    rows = keyed.join(grouped, [k1, k2], "left")
    names = [c for c in docs.columns if c not in (kept_as, spans_as, n_bytes_as)]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("kept", T.BinaryType()),
                           T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("n_bytes", T.LongType())])
    inner = [f"__{i}" for i in range(len(names))]  # column names may clash or repeat in case
    rows = rows.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), whole.alias("text"), F.col(mk).alias("marks"))
    inner_schema = T.StructType([*(T.StructField(i, f.dataType) for i, f in zip(inner, schema)), *schema[len(names):]])
    cut = rows.mapInArrow(cut_out(inner, "text", "marks"), inner_schema)
    out = cut.select(*(F.col(i).alias(c) for c, i in zip(names, inner)), F.col("kept").alias(kept_as),
                     F.col("spans").alias(spans_as), F.col("n_bytes").alias(n_bytes_as))
    out._stage_folders = folders  # read by the result: deleted by callers that have stored it
    return out


def release(df: DataFrame) -> None:
    """Delete the stage tables behind a stored result."""
    for path in getattr(df, "_stage_folders", ()):
        drop_folder(df.sparkSession, path)
