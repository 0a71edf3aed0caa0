"""Line deduplication with two Bloom filters.

A line's key is the line without ASCII white space at its ends and with A-Z as a-z.  A key of at least
``min_chars`` code points found in at least ``min_docs`` documents loses all its lines but those of the
largest document id that holds it (or the smallest, by ``keep``).

1. Every task keeps two bit arrays over the key hashes of its documents, seen once and seen twice (a key
   counts once per document).  Partial arrays travel as 8 KB blocks, only where set, and are merged block by
   block: twice |= twice' | (once & once').
2. The merged seen-twice array is broadcast.  Its size is the parameter ``filter_bits`` (8 MB by default) at
   any input size; a fuller array only lets more lines through to the exact step.
3. Suspected lines alone, as (128-bit key digest, document id), are shuffled: exact counts of documents and
   the id to keep.
4. Documents with a confirmed line are joined with their digests to drop; documents without suspected lines
   bypass that shuffle.

Defined results: null or empty text is one empty line.  Rows with the same document id are one document;
null ids are together one document, smaller than any other.  A document's own repeats of a line stand or fall
together.  An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, free_name, give_back, stage_table, text_or_empty, tidy

WHITE = b" \t\n\x0b\x0c\r"
BLOCK_BITS = 1 << 16
FILTER_BITS = 1 << 26
PROBES = 2


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # bytes.lower touches A-Z alone


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit digest of a line's key, or None where the key is too short to count."""
    key = line_key(line)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def document_digests(text: str, min_chars: int) -> set[bytes]:
    return {d for line in text.encode().split(b"\n") if (d := line_digest(line, min_chars))}


def slots(digests: list[bytes], bits: int) -> np.ndarray:
    """The ``PROBES`` filter positions of each digest, one row each."""
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return (halves[:, :PROBES] % np.uint64(bits)).astype(np.int64)


def seen_blocks(texts: Iterator[pd.Series], min_chars: int, bits: int) -> Iterator[pd.DataFrame]:
    """One task's two filters as (block, once, twice) rows."""
    once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
    for batch in texts:
        for start in range(0, len(batch), 2000):
            found = [d for t in batch.iloc[start:start + 2000] for d in document_digests(t, min_chars)]
            if not found:
                continue
            # a slot counts per key: the two probes of one key may meet in one slot
            hit = slots(found, bits)
            hit = np.concatenate([hit[:, 0], hit[hit[:, 0] != hit[:, 1], 1]])
            at, times = np.unique(hit, return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            again = (times > 1) | (once[byte] & bit > 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
    size = BLOCK_BITS // 8
    rows = once.reshape(-1, size)
    used = np.flatnonzero(rows.any(axis=1))
    for part in np.array_split(used, max(1, len(used) // 256)):
        yield pd.DataFrame({"block": part, "once": [rows[i].tobytes() for i in part],
                            "twice": [twice[i * size:(i + 1) * size].tobytes() for i in part]})


def merge_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All partial filters of the blocks in one partition, merged as they arrive."""
    once: dict[int, int] = {}
    twice: dict[int, int] = {}
    for part in parts:
        for block, a, b in part.itertuples(index=False):
            a, b = int.from_bytes(a, "little"), int.from_bytes(b, "little")
            seen = once.get(block, 0)
            twice[block] = twice.get(block, 0) | b | (seen & a)
            once[block] = seen | a
    kept = [(k, v.to_bytes(BLOCK_BITS // 8, "little")) for k, v in twice.items() if v]
    yield pd.DataFrame(kept, columns=["block", "twice"])


def seen_twice(docs: DataFrame, text: str, min_chars: int, bits: int) -> np.ndarray:
    """The merged seen-twice bit array: ``bits`` / 8 bytes at most, whatever the input's size."""
    texts = docs.select(text_or_empty(col(docs, text)).alias("text"))
    parts = texts.mapInPandas(tidy(lambda it: seen_blocks((b["text"] for b in it), min_chars, bits)),
                              "block long, once binary, twice binary")
    whole = np.zeros(bits // 8, dtype=np.uint8)
    size = BLOCK_BITS // 8
    for row in parts.repartition("block").mapInPandas(tidy(merge_blocks), "block long, twice binary").collect():
        whole[row.block * size:(row.block + 1) * size] = np.frombuffer(bytes(row.twice), dtype=np.uint8)
    return whole


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                keep: str = "largest", filter_bits: int = FILTER_BITS, n_lines_as: str = "n_lines",
                n_dropped_as: str = "n_dropped") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus the lines counted before and dropped."""
    if filter_bits % BLOCK_BITS:
        raise ValueError(f"filter_bits must be a multiple of {BLOCK_BITS}")
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(seen_twice(docs, text, min_chars, filter_bits).tobytes())

    @F.pandas_udf("array<binary>")
    def suspected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bitmap = np.frombuffer(twice.value, dtype=np.uint8)

        def one(t: str) -> list[bytes]:
            found = list(document_digests(t, min_chars))
            if not found:
                return []
            at = slots(found, filter_bits)
            hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
            return [d for d, h in zip(found, hit) if h]
        for texts in batches:
            yield texts.map(one)
        give_back()

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, digests in batches:
            out = []
            for t, drop in zip(texts, digests):
                lines = t.encode().split(b"\n")
                bad = set(map(bytes, drop)) if drop is not None else None
                left = [x for x in lines if line_digest(x, min_chars) not in bad] if bad else lines
                out.append((b"\n".join(left).decode("utf-8", "replace"), len(lines), len(lines) - len(left)))
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])
        give_back()

    sus, key, res = free_name(docs, "suspected"), free_name(docs, "document"), free_name(docs, "cut")
    flagged = docs.withColumn(sus, suspected(text_or_empty(col(docs, text))))
    pairs = stage_table(
        flagged.filter(F.size(sus) > 0).select(col(docs, id).alias("doc"), F.explode(sus).alias("digest")).distinct(),
        "suspected-lines")
    best = F.max("doc") if keep == "largest" else F.min(F.struct(F.col("doc").isNotNull(), "doc")).getField("doc")
    # a table of its own, so that the join can split the partition of a line that very many documents hold
    repeated = stage_table(
        pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("kept"))
        .filter(F.col("n") >= min_docs).select("digest", "kept"), "repeated-lines")
    drops = (pairs.join(repeated, "digest").filter(~F.col("doc").eqNullSafe(F.col("kept")))
             .groupBy(F.col("doc").alias(key)).agg(F.collect_list("digest").alias("drop")))
    out = free_name(docs, "drop")
    drops = drops.withColumnRenamed("drop", out)
    whole = text_or_empty(col(flagged, text))
    calm = flagged.filter(F.size(sus) == 0).withColumn(res, F.struct(  # nothing to drop: no second Python worker
        whole.alias("text"), F.size(F.split(whole, "\n", -1)).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped")))
    loud = flagged.filter(F.size(sus) > 0)
    loud = loud.join(drops, col(loud, id).eqNullSafe(drops[key]), "left").drop(key)
    loud = loud.withColumn(res, without(text_or_empty(col(loud, text)), F.col(out))).drop(out)
    both = calm.unionByName(loud).drop(sus)
    return both.withColumns({text: F.col(res)["text"], n_lines_as: F.col(res)["n_lines"],
                             n_dropped_as: F.col(res)["n_dropped"]}).drop(res)
