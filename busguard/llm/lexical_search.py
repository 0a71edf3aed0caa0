"""Ranked lexical search with hashed max-sketches.

*Index.*  A document's sketch folds its terms by a hash into ``COORDINATES`` coordinates; each holds the largest number
of occurrences of a term that falls on it.  Sketches are sparse (coordinate, maximum) and written as a stage table with
the document's key and length.  The same pass counts how many documents hold each term.

*Look-up.*  A term's part of a score grows with its occurrences, so the part that a coordinate's maximum would give is
at least the part of any of its terms: summed over an item's terms it bounds the document's score.  Items are looked
up in batches, as a matrix product of sketches and the items' weights by coordinate.

*Rescoring.*  The documents of the highest bounds are scored exactly from their texts, best bounds first: the first
``FIRST`` of every item give a threshold, its ``top``-th best score so far; then every document whose bound reaches
the threshold is scored, and no other can be among the best.

Batches hold at most ``ITEMS`` items and about ``PAIRS`` (item, term) pairs: they alone pass through the driver.
A task keeps the best bounds of a batch only; the lists are merged in two steps.  Stage tables lie in the shared
checkpoint folder.

Defined results: null text has no terms; documents without a term are never found.  Rows that repeat an id are
documents of their own.  Items that repeat id and text count once; items that share an id but not the text are ranked
each on its own; items without terms find nothing, nor do empty tables.  Null ids come after all others of a score.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, first_of, scratch_path, text_or_empty, tidy

TOP = 20
FIRST = 40
COORDINATES = 1 << 16
ITEMS = 256
PAIRS = 16_384
MEMO = 50_000
DOCS_AT_ONCE = 256

#: fixed values of the score
SCALE, B_PARTS, K_PARTS, UNIT = 1000, 25, 12, 1_000_000_000

# letters, digits and everything beyond ASCII belong to terms; A-Z are lower-cased
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in their order.  UTF-8 bytes of other than ASCII characters are all beyond 127."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def term_weight(n_docs: int, holders: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def norms(length, n_docs: int, n_terms: int):
    """m of documents of ``length`` terms, as integers or an integer array."""
    return 100 - B_PARTS + (B_PARTS * length * n_docs) // max(n_terms, 1)


def impact(times, m):
    return (UNIT * times) // (SCALE * times + K_PARTS * m)


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % COORDINATES


INDEX = "k1 long, k2 long, length long, at binary, most binary, term binary, holders long"


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sketch for each text with terms, and the task's numbers of documents that hold each term."""
    names = ["k1", "k2", "length", "at", "most", "term", "holders"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def table(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

    holders: Counter = Counter()
    places: dict[bytes, int] = {}
    for batch in batches:
        out = {"k1": [], "k2": [], "length": [], "at": [], "most": []}
        for k1, k2, text in zip(*(batch.column(c) for c in ("k1", "k2", "text"))):
            terms = terms_of(text.as_py())
            if not terms:
                continue
            times = Counter(terms)
            holders.update(times.keys())
            most: dict[int, int] = {}
            for term, n in times.items():
                at = places.get(term)
                if at is None:
                    at = places[term] = coordinate(term)
                if n > most.get(at, 0):
                    most[at] = n
            out["k1"].append(k1.as_py())
            out["k2"].append(k2.as_py())
            out["length"].append(len(terms))
            out["at"].append(np.fromiter(most.keys(), np.uint16, len(most)).tobytes())
            out["most"].append(np.fromiter(most.values(), np.uint32, len(most)).tobytes())
            if len(places) > MEMO:
                places.clear()
            if len(holders) > MEMO:
                yield table({"term": list(holders), "holders": list(holders.values())})
                holders.clear()
        if out["k1"]:
            yield table(out)
    if holders:
        yield table({"term": list(holders), "holders": list(holders.values())})


class Batch:
    """Some items: their terms with weights, and the weights by coordinate."""

    def __init__(self, items: dict[int, dict[bytes, tuple[int, int]]], n_docs: int, n_terms: int):
        """``items``: per item number its terms with (repeats, holders)."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.numbers = sorted(items)
        self.weights = [{t: r * term_weight(n_docs, h) for t, (r, h) in items[q].items() if h > 0} for q in self.numbers]
        used = sorted({coordinate(t) for w in self.weights for t in w})
        self.slot = np.full(COORDINATES, -1, dtype=np.int32)
        self.slot[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(self.numbers)))
        for i, weights in enumerate(self.weights):
            for term, w in weights.items():
                self.matrix[self.slot[coordinate(term)], i] += w

    def bounds(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, bounds by document and item) of some documents at a time."""
        lengths = batch.column("length").to_numpy()
        m = norms(lengths, self.n_docs, self.n_terms)
        at, most = batch.column("at"), batch.column("most")
        for first in range(0, batch.num_rows, DOCS_AT_ONCE):
            n = min(DOCS_AT_ONCE, batch.num_rows - first)
            ats = [np.frombuffer(at[first + i].as_py(), np.uint16) for i in range(n)]
            times = np.concatenate([np.frombuffer(most[first + i].as_py(), np.uint32) for i in range(n)]).astype(np.int64)
            doc = np.repeat(np.arange(n), [len(a) for a in ats])
            slot = self.slot[np.concatenate(ats)]
            known = slot >= 0
            doc, slot, times = doc[known], slot[known], times[known]
            sketch = np.zeros((n, len(self.matrix)))
            sketch[doc, slot] = impact(times, m[first:first + n][doc])
            product = sketch @ self.matrix
            yield first, np.where(product > 0, product * (1 + 1e-12) + 0.5, 0)  # whole numbers: safe against rounding

    def score(self, i: int, times: Counter, m: int) -> int:
        weights = self.weights[i]
        few, many = (weights, times) if len(weights) < len(times) else (times, weights)
        return sum(weights[t] * impact(times[t], m) for t in few if t in many)


PAIR = "q int, k1 long, k2 long, bound double"


def pair_batch(q, k1, k2, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                       pa.array(bound, pa.float64())], ["q", "k1", "k2", "bound"])


def highest_bounds(shared, first: int):
    """A task's ``first`` highest bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Batch = shared.value
        best: list[list] = [[] for _ in items.numbers]
        least = np.zeros(len(items.numbers))
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for begin, bounds in items.bounds(batch):
                for row, i in zip(*np.nonzero(bounds > least)):
                    if bounds[row, i] > least[i]:
                        entry = (bounds[row, i], k1[begin + row], k2[begin + row])
                        if len(best[i]) < first:
                            heapq.heappush(best[i], entry)
                        else:
                            heapq.heapreplace(best[i], entry)
                        if len(best[i]) == first:
                            least[i] = best[i][0][0]
        rows = [(items.numbers[i], k1, k2, bound) for i, entries in enumerate(best) for bound, k1, k2 in entries]
        if rows:
            yield pair_batch(*zip(*rows))
    return run


def reaching(shared, thresholds):
    """All pairs whose bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Batch = shared.value
        wanted = np.array([thresholds.value.get(q, 1) for q in items.numbers], dtype=np.float64)
        numbers = np.array(items.numbers)
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for begin, bounds in items.bounds(batch):
                row, i = np.nonzero(bounds >= wanted)
                if len(row):
                    yield pair_batch(numbers[i], k1[begin + row], k2[begin + row], bounds[row, i])
    return run


def exact_scores(shared):
    """Arrow batches of (id, text, qs) to (q, doc_id, score) above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Batch = shared.value
        row_of = {q: i for i, q in enumerate(items.numbers)}
        for batch in batches:
            out = []
            for doc, text, qs in zip(*(batch.column(c) for c in ("id", "text", "qs"))):
                terms = terms_of(text.as_py())
                times, m = Counter(terms), norms(len(terms), items.n_docs, items.n_terms)
                out += [(q, doc.as_py(), s) for q in qs.as_py() if (s := items.score(row_of[q], times, m)) > 0]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))],
                    ["q", "doc_id", "score"])
    return run


def ranked_search(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text",
                  item_id: str = "item_id", top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    sc = spark.sparkContext

    def stage(df: DataFrame, stem: str) -> DataFrame:
        path = scratch_path(spark, f"search-{stem}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    whole, name = text_or_empty(col(docs, text)), col(docs, id).cast("long")
    texts = docs.select(F.xxhash64(name, whole).alias("k1"), F.xxhash64(F.lit(1), whole, name).alias("k2"),
                        name.alias("id"), whole.alias("text"))
    index = stage(texts.select("k1", "k2", "text").mapInArrow(tidy(index_rows), INDEX), "index")
    sketches = index.filter(F.col("term").isNull()).select("k1", "k2", "length", "at", "most")
    held = index.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("holders").alias("holders"))
    n_docs, n_terms = sketches.agg(F.count(F.lit(1)), F.sum("length")).first()

    asked = items.select(col(items, item_id).alias("item_id"), text_or_empty(col(items, item_text)).alias("text")).distinct()
    item_type = asked.schema["item_id"].dataType.simpleString()
    shape = f"item_id {item_type}, rank int, doc_id long, score long"

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, n) for i, x in enumerate(batch.column("text").to_pylist()) for t, n in Counter(terms_of(x)).items()]
            which, term, repeats = zip(*rows) if rows else ((), (), ())
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(take), pa.array(term, pa.binary()),
                                              pa.array(repeats, pa.int64())], ["item", "term", "repeats"])

    # an item is its id and text; its number in a batch is given when the batch is read
    asked = asked.withColumn("item", F.sha2(F.concat_ws("\u0001", F.col("item_id").isNull().cast("string"),
                                                        F.col("item_id").cast("string"), "text"), 256))
    asked = stage(asked, "items")
    pairs = asked.select("item", "text").mapInArrow(item_terms, "item string, term binary, repeats long")
    pairs = stage(pairs.join(held, "term", "left").na.fill(0, ["holders"]), "item-terms")
    n_pairs, n_items = pairs.count(), asked.count()
    n_batches = max(1, -(-n_pairs // PAIRS), -(-n_items // ITEMS))
    if n_batches > 1:  # leave room for uneven batches
        n_batches = n_batches + (n_batches + 3) // 4
    result = None
    for number in range(n_batches if n_docs else 0):
        of_batch = F.pmod(F.xxhash64("item"), F.lit(n_batches)) == number
        by_item: dict[str, dict[bytes, tuple[int, int]]] = {}
        for item, term, repeats, holders in pairs.filter(of_batch).select("item", "term", "repeats", "holders").collect():
            by_item.setdefault(item, {})[bytes(term)] = (repeats, holders)
        if not by_item:
            continue
        numbers = {item: q for q, item in enumerate(sorted(by_item))}
        shared = sc.broadcast(Batch({numbers[i]: t for i, t in by_item.items()}, n_docs, n_terms))

        def scored(chosen: DataFrame, shared=shared) -> DataFrame:
            """Exact scores of pairs; documents meet their items by key (Spark sends a small table to all)."""
            per_doc = stage(chosen.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("q")).alias("qs")), "pairs")
            some = texts.join(per_doc, ["k1", "k2"]).select("id", "text", "qs")
            return stage(some.mapInArrow(tidy(exact_scores(shared)), "q int, doc_id long, score long"), "scores")

        bounds = sketches.mapInArrow(tidy(highest_bounds(shared, FIRST)), PAIR)
        first = stage(first_of(bounds, ["q"], [F.desc("bound"), "k1", "k2"], FIRST, F.col("k1")).drop("rank"), "first")
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        known = scored(first)
        by_score = first_of(known, ["q"], best, top, F.xxhash64("doc_id"))
        thresholds = sc.broadcast({r["q"]: r["score"] for r in by_score.filter(F.col("rank") == top).collect()})
        rest = sketches.mapInArrow(tidy(reaching(shared, thresholds)), PAIR).join(first, ["q", "k1", "k2"], "left_anti")
        both = known.unionByName(scored(rest))
        names = spark.createDataFrame(list(numbers.items()), "item string, q int")
        part = first_of(both, ["q"], best, top, F.xxhash64("doc_id", "score")).join(names, "q").join(asked, "item")
        part = stage(part.select("item_id", "rank", "doc_id", "score"), "found")
        result = part if result is None else result.unionByName(part)
        shared.unpersist()
        thresholds.unpersist()
    return spark.createDataFrame([], shape) if result is None else result
