"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and characters beyond ASCII.  A window is ``span`` consecutive
words of a benchmark item; an item of fewer words, but some, is one window as a whole.  Of the k-gram hashes
of a text, winnowing keeps those that are the minimum of some ``span - k + 1`` consecutive ones, so a shared
passage of at least ``span`` words has a kept k-gram in common, whatever stands around it.  A kept k-gram of
a document that a benchmark item kept too is extended: the windows that can hold it are looked up word for
word, and every word inside a found window is hit.  Items below ``span`` words have as many words as their
only window, so each such length is winnowed with its own k and a span of one k-gram.

The benchmark's fingerprints and windows go to the executors in parts of at most ``part_bytes`` of benchmark
text each (checked before anything is sent).  A benchmark of one part is one pass over the documents without a
shuffle; a larger one takes a pass per part, each adding its hits to those before, with a checkpoint between.

Defined results: null text, in either table, has no words.  An item whose id is null marks words as hit but is
not listed.  Repeated items count once per id.  Repeated documents are judged row by row; an empty benchmark
leaves all documents clean; other columns pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, free_name, text_or_empty
from busguard.llm.words import BY_ALNUM, shingles, word_hashes
from busguard.session import cut_lineage

SPAN = 10
K = 5
PART_BYTES = 16 << 20

HITS = "n_words long, spans array<long>, items array<string>"


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Which of the hashes are the least of some ``window`` consecutive ones (ties all count)."""
    n = len(grams) - window + 1
    keep = np.zeros(len(grams), dtype=bool)
    if n <= 0:
        return keep
    least = grams[:n].copy()
    for j in range(1, window):
        np.minimum(least, grams[j:j + n], out=least)
    for j in range(window):
        keep[j:j + n] |= grams[j:j + n] == least
    return keep


class Benchmark:
    """Fingerprints and windows of some benchmark items; see the module text."""

    def __init__(self, items: list[tuple[str | None, str]], span: int, k: int):
        self.span, self.k = span, min(k, span)
        self.windows: dict[bytes, set[str | None]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            raw = text.encode().lower()
            hashes, first, last = word_hashes(raw, BY_ALNUM)
            n = len(hashes)
            if not n:
                continue
            width = min(n, span)
            words = [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
            for i in range(n - width + 1):
                self.windows.setdefault(b" ".join(words[i:i + width]), set()).add(item)
            grams = shingles(hashes, self.k if width == span else width)
            keep = winnow(grams, span - self.k + 1) if width == span else slice(None)
            prints.setdefault(width, []).append(grams[keep])
        self.prints = {width: np.unique(np.concatenate(parts)) for width, parts in prints.items()}

    def hits(self, text: str) -> tuple[int, list[int], set[str | None]]:
        """Number of words, the hit stretches as [first, past the last) pairs in a row, and the items found."""
        raw = text.encode()
        hashes, first, last = word_hashes(raw, BY_ALNUM)
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        lowered = None
        for width, known in self.prints.items():
            full = width == self.span
            grams = shingles(hashes, self.k if full else width)
            reach = self.span - self.k + 1 if full else 1
            if len(grams) < reach:
                continue
            kept = np.flatnonzero(winnow(grams, reach)) if full else np.arange(len(grams))
            at = np.minimum(np.searchsorted(known, grams[kept]), len(known) - 1)
            found = kept[known[at] == grams[kept]]
            if not len(found):
                continue
            starts = np.unique((found[:, None] - np.arange(reach)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + width <= len(hashes))]
            lowered = raw.lower() if lowered is None else lowered
            for i in starts.tolist():
                words = [lowered[a:b] for a, b in zip(first[i:i + width].tolist(), last[i:i + width].tolist())]
                if (which := self.windows.get(b" ".join(words))) is not None:
                    items |= which
                    spans.append((i, i + width))
        return len(hashes), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of half-open stretches, in order, as one flat list."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def benchmark_parts(benchmark: DataFrame, id: str, text: str, part_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in lists of at most ``part_bytes`` of text (an item of more has a list of its own).

    Items are read part by part, so that the driver holds one part beside what it has sent.
    """
    rows = benchmark.select(col(benchmark, id).cast("string").alias("item"),
                            text_or_empty(col(benchmark, text)).alias("text")).filter(F.length("text") > 0)
    part, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row.text.encode())
        if part and size + n > part_bytes:
            yield part
            part, size = [], 0
        part.append((row.item, row.text))
        size += n
    yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", span: int = SPAN, k: int = K, part_bytes: int = PART_BYTES,
                       n_words_as: str = "n_words", spans_as: str = "hit_spans",
                       items_as: str = "hit_items") -> DataFrame:
    """``docs`` with their words counted, hit stretches [first word, past the last) and ids of items found, sorted."""
    spark = docs.sparkSession
    res = free_name(docs, "hits")
    out = docs
    for number, part in enumerate(benchmark_parts(benchmark, item_id, item_text, part_bytes)):
        sent = spark.sparkContext.broadcast(part)
        earlier = F.col(res) if number else F.lit(None).cast(f"struct<{HITS.replace(' ', ':').replace(',:', ',')}>")
        if number:
            out = cut_lineage(out)
        out = out.withColumn(res, hits_udf(sent, span, k)(text_or_empty(col(out, text)), earlier["spans"],
                                                          earlier["items"]))
    return out.withColumns({n_words_as: F.col(res)["n_words"], spans_as: F.col(res)["spans"],
                            items_as: F.col(res)["items"]}).drop(res)


def hits_udf(sent, span: int, k: int):
    @F.pandas_udf(HITS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bench = Benchmark(sent.value, span, k)
        for texts, spans, items in batches:
            rows = []
            for t, had, listed in zip(texts, spans, items):
                n, hit, found = bench.hits(t)
                if had is not None and len(had):
                    hit = merged(list(itertools.batched([*hit, *map(int, had)], 2)))
                names = {x for x in found if x is not None}.union(listed if listed is not None else ())
                rows.append((n, hit, sorted(names)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])
    return run
