"""Ranked lexical search and hard negatives, against plain versions written from the contracts."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import kit  # noqa: E402

from busguard.llm import hard_negatives, lexical_search  # noqa: E402
from busguard.llm.queries import Q  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


# ---- op12

def ranked(docs, items, top=20):
    counted = [(i, Counter(TERM.findall((t or "").translate(brute.LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(TERM.findall((text or "").translate(brute.LOWER)))
        scores = []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1)))
                    * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


ITEMS = [("a", "lorem Ipsum word3 word7 word7"), ("b", None), ("c", ""), ("d", "?!"), (None, "été à la plage"),
         ("e", "nowhere"), ("a", "one two"), ("a", "one two"), ("f", "document text own of a this line " * 30),
         ("g", "api_key=zzzzzz 40e29b AKIA12"), ("h", " ".join(f"word{i}" for i in range(60)))]


@pytest.mark.parametrize("coordinates,first,items", [(1 << 16, 40, 256), (8, 1, 2)])
def test_ranked_search_on_edge_rows(spark, tmp_path, monkeypatch, coordinates, first, items):
    """With eight coordinates nearly all terms fold together: bounds are loose, results the same."""
    monkeypatch.setattr(lexical_search, "COORDINATES", coordinates)
    monkeypatch.setattr(lexical_search, "FIRST", first)
    monkeypatch.setattr(lexical_search, "ITEMS", items)
    monkeypatch.setattr(lexical_search, "MEMO", 50)
    rows = kit.edge_docs() + [(i, "one two three", "en", "a", 1) for i in range(300, 340)]
    sf = kit.table_dir(tmp_path, documents=kit.with_clashes(kit.docs_frame(spark, rows)),
                       benchmark=kit.with_clashes(spark.createDataFrame(ITEMS, "item_id string, text string")))
    found = kit.as_rows(Q["op12_max_sketch"][0](spark, sf), "item_id", "rank", "doc_id", "score")
    kit.same(found, ranked(kit.pairs(rows), ITEMS))


def test_bounds_hold(spark):
    docs = [" ".join(f"t{(i * j) % 97}" for j in range(i % 50 + 1)) for i in range(200)]
    counts = [Counter(lexical_search.terms_of(d)) for d in docs]
    holders = Counter(t for c in counts for t in c)
    n_terms = sum(sum(c.values()) for c in counts)
    items = {q: {b"t%d" % ((q * 7 + j) % 97): (1 + j % 2, holders[b"t%d" % ((q * 7 + j) % 97)]) for j in range(9)}
             for q in range(12)}
    import pyarrow as pa
    for coordinates in (16, 1 << 16):
        lexical_search.COORDINATES, before = coordinates, lexical_search.COORDINATES
        try:
            batch = lexical_search.Batch(items, len(docs), n_terms)
            texts = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(range(len(docs))), pa.array(docs)],
                                               ["k1", "k2", "text"])
            sketches = next(lexical_search.index_rows(iter([texts])))
            bounds = np.concatenate([b for _, b in batch.bounds(sketches)])
        finally:
            lexical_search.COORDINATES = before
        for d, c in enumerate(counts):
            m = lexical_search.norms(sum(c.values()), len(docs), n_terms)
            for q in range(12):
                assert batch.score(q, c, m) <= bounds[d, q]


def test_ranked_search_of_nothing(spark, tmp_path):
    no_items = spark.createDataFrame([], "item_id string, text string")
    docs = kit.docs_frame(spark, kit.edge_docs()[:5])
    for name, d, b in (("a", kit.docs_frame(spark, []), spark.createDataFrame(ITEMS, "item_id string, text string")),
                       ("b", docs, no_items), ("c", kit.docs_frame(spark, []), no_items)):
        out = Q["op12_max_sketch"][0](spark, kit.table_dir(tmp_path / name, documents=d, benchmark=b))
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# ---- op13

def mined(rows, positives=5, negatives=3):
    usable = {(i, label, tuple(math.floor(256 * float(x)) for x in v)) for i, label, v in rows
              if i is not None and label is not None and v and None not in v and all(map(math.isfinite, v))}
    width = Counter(len(v) for _, _, v in usable).most_common(1)[0][0] if usable else 0
    usable = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in usable if len(v) == width]
    out = []
    for i, label, v in usable:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in usable if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(-n, j) for n, j, other in scored if other != label and -50 * s <= -100 * n <= -95 * s][:negatives]
            out += [(i, p, rank, j, -s, n) for rank, (n, j) in enumerate(fits, 1)]
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("first,block,per_cell", [(2048, 4096, 256), (10, 8, 4), (1, 64, 1)])
def test_hard_negatives(spark, tmp_path, monkeypatch, first, block, per_cell):
    """One cell; many cells with blocks; a first turn of a single cell."""
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", per_cell)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 7))
    rows = [(i, int(i % 4), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=7) * 0.4]) for i in range(1, 260)]
    twin = rows[49][2]
    rows += [(300 + i, i % 10, twin) for i in range(12)]  # ties
    rows += [rows[99], (400, 1, None), (401, None, twin), (402, 1, [1.0, None] + [0.0] * 5), (403, 1, [float("nan")] * 7),
             (404, 1, [float("inf")] * 7), (None, 1, twin), (405, 1, [1.0, 2.0]), (406, 1, []), (407, 2, [0.0] * 7),
             (450, 3, [-x for x in twin]), (50, 9, twin), (500, 1, [400.0 * x for x in twin])]
    shape = "vec_id long, label int, embedding array<double>"
    sf = kit.table_dir(tmp_path, embeddings=spark.createDataFrame(rows, shape))
    found = kit.as_rows(Q["op13_hard_negatives"][0](spark, sf), *COLUMNS)
    want = mined(rows)
    assert len(want) > 30
    kit.same(found, want)


def test_hard_negatives_of_nothing(spark, tmp_path):
    shape = "vec_id long, label int, embedding array<double>"
    for name, rows in (("none", []), ("one", [(50, 1, [1.0, 0.0])]), ("unusable", [(50, 1, None)]),
                       ("width1", [(50, 1, [1.0]), (51, 1, [0.9]), (52, 2, [0.8])])):
        sf = kit.table_dir(tmp_path / name, embeddings=spark.createDataFrame(rows, shape))
        kit.same(kit.as_rows(Q["op13_hard_negatives"][0](spark, sf), *COLUMNS), mined(rows))


def test_visits_are_in_order_and_certified():
    rng = np.random.default_rng(1)
    rows = hard_negatives.whole_numbers(rng.normal(size=(500, 6))).astype(float)
    books = hard_negatives.codebook(rows[:, :3], 8, 1), hard_negatives.codebook(rows[:, 3:], 8, 2)
    halves = rows[:, :3], rows[:, 3:]
    near = [hard_negatives.distances(h, b).argmin(axis=1) for h, b in zip(halves, books)]
    far = [np.linalg.norm(h - b[n], axis=1) for h, b, n in zip(halves, books, near)]
    stats = [(i, j, int(at.sum()), far[0][at].max(), far[1][at].max()) for i in range(8) for j in range(8)
             if (at := (near[0] == i) & (near[1] == j)).any()]
    cells = hard_negatives.Cells(*books, stats)
    for anchor in rows[:20]:
        visits = list(cells.visits(anchor))
        assert {(i, j) for _, i, j, _, _ in visits} == {s[:2] for s in stats}
        bounds = [b for b, *_ in visits]
        assert bounds == sorted(bounds, reverse=True)
        for bound, i, j, upper, lower in visits:
            scores = rows[(near[0] == i) & (near[1] == j)] @ anchor
            assert lower <= scores.min() and scores.max() <= upper <= bound + 2


@pytest.mark.parametrize("second", [False, True])
def test_visits_come_in_batches_of_bounded_size(monkeypatch, second):
    """An ask may visit every cell: all visits of a batch of asks at once would not fit in memory."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 0 if second else 1 << 40)
    rng = np.random.default_rng(3)
    books = rng.normal(size=(12, 2)) * 100, rng.normal(size=(12, 2)) * 100
    cells = hard_negatives.Cells(*books, [(i, j, 1, 50.0, 50.0) for i in range(12) for j in range(12)])
    vectors = rng.integers(-300, 300, size=(200, 4))
    lows, highs = [[hard_negatives.LOW]] * 200, [[hard_negatives.HIGH]] * 200
    asks = pa.RecordBatch.from_arrays(
        [pa.array(range(200)), pa.array(range(200)), pa.array([1] * 200), pa.array(hard_negatives.packed(vectors), pa.binary()),
         pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int64()))],
        [*hard_negatives.ASK, "reached"])
    batches = list(hard_negatives.visits_of(SimpleNamespace(value=cells), 4, second)(iter([asks, asks.slice(0, 0)])))
    got = [(r["key"], r["i"], r["j"]) for b in batches for r in b.select(["key", "i", "j"]).to_pylist()]
    assert got == [(k, *at) for k, v in enumerate(vectors.astype(float)) for at in hard_negatives.wanted_cells(
        cells, v, lows[k], highs[k], lows[k] if second else None)]
    assert len(got) == 200 * 144 and max(b.num_rows for b in batches) <= 8192
