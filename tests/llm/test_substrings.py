"""Suffix arrays and the removal of repeated substrings."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import kit  # noqa: E402

from busguard.llm import substring_dedup  # noqa: E402
from busguard.llm.queries import Q  # noqa: E402
from busguard.llm.suffix_array import permuted_prefixes, suffix_array  # noqa: E402


def removed(rows, window):
    """Every window of every text counted, one by one."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s:s + window] for _, b in texts for s in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if count[b[s:s + window]] > 1:
                gone[s:s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digests(out):
    return kit.as_rows(out.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) AS gone",
                                      "size(removed_spans) div 2 AS spans", "sha2(kept, 256) AS kept_sha256"),
                       "doc_id", "n_bytes", "gone", "spans", "kept_sha256")


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(letters)
    for n in [1, 2, 30, 31, 60, 200, 300]:
        t = [rng.randint(1, letters) for _ in range(n)] + [0]
        order = sorted(range(n + 1), key=lambda i: t[i:])
        sa = suffix_array(np.array(t))
        assert sa.tolist() == order
        phi, common = permuted_prefixes(np.array(t, dtype=np.int32), sa, np.zeros(n + 1, dtype=bool), 1000)
        for i, j in zip(order[1:], order):
            most = min(n + 1 - i, n + 1 - j)
            assert phi[i] == j and common[i] == next((x for x in range(most) if t[i + x] != t[j + x]), most)


def made_rows():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = []
    for i in range(80):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.6:
            a = rng.randint(0, 30)
            text += passage[a:a + rng.randint(5, 60)] + "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 30)))
        rows.append((i if i % 9 else None, text))
    return rows + [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 100), (204, rows[3][1]), (204, rows[3][1]),
                   (204, rows[4][1]), (205, "a" * 90 + "zz"), (206, "\U0001f600" * 30)]


@pytest.mark.parametrize("hot,shard,run", [(1 << 20, 1 << 20, 1024), (200, 500, 7), (60, 2000, 1024)])
def test_small_windows(spark, monkeypatch, hot, shard, run):
    """One shard; many shards; keys that are split at further levels."""
    monkeypatch.setattr(substring_dedup, "MAX_RUN", run)
    rows = made_rows()
    df = kit.with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = substring_dedup.remove_repeats(df, window=20, hot_bytes=hot, shard_bytes=shard)
    assert set(df.columns) < set(out.columns)
    kit.same(digests(out), removed(rows, 20))


def test_stretches_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 64)
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(2000))
    rows = [(1, text), (2, text[700:900] + "zzz" + text[100:130]), (3, text[::-1])]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=20)
    kit.same(digests(out), removed(rows, 20))


def test_query_on_edge_documents_and_none(spark, tmp_path):
    rows = kit.edge_docs()
    rows = [(r[0], r[1][:6000] if r[1] else r[1], *r[2:]) for r in rows]  # the brute force counts each window
    sf = kit.table_dir(tmp_path, documents=kit.with_clashes(kit.docs_frame(spark, rows)))
    found = kit.as_rows(Q["op11_suffix_dedup"][0](spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    kit.same(found, removed(kit.pairs(rows), 400))
    none = kit.table_dir(tmp_path / "none", documents=kit.docs_frame(spark, []))
    assert Q["op11_suffix_dedup"][0](spark, none).collect() == []


def test_query_on_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = kit.as_rows(Q["op11_suffix_dedup"][0](spark, "/root/testdata/sf0.001"),
                        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = removed(rows, 400)
    assert any(r[2] for r in want)
    kit.same(found, want)


def test_stage_tables_can_be_dropped(spark):
    out = substring_dedup.remove_repeats(spark.createDataFrame(made_rows(), "doc_id long, text string"), window=20)
    n = len(out.collect())
    substring_dedup.release(out)
    assert n == len(made_rows())
