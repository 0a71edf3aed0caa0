"""Parts of the operators and their guarantees: winnowing, filters, signatures, agendas, shuffles, stages."""

from __future__ import annotations

import random
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import kit  # noqa: E402

from busguard.llm import decontaminate, jaccard_join, line_dedup, secret_scan, sentencepiece_codec, shards, words  # noqa: E402


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.model_path(sentencepiece_codec.MODEL))


# ---- sentencepiece

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_ids_equal_the_library(codec, texts):
    for text, ids in zip(texts, codec.encode(texts)):
        want = codec.sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids) == codec.sp.decode(want)


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 3000, " " * 700, "a" + "\n" * 300 + "b", "▁" * 90, "word" * 200 + "é"])
def test_long_chunks_equal_the_library(codec, text):
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == codec.sp.encode(text, add_bos=True, add_eos=True)


def test_memo_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMO_CHUNKS", 50)
    codec.encode([" ".join(f"w{i}x{j}" for j in range(40)) for i in range(2000)])
    assert len(codec.memo) <= 50


# ---- winnowing

@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 30), st.integers(0, 30), st.integers(10, 25))
def test_every_long_shared_span_is_found(seed, before, after, shared):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    span = [word() for _ in range(shared)]
    item = " ".join([*(word() for _ in range(5)), *span, *(word() for _ in range(5))])
    doc = " ".join([*(word() for _ in range(before)), *span, *(word() for _ in range(after))])
    n, hits, items = decontaminate.Benchmark([("1", item)], 10, 5).hits(doc)
    want = brute.contamination([(1, doc)], [("1", item)])[0]
    assert (n, sum(b - a for a, b in zip(hits[::2], hits[1::2])), len(items)) == want[1:4] and want[2] >= shared


def test_large_benchmarks_go_in_parts(spark):
    docs = kit.with_clashes(kit.docs_frame(spark))
    items = [(i, f"own text {i} of a document") for i in range(1, 8)] + [(9, " ".join(f"word{i}" for i in range(40, 52)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.find_contamination(docs, bench)
    parts = decontaminate.find_contamination(docs, bench, part_bytes=60)
    columns = ("doc_id", "n_words", "hit_spans", "hit_items", "kept")
    assert kit.as_rows(parts, *columns) == kit.as_rows(whole, *columns)
    assert whole.filter("size(hit_items) > 0").count() == 13


# ---- line dedup

def test_a_full_filter_loses_nothing(spark):
    docs = kit.with_clashes(kit.docs_frame(spark))
    want = brute.line_dedup(kit.pairs(kit.edge_docs()))
    for bits in (line_dedup.BLOCK_BITS, 16 * line_dedup.BLOCK_BITS):
        out = line_dedup.dedup_lines(docs, filter_bits=bits)
        assert sorted(out.columns) == sorted([*docs.columns, "n_lines", "n_dropped"])
        assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, brute.sha(r.text)) for r in out.collect()) == \
            sorted((r[0] or -1, *r[1:]) for r in want)


def test_only_repeats_are_suspected():
    texts = [f"line number {i} of a corpus that is long enough to count" for i in range(3000)]
    import pandas as pd
    bits = 1 << 22
    frames = list(line_dedup.seen_blocks(iter([pd.Series(texts[:2000]), pd.Series(texts[2000:] + texts[:10])]), 40, bits))
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for frame in line_dedup.merge_blocks(iter(frames)):
        for block, twice in frame.itertuples(index=False):
            whole[block * 8192:(block + 1) * 8192] = np.frombuffer(twice, dtype=np.uint8)
    found = [next(iter(line_dedup.document_digests(t, 40))) for t in texts]
    at = line_dedup.slots(found, bits)
    hit = (whole[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
    assert hit[:10].all() and hit.sum() < 40


# ---- Jaccard join

@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([6, 9, 10, 14, 20, 40, 90, 300]), st.sampled_from([8, 9]),
       st.sampled_from([0, 10**7]))
def test_linked_sets_share_a_key(seed, size, tenths, n_sets):
    rng = np.random.default_rng(seed)
    similarity = Fraction(tenths, 10)
    plans = jaccard_join.Plans({b: n_sets for b in range(40)}, similarity)
    a = np.unique(rng.integers(1, 2**63, size).astype(np.uint64))
    gone = rng.integers(0, size // 5 + 2)
    b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(1, 2**63, rng.integers(0, size // 5 + 2)).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    if not len(b) or common < similarity * (len(a) + len(b) - common) or np.array_equal(a, b):
        return
    small, large = sorted((a, b), key=len)
    band = jaccard_join.band_of(len(large))
    assert band - 1 <= jaccard_join.band_of(len(small)) <= band
    x, y = (jaccard_join.signatures([s], [band], plans)[0] for s in (small, large))
    assert len(np.intersect1d(x, y))
    differ = np.bitwise_count(np.frombuffer(jaccard_join.sketch(a), np.uint64)
                              ^ np.frombuffer(jaccard_join.sketch(b), np.uint64)).sum()
    assert differ <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("block", [4, 1024])
def test_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # some link with the base, some in chains only, some not at all
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(copy), "en", "a", 1))
    docs = kit.with_clashes(kit.docs_frame(spark, rows))
    for k, percent in ((3, 90), (5, 80)):
        got = jaccard_join.similarity_components(docs, k=k, similarity=Fraction(percent, 100))
        kit.same(kit.as_rows(got, "doc_id", "n_shingles", "component_id"), brute.components(kit.pairs(rows), k, percent))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(500, 501), (501, 500)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 130)) and got[501] == 500


def test_batched_sets_equal_single_ones():
    texts = ["", "a", "A b", "one two three four", "  \t\n", "x " * 500, "É é à\x0bB c"]
    for k in (1, 3, 5):
        sets = words.shingle_sets([t.encode() for t in texts], k)
        assert [s.tolist() for s in sets] == [words.shingle_set(t.encode(), k).tolist() for t in texts]
        assert [len(s) for s in sets] == [len(brute.shingles(t, k)) for t in texts]


# ---- shards

def test_shards_law_and_types(spark):
    docs = kit.with_clashes(kit.docs_frame(spark)).withColumnRenamed("drop", "shard")
    rows = shards.shuffle_into_shards(docs, 4, bucket_bytes=2000).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in kit.edge_docs())  # large ids stay exact beside null
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert by.keys() == {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shards.shuffle_into_shards(docs.repartition(7), 4, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)


def test_written_shards_read_back_in_order(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    shards.write_shards(shards.shuffle_into_shards(docs, 7, bucket_bytes=4000), f"{tmp_path}/s")
    got = [[r.doc_id for r in shards.read_shard(spark, f"{tmp_path}/s", i).collect()] for i in range(7)]
    assert sorted(x for part in got for x in part) == list(range(1000))
    assert {len(part) for part in got} == {142, 143} and got[0] != sorted(got[0])


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shards.fisher_yates(3, str(s))) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


# ---- secrets

def test_random_strings_and_known_forms():
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secret_scan.scan(t, encoding)]
    assert kinds("use Zk3vQ9xT1bLr8WmPz0Yd now") == [("random", "Zk3vQ9xT1bLr8WmPz0Yd")]
    for known in ("550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "org.apache.spark.sql.functions4",
                  "2024-01-01T00:00:00Z", "v1.2.3-beta.4", "getElementById2", "internationalisation", "1234567890123456",
                  "============----------", "mail6.example.com"):
        assert kinds(f"a {known} b") == [], known
    assert kinds("token = abcdefZk3vQ9xT1bLr8WmP") == [("assign", "token = abcdefZk3vQ9xT1bLr8WmP")]
    assert kinds("ſecret=abcdefgh K") == []


def test_random_strings_are_found_mostly():
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = ["".join(rng.choices(letters, k=24)) for _ in range(300)]
    assert sum(any(k == "random" for k, _, _ in secret_scan.scan(f"x {s} y", encoding)) for s in made) > 290


@pytest.mark.parametrize("before, after", [
    ("client_secret_value=", ""), ("example.com/reports/download/", ""), ("x/5fa2b6cdb08be96a4a469e2a/", "/page.html"),
    ("//storage.example.com/bucket/archive/report.pdf/signature=", "/download.pdf"),
])
def test_random_parts_of_longer_runs(before, after):
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = 0
    for _ in range(100):
        made = "".join(rng.choices(letters, k=24))
        text = f"\U0001f600 {before}{made}{after} end"
        found += any(k in ("random", "assign") and text[a:b].endswith(made) for k, a, b in secret_scan.scan(text, encoding))
    assert found > 97


def test_parts_of_known_forms_are_left_out():
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    kinds = lambda t: [(k, t[a:b]) for k, a, b in secret_scan.scan(t, encoding)]
    assert kinds("example.com/users/550e8400-e29b-41d4-a716-446655440000/2024/index.html") == []
    assert kinds("example.com/D41D8CD98F00B204E9800998ECF8427E/Zk3vQ9xT1bLr8WmPz0Yd.txt") == [("random", "Zk3vQ9xT1bLr8WmPz0Yd")]
    assert kinds("is Zk3v/Q9xT1bLr+8WmPz0Yd=") == [("random", "Zk3v/Q9xT1bLr+8WmPz0Yd")]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_random_strings_of_one_case(letters):
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    rng = random.Random(6)
    made = ["".join(rng.choices(letters, k=24)) for _ in range(300)]
    for before in ("", "example.com/reports/download/"):
        texts = [f"x {before}{s} y" for s in made]
        assert sum(any(t[a:b] == s for _, a, b in secret_scan.scan(t, encoding)) for t, s in zip(texts, made)) > 270


def test_names_of_one_case_are_no_secrets():
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    for name in ("HAVE_SYS_TYPES_H", "POP_JUMP_IF_NOT_NONE", "f_back.f_back.f_back.f", "DO_NOT_USE_IN_PROD",
                 "internationalization", "UNAUTHORIZEDACCESS", "4111-1111-1111-1111", "Nondeterministic"):
        assert secret_scan.scan(f"a {name} b", encoding) == [], name
    assert [k for k, _, _ in secret_scan.scan("key QXZV-KJWQ-PZXV-WQJK-VXQZ b", encoding)] == ["random"]
