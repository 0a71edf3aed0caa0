"""Queries over ``documents`` against brute force: edge rows, the driver's smallest table, and empty tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import kit  # noqa: E402

from busguard.llm.queries import Q  # noqa: E402

SMALL = "/root/testdata/sf0.001"
BENCHMARK = [(1, " ".join(f"Word{i}" for i in range(5, 25))), (2, "one two"), (3, None), (None, "boiler plate number"),
             (4, "..."), (1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (10, "own text 3 of a document")]

CASES = {
    "op3_line_dedup": (lambda docs, items: brute.line_dedup(docs), ("doc_id", "n_lines", "n_dropped", "kept_sha256")),
    "op4_secrets": (lambda docs, items: brute.secrets(docs), ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")),
    "op6_decontaminate": (lambda docs, items: brute.contamination(docs, items),
                          ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")),
    "op7_sentencepiece": (lambda docs, items: brute.sentencepiece(docs),
                          ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")),
    "op8_jaccard_join": (lambda docs, items: brute.components(docs, 3, 90), ("doc_id", "n_shingles", "component_id")),
    "op9_shards": (lambda docs, items: brute.sizes(docs), ("doc_id", "size", "text_crc32")),
}


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    return kit.table_dir(tmp_path_factory.mktemp("edge"), documents=kit.docs_frame(spark),
                         benchmark=spark.createDataFrame(BENCHMARK, "item_id long, text string"))


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return kit.table_dir(tmp_path_factory.mktemp("empty"), documents=kit.docs_frame(spark, []),
                         benchmark=spark.createDataFrame([], "item_id long, text string"),
                         pages=spark.createDataFrame([], "page_id long, url string, html string"),
                         embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("name", CASES)
def test_edge_rows(spark, edge_dir, name):
    expected, columns = CASES[name]
    kit.same(kit.as_rows(Q[name][0](spark, edge_dir), *columns), expected(kit.pairs(kit.edge_docs()), BENCHMARK))


@pytest.mark.parametrize("name", CASES)
def test_small_table(spark, name):
    expected, columns = CASES[name]
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    kit.same(kit.as_rows(Q[name][0](spark, SMALL), *columns), expected(docs, items))


@pytest.mark.parametrize("name", Q)
def test_empty_tables(spark, empty_dir, name):
    assert Q[name][0](spark, empty_dir).collect() == []
