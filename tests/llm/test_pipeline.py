"""The pipeline's stages against brute force, and its run over the driver's smallest table."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import kit  # noqa: E402

import corpus_pipeline  # noqa: E402
from busguard.llm import language_id  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    items = [(1, " ".join(f"word{i}" for i in range(40, 55))), (2, None)]
    return kit.table_dir(tmp_path_factory.mktemp("sf"), benchmark=spark.createDataFrame(items, "item_id long, text string"))


def test_every_stage_returns_the_columns(spark, sf):
    docs = kit.with_clashes(kit.docs_frame(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert STAGE["sentencepiece"](spark, docs.limit(0), sf).count() == 0


def test_language_stage_drops_what_it_cannot_tell(spark, sf):
    docs = kit.docs_frame(spark)
    kept = {r.doc_id for r in STAGE["language_id"](spark, docs, sf).collect()}
    assert kept.isdisjoint({20, 21, 22, 23}) and {24, 26, 28, 31} <= kept
    unlabelled = docs.withColumn("lang", docs["lang"].substr(0, 0)).replace("", None, ["lang"])
    assert {r.doc_id for r in STAGE["language_id"](spark, unlabelled, sf).collect()} >= {1, 24, 28}


def test_lines_and_lengths(spark, sf):
    got = {(r.doc_id, brute.sha(r.text)): r for r in STAGE["line_dedup"](spark, kit.docs_frame(spark), sf).collect()}
    want = {(r[0], r[3]) for r in brute.line_dedup(kit.pairs(kit.edge_docs()))}
    assert got.keys() == want and all(r.n_chars == len(r.text) for r in got.values())


def test_one_of_each_group_stays(spark, sf):
    rows = [r for r in kit.edge_docs() if r[0] is not None]
    got = sorted(r.doc_id for r in STAGE["jaccard_join"](spark, kit.docs_frame(spark, rows), sf).collect())
    groups = brute.components(kit.pairs(rows), 5, 80)
    assert got == sorted({i for i, _, least in groups if i == least})


def test_contaminated_documents_go(spark, sf):
    rows = kit.edge_docs()
    got = STAGE["decontaminate"](spark, kit.docs_frame(spark), sf).collect()
    items = [(1, " ".join(f"word{i}" for i in range(40, 55))), (2, None)]
    clean = [r[0] for r in brute.contamination(kit.pairs(rows), items) if not r[-1]]
    assert sorted((r.doc_id or -1 for r in got)) == sorted(i or -1 for i in clean) and len(clean) < len(rows)


def test_run_equals_the_stages_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs.filter(~language_id.is_held_out(docs["doc_id"])))
    judge = language_id.Classifier(model)
    rows = [(r.doc_id, r.text) for r in docs.collect() if not judge.predict(r.text or "")[2]]
    cut = {(i, h) for i, _, _, h in brute.line_dedup(rows)}
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(brute.WHITE).translate(brute.LOWER), set()).add(i)
    rows = [(i, "\n".join(x for x in (t or "").split("\n")
                          if not (len(k := x.strip(brute.WHITE).translate(brute.LOWER)) >= 40
                                  and len(holders[k]) >= 5 and max(holders[k]) != i))) for i, t in rows]
    assert {(i, brute.sha(t)) for i, t in rows} == cut
    least = {i for i, _, c in brute.components(rows, 5, 80) if i == c}
    rows = [(i, t) for i, t in rows if i in least]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.contamination(rows, items) if r[-1]}
    want = brute.sentencepiece([(i, t) for i, t in rows if i not in bad])
    kit.same(kit.as_rows(corpus_pipeline.run(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_a_run_leaves_only_its_result_in_the_scratch_folder(spark, tmp_path):
    import os
    from busguard.llm import common
    from busguard.session import checkpoint_dir
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    sf = kit.table_dir(tmp_path, documents=kit.docs_frame(spark),
                       benchmark=spark.createDataFrame([("a", "no such text anywhere")], "item_id string, text string"))
    out = corpus_pipeline.run(spark, sf)
    new = set(os.listdir(root)) - before
    assert [n.split("-")[:2] for n in new if not n.startswith((".", "rdd-"))]  # Spark's checkpoints aside == [["pipeline", "sentencepiece"]]
    assert out.count() > 0 and len(common.CREATED) >= 1
