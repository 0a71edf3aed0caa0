"""What the n-gram join keeps on disk and in the driver as tables grow."""

from __future__ import annotations

import os
import re
import sys
import time
from fractions import Fraction

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
import kit  # noqa: E402
import corpus_pipeline  # noqa: E402
from busguard.llm import common, jaccard_join  # noqa: E402
from busguard.session import checkpoint_dir  # noqa: E402


def broadcast_subtrees(plan: str) -> list[str]:
    """The text below every BroadcastExchange of a plan."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:+-]*", line).group()) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    """Spark takes a table for as large as it was before it was exploded."""
    plans, real = [], common.stage_table

    def executed(df) -> None:
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def spy(df, stem, *sizes):
        if stem != "jaccard-edges":
            executed(df)
        return real(df, stem, *sizes)

    monkeypatch.setattr(jaccard_join, "stage_table", spy)
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40 + i % 2))) for i in range(40)]
    out = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    executed(out)
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(i, i - i % 2) for i in range(40)]
    assert any("Generate" in p for p in plans)
    assert not [t for p in plans for t in broadcast_subtrees(p) if "Generate" in t]


def test_labels_with_very_many_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)  # a class of labels is full beyond 16 rows
    common_text = " ".join(f"word{j}" for j in range(30))
    rows = [(i, common_text) for i in range(5, 45)] + [(50 + i, f"a text of its own {i} " * 3) for i in range(5)]
    rows += [(60 + i, None) for i in range(30)] + [(None, common_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similarity_components(docs)
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect()), key=repr) == sorted(
        [(i, 5) for i in range(5, 45)] + [(50 + i, 50 + i) for i in range(5)] + [(60 + i, 60 + i) for i in range(30)]
        + [(None, 5)], key=repr)


@pytest.mark.parametrize("passes,rows_of_a_pass", [(1, 1 << 22), (3, 5), (7, 1)])
def test_passes_over_the_keys_change_nothing(spark, monkeypatch, passes, rows_of_a_pass):
    monkeypatch.setattr(jaccard_join, "PASSES", passes)
    monkeypatch.setattr(jaccard_join, "PASS_ROWS", rows_of_a_pass)
    docs = kit.docs_frame(spark).select("doc_id", "text")
    got = jaccard_join.similarity_components(docs, k=3, similarity=Fraction(9, 10))
    kit.same(kit.as_rows(got, "doc_id", "n_shingles", "component_id"), brute.components(kit.pairs(kit.edge_docs()), 3, 90))


def test_a_stage_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in list_of(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    def list_of(seq):
        return [seq.apply(i) for i in range(seq.size())]

    before = files()
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    staged = common.stage_table(spark.range(1000).repartition(7, "id").groupBy("id").count(), "leaves")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left
    assert staged.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == kept


def test_the_join_leaves_only_its_result_in_the_scratch_folder(spark):
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = jaccard_join.similarity_components(kit.docs_frame(spark).select("doc_id", "text"))
    new = [n for n in set(os.listdir(root)) - before if n.startswith("jaccard")]
    assert [n.split("-")[1] for n in new] == ["result"]
    assert out.count() == len(kit.edge_docs())


def test_texts_of_untouched_documents_are_not_shuffled(spark, tmp_path):
    rows = [(i, f"a text of its own number {i}", "en", "a", 1) for i in range(300)]
    rows += [(300, rows[0][1], "en", "a", 1), (None, rows[1][1], "en", "a", 1), (299, "of a repeated id", "en", "a", 1)]
    docs = common.stage_table(kit.docs_frame(spark, rows), "documents")
    out = corpus_pipeline.jaccard_join(spark, docs, str(tmp_path))
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == list(range(300)) and got.count(None) == 1
    metrics = []

    def walk(plan):
        if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
            metrics.append(plan.metrics().apply("shuffleRecordsWritten").value())
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(plan.plan())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert metrics and max(metrics) < 30
