"""Joins of whole texts with tables that grow with the corpus: planned alike on a small input and on a large one."""

import re

import pytest

from vigil.llm import line_dedup, minhash_dedup

PASSAGE = "one line of a passage\nanother line of it\na third line\nand a fourth\n"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"head {i}\nsecond {i}\n{PASSAGE}foot {i}\nlast {i}") for i in range(20)], "doc_id long, text string").localCheckpoint()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_joins_texts_by_sorting(spark, docs, monkeypatch):
    plans, keep = {}, line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: (plans.setdefault(name, plan(df)), keep(df, name))[1])
    out = line_dedup.dedup_lines(docs)
    assert re.search(r"SortMergeJoin \[doc_id#\w+, t1#\w+\]", plans["gone"])
    assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
    removed = [r["n_removed_lines"] for r in out.collect()]
    assert len(removed) == 20 and sum(x > 0 for x in removed) > 10


def test_near_dedup_joins_texts_by_sorting(spark, docs):
    same = docs.selectExpr("doc_id", "if(doc_id < 15, 'the same words for all of the first ones', text) AS text")
    for rows in (same, same.union(same.where("doc_id = 1"))):
        out = minhash_dedup.keep_one(rows, 90)
        assert "SortMergeJoin" in plan(out) and "BroadcastHashJoin" not in plan(out)
        assert out.count() == 6
