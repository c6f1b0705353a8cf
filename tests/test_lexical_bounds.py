"""What is asked of all pairs of requests and texts stays in bounds, and equals plain forms and SQL on odd tables."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import retrieval
from granary.plans import catalog
from tests.test_odd_tables import agree

WORDS = "a b c d e f g h Éa é 12 x_y".split()


@pytest.fixture
def odd():
    """Documents with null texts and languages, empty texts, gaps between ids and ties of score, and requests that say nothing."""
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choices(WORDS, k=rng.randrange(n)))
    docs = [(i, rng.choice([None, said(7), said(7), said(3)]), rng.choice([None, "de", "en"]), f"src{i % 5}") for i in rng.sample(range(400), 300)]
    asked = [(i, rng.choice([None, "", said(5), said(5), said(5)])) for i in range(40)]
    return {"documents": (docs, "doc_id long, text string, lang string, source string"), "benchmark": (asked, "item_id long, text string")}


def small(monkeypatch):
    for name, value in (("PAIRS", 7), ("TEXTS", 3), ("MAX_TOKENS", 30)):
        monkeypatch.setattr(retrieval, name, value)


def test_members_of_buckets_agree_with_sql(spark, tmp_path, odd, monkeypatch):
    want = agree(spark, tmp_path, "representatives", **odd)
    small(monkeypatch)
    assert agree(spark, tmp_path, "representatives", **odd) == want and len(want) > 100


def test_members_of_a_large_bucket(spark, monkeypatch):
    """A bucket is held as one row for each request, however many members it has and wherever batches end."""
    small(monkeypatch)
    asked = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "z")], "request_id long, text string")
    docs = [(i, i // 100, i % 2, 0 if i % 3 else 1, "abcd"[i % 4] + " b" * (i % 7 == 0)) for i in range(250)]
    said = spark.createDataFrame(docs, "evidence_id long, bucket long, before long, after long, text string").repartition(3)
    want = {}
    for i, bucket, before, after, text in docs:
        for r, words in ((1, {"a", "b"}), (2, {"b", "c"})):
            if score := len(words & set(text.split())):
                want.setdefault((r, bucket), []).append((before, -score, after, i))
    got = sorted(map(tuple, retrieval.lexical_members(asked, said).collect()))
    assert got == sorted((*k, min(v)[-1], len(v)) for k, v in want.items())


def test_pairs_are_not_aggregated(spark):
    plan = catalog.QUERIES["representatives"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan


@pytest.mark.parametrize("bounded", [False, True])
def test_walk_of_references_where_texts_lie(spark, tmp_path, odd, monkeypatch, bounded):
    if bounded:
        small(monkeypatch)
        monkeypatch.setattr(retrieval, "MAX_HELD", 50)
    assert len(agree(spark, tmp_path, "grounded_selection", **odd)) > 10
    asked = spark.createDataFrame(*odd["benchmark"]).toDF("request_id", "text").withColumn("least", F.col("request_id") % 3)
    docs = spark.createDataFrame(*odd["documents"]).select(F.col("doc_id").alias("evidence_id"), "text", (F.col("doc_id") % 11).alias("ref"), (F.col("doc_id") % 4).alias("level")).repartition(4)
    may = F.col("level") >= F.col("least")
    scored = retrieval.lexical_scores(asked, docs).join(docs.drop("text"), "evidence_id").join(asked.drop("text"), "request_id").where(may)
    want = retrieval.within_references(scored, 4, 9).select("request_id", "evidence_id", "score", "rank")
    got = retrieval.lexical_within_references(asked, docs, may, 4, 9).select("request_id", "evidence_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_held_references_are_the_best_of_all():
    rng = np.random.default_rng(5)
    request, ids = np.repeat(np.arange(6), 500), np.tile(np.arange(500), 6)
    refs, scores = ids % 37, rng.integers(1, 9, 3000).astype(float)
    held = retrieval.HeldReferences(6, 5)
    for part in np.array_split(rng.permutation(3000), 60):
        held.offer_of(request[part], refs[part], ids[part], scores[part])
    for r in range(6):
        best = {}
        for s, i in sorted(zip(-scores[request == r], ids[request == r], strict=True)):
            best.setdefault(i % 37, (s, i))
        want = sorted(best.values())[:5]
        assert list(zip(-held.scores[r], held.ids[r], strict=True)) == want and list(held.refs[r]) == [i % 37 for _, i in want]


def test_matches_of_texts_come_in_blocks():
    """Four million matches of 2,000 texts with 500 requests take some MB, not some for each match."""
    first, owners = np.arange(0, 2001, 500), np.tile(np.arange(500), 4)
    row, token = np.repeat(np.arange(2000), 4), np.tile(np.arange(4), 2000)
    tracemalloc.start()
    n = sum(scores.sum() for _, _, scores in retrieval._matched(row, token, np.ones(8000), first, owners, 500))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4_000_000 and peak < 60e6
