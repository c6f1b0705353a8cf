"""What a batch of requests moves and writes."""

from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import resolution, retrieval
from granary.plans import catalog

SF = "/root/testdata/sf0.001"


def test_texts_of_requests_are_not_written(spark, monkeypatch):
    """Before, the texts were settled twice with the requests, and moved with each candidate as words."""
    seen, settle = [], resolution.settle
    monkeypatch.setattr(resolution, "settle", lambda df: seen.append(df.schema) or settle(df))
    catalog.QUERIES["batch_resolution"](spark, SF)
    names = {f.name for schema in seen for f in schema}
    assert len(seen) > 5 and not names & {"terms", "words", "p_fields"}


def test_codes_have_in_common_what_words_have(spark, monkeypatch):
    rows = [(1, ["a", "b", "z"]), (2, []), (3, None), (4, ["c"]), (5, ["q", "a"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    known = spark.createDataFrame([("a",), ("b",), ("q",)], "token string")
    monkeypatch.setattr(retrieval, "TEXTS", 2)
    got = {r["id"]: r["words"] for r in retrieval.coded(df, "words", known).collect()}
    assert {k: v if v is None else len(v) for k, v in got.items()} == {1: 2, 2: 0, 3: None, 4: 0, 5: 2} and len(set(got[1]) & set(got[5])) == 1
    monkeypatch.setattr(retrieval, "MAX_TOKENS", 2)
    assert {r["id"]: r["words"] for r in retrieval.coded(df, "words", known).collect()} == dict(rows)


def test_what_requests_share_is_decided_once(spark, monkeypatch):
    """Before, profiles, rules and evidence were joined to each request; a limit of evidence makes no other question unless it is too large."""
    seen, settle = [], resolution.settle
    monkeypatch.setattr(resolution, "settle", lambda df: seen.append(settle(df)) or seen[-1])
    catalog.QUERIES["whole_batch_resolution"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = docs.selectExpr("source", "lang", "doc_id % 2", "doc_id % 3 = 0", "doc_id % 3 > 0 and doc_id % 25 >= 20").distinct().count()
    decided = [df.count() for df in seen if "reason" in df.columns]
    assert asked < docs.count() and decided[0] == asked and max(decided) == asked
    # Words of requests are read where a question has candidates only: no row of another is written.
    rows = next(df for df in seen if "score" in df.columns)
    assert {"request_id", "question"} <= set(rows.columns) and not [df for df in seen if "request_id" in df.columns and df is not rows]


def test_repeated_words_are_one_code(spark, monkeypatch):
    """Before, words had to be distinct in the JVM already."""
    df = spark.createDataFrame([(1, ["b", "a", "b", ""]), (2, ["a", "a"]), (3, None)], "id long, words array<string>")
    known = spark.createDataFrame([("a",), ("b",)], "token string")
    got = {r["id"]: r["words"] for r in retrieval.coded(df, "words", known).collect()}
    assert got[3] is None and len(got[1]) == 2 and len(got[2]) == 1 and got[2][0] in got[1]
    monkeypatch.setattr(retrieval, "MAX_TOKENS", 1)
    assert {r["id"]: r["words"] for r in retrieval.coded(df, "words", known).collect()} == {1: ["b", "a", ""], 2: ["a"], 3: None}


def test_pieces_are_the_tokens(spark):
    texts = ["", " ", "a", "-a-b_1--A", "Straße ÉTÉ\u2014x\u0663 \u6f22\u5b57 \u0130i", "\U0001d400\U0001f600b\u0301c", "...\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(text.tokens(F.col("t")).alias("tokens"), F.array_distinct(F.array_remove(text.pieces(F.col("t")), "")).alias("pieces")).collect()
    assert all(r["tokens"] == r["pieces"] for r in got) and got[3]["pieces"] == ["a", "b_1"] and got[7]["pieces"] is None
