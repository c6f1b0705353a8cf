"""Every query of the grounding engine against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from granary.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return [plain(y) for y in x]
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 9) if isinstance(x, (int, float, np.number)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_entry_gives_the_flagship_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in ("granary.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert entry.queries() == catalog.QUERIES and entry.oracle_sql() == catalog.ORACLE_SQL


def test_whole_release_reports_only_what_is_missing(spark, tmp_path):
    for t in ("labels", "documents", "supplier", "lineitem", "customer", "benchmark", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    custkey = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 10 = 0").first()["c_custkey"]
    spark.createDataFrame([(custkey,), (-7,)], "o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = catalog.QUERIES["whole_release_violations"](spark, str(tmp_path)).where("rule = 'order without customer'").collect()
    assert [r["key"] for r in found] == ["-7"]
    spark.read.parquet(f"{SF}/nation.parquet").where("n_nationkey <> 3").write.parquet(str(tmp_path / "nation.parquet"))
    assert {r["topic_id"] for r in catalog.QUERIES["whole_release_coverage"](spark, str(tmp_path)).collect()} == {f"t{k}" for k in range(25) if k != 3}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    unknown = {r["request_id"] for r in catalog.QUERIES["whole_batch_resolution"](spark, str(tmp_path)).where("reason = 'unknown_id'").collect()}
    assert unknown == {d for d, s in source.items() if s not in {f"src{k}" for k in range(25) if k != 3}}


def test_language_ledger_counts_every_document(spark, tmp_path):
    docs = [(1, "a", "it"), (2, "a", None), (3, None, "en"), (4, "a", "it")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["source_language_ledger"](spark, str(tmp_path)).collect()}
    assert got == {("a", "it", 2), ("a", None, 1), (None, "en", 1)}
