"""Queries against their SQL on small tables with the oddities that the ordinary ones lack."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from granary.plans import catalog


def agree(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, str(folder))
    sql = con.sql(f"select {', '.join(f'"{c}"' for c in found.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == sorted(map(repr, sql))
    return got


PAGE = "<html><head><title>t</title></head><body><article><h1>{}</h1><p>one &amp; two</p></article><footer>&copy; x</footer></body></html>"


def test_references_without_semicolon_stay(spark, tmp_path):
    heads = ["and&amp;&amp", "a &am", "b &", "c &a &lt;d&gt;", "&copy x &quot", "&amp;lt; &amp;amp;"]
    pages = ([(k, "http://a.example/x", PAGE.format(h)) for k, h in enumerate(heads)], "page_id long, url string, html string")
    for name in ("html_block_rows", "page_content"):
        assert agree(spark, tmp_path, name, pages=pages)


def test_pages_with_one_url_are_each_extracted(spark, tmp_path):
    html = [(f"http://a.example/{u}", h) for u in range(12) for h in (PAGE.format(1), PAGE.format(2), PAGE.format(2), PAGE.replace(">t<", "><"))] + [(None, PAGE), ("http://a.example/none", None)]
    assert len(agree(spark, tmp_path, "resumed_extraction", pages=([(k, *h) for k, h in enumerate(html)], "page_id long, url string, html string"))) == 50


def test_pages_are_found_out_in_every_form_of_bytes(spark, tmp_path):
    html = [f"<meta charset=utf-8>ŝé{k}" for k in range(12)] + ["", None]
    agree(spark, tmp_path, "page_encodings", pages=([(k, h) for k, h in enumerate(html)], "page_id long, html string"))
    assert {r["made_encoding"] for r in catalog.QUERIES["page_encodings"](spark, str(tmp_path)).collect()} == {"utf-8", "utf-8-sig", "utf-16", "iso-8859-1", "windows-1252", None}


def test_equal_labels_are_members_of_a_class(spark, tmp_path):
    words, rng = [f"w{k}" for k in range(40)], random.Random(3)
    lines = ["a b c"] * 150 + ["c b a"] * 50 + [" ".join(rng.sample(words[: rng.choice((6, 12, 40))], rng.randint(1, 6))) for _ in range(200)] + [None, ""]
    docs = ([(k, None if t is None else f"{t}\nx", rng.choice(["de", "fr", None]) if k >= 200 else "de") for k, t in enumerate(lines)], "doc_id long, text string, lang string")
    assert len(agree(spark, tmp_path, "similar_label_pairs", documents=docs)) < 1000
    assert agree(spark, tmp_path, "similar_label_classes", documents=docs)


def test_spans_are_held_as_numbers(spark):
    import resource

    from granary.functions import spans

    df = spark.createDataFrame([(None,), ("",), ("one two 2020-01-02 three",)], "text string").coalesce(1)
    assert [[tuple(x) for x in r[0]] for r in df.select(spans.mentions(F.col("text"), "[0-9-]+")).collect()] == [[], [], [(8, 18)]]
    held = pa.array(["a " * 50_000] * 40)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = spans._each(lambda t: ((k, k + 1) for k in range(0, len(t), 2))).func(held)
    assert len(out.flatten()) == 2_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000  # KB; as dictionaries over 500,000


def test_pairs_are_scored_once(spark, monkeypatch):
    from granary.operators import hybrid

    calls, scored = [], hybrid.scored
    monkeypatch.setattr(hybrid, "scored", lambda *a: calls.append(1) or scored(*a))
    catalog.QUERIES["hybrid_retrieval_whole"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
