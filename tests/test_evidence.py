"""Rules of urls, page kinds, encodings, spans, packing, trees, imports and damaged files on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import spans, unicode
from granary.functions import text as T
from granary.operators import packing, retrieval
from granary.sources import office, pages, releases, rich_text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_urls(spark):
    urls = ["HTTPS://A.example/x/../y/./z/?q=1#f", "http://a.example:443/", "https://a.example:443/b", "http://u@a.example/", "ftp://a.example/", "http://a.example", "http://a.example/a//b?", "http://a.example/../..", None]
    want = ["https://a.example/y/z/?q=1", None, "https://a.example/b", None, None, "http://a.example/", "http://a.example/a/b", "http://a.example/", None]
    assert values(spark, T.normalised_url(F.col("x")), urls) == want
    scope = T.in_scope(F.col("x"), ["a.example"], ["/en", "/de/x/"])
    assert values(spark, scope, ["http://a.example/en", "http://a.example/english", "http://a.example/%65n/b", "http://b.example/en", "http://a.example/de/x/y", "http://a.example/en/../fr"]) == [True, False, True, False, True, False]
    below = T.in_scope(F.col("x"), [".a.example"], ["/"])
    assert values(spark, below, ["http://b.a.example/x", "http://a.example/x", "http://ba.example/x", "http://c.b.a.example"]) == [True, False, False, True]
    assert values(spark, T.language_hint(F.col("x")), ["http://a/de/x", "http://a/x-fr.pdf", "http://a/it/doc_en.pdf", "http://a/den/x"]) == ["de", "fr", "en", None]


def test_page_kinds(spark):
    rows = [("Terror in the night", "", []), ("404 - Page not found", "", []), ("x", "", ["Access Denied"]), ("Wartungsarbeiten heute", "", []), ("x", "<app-root></app-root>", []), ("Fedlex", "", []), ("Error", "", [])]
    df = spark.createDataFrame(rows, "title string, html string, headings array<string>")
    got = [r[0] for r in df.select(pages.page_kind(F.col("html"), F.col("title"), F.col("headings"))).collect()]
    assert got == ["ordinary_page", "error_page", "error_page", "maintenance_page", "application_shell", "application_shell", "ordinary_page"]


def test_blocks_end_at_divisions(spark):
    df = spark.createDataFrame([(1, "<body><div>c</div><div>d</div><p>a<br>b</p><template>x</body>"), (2, None)], "page_id long, html string")
    assert [r["text"] for r in pages.html_blocks(df).orderBy("at").collect()] == ["c", "d", "a b"]


def test_spans(spark):
    text = "One two. Three\nfour five six? " + "x" * 30
    cut = lambda c: [text[r["start"] : r["end"]] for r in values(spark, c, [text])[0]]
    assert "".join(cut(spans.lossless(F.col("x"), 10))) == text and all(len(p) <= 10 for p in cut(spans.lossless(F.col("x"), 10)))
    assert cut(spans.sentences(F.col("x"), 20)) == ["One two.", "Three", "four five six?", "x" * 20, "x" * 10]
    assert values(spark, spans.occurrences(F.col("x"), "aa"), ["aaa", None])[0] == [(0, 2), (1, 3)]
    assert all(len(p) <= 12 for p in cut(spans.overlapping(F.col("x"), 12, 3)))


def test_batches_under_limits_and_breaks(spark):
    rows = [("a", 1, 5, "k"), ("a", 2, 6, "k"), ("a", 3, 1, "l"), ("a", 4, 30, "l"), ("a", 5, None, "l"), ("b", 1, 1, "k")]
    df = spark.createDataFrame(rows, "g string, o int, w int, k string")
    got = [r["batch"] for r in packing.batches(df, ["g"], ["o"], {"w": 11}, ["k"]).orderBy("g", "o").collect()]
    assert got[:4] == [0, 0, 1, 2] and got[5] == 0


def test_greedy_walk_of_references(spark):
    rows = [("q", i, i // 3, 100 - i) for i in range(200)]
    df = spark.createDataFrame(rows, "request_id string, evidence_id long, ref long, score long")
    got = sorted(r["evidence_id"] for r in retrieval.within_references(df, 8, 50).collect())
    assert got == list(range(24)) and retrieval.within_references(df, 100, 50).count() == 50


def test_vector_passes(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "evidence_id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "request_id long, v array<double>")
    one = sorted(map(tuple, retrieval.top_k(retrieval.vector_scores(asked, vectors, 5), 5).collect()))
    monkeypatch.setattr(retrieval, "MAX_NUMBERS", 2)
    assert one == sorted(map(tuple, retrieval.top_k(retrieval.vector_scores(asked, vectors, 5), 5).collect())) and len(one) == 10
    best = sorted(((-max(i % 7, i % 5), i) for i in range(60)))[:5]
    assert [r[1] for r in sorted(one, key=lambda r: (r[0], r[3])) if r[0] == 1] == [i for _, i in best]


def test_lexical_paths_agree(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "a b c"), (2, "c d")], "request_id long, text string")
    said = spark.createDataFrame([(i, "c " + "abd"[i % 3]) for i in range(30)], "evidence_id long, text string")
    one = sorted(map(tuple, retrieval.lexical_scores(asked, said).collect()))
    monkeypatch.setattr(retrieval, "MAX_TOKENS", 0)
    assert one == sorted(map(tuple, retrieval.lexical_scores(asked, said).collect())) and len(one) == 60


def test_imports_report_clashes_among_new_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "k string, c string")
    path = f"{tmp_path}/t"
    assert sorted(r["c"] for r in releases.import_rows(spark, rows, path, "k", "c").collect()) == ["1", "2"]
    assert releases.import_rows(spark, rows.where("k = 'b'"), path, "k", "c").count() == 0 and spark.read.parquet(path).count() == 1


def test_export_checks_the_hash(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "id string, content binary").withColumn("sha256", F.sha2(F.col("content"), 256))
    rows.withColumn("sha256", F.when(F.col("id") == "a", F.col("sha256")).otherwise("0")).write.parquet(f"{tmp_path}/e")
    assert releases.export_bytes(spark, f"{tmp_path}/e", "id", "a") == b"x"
    for missing, error in (("b", ValueError), ("c", KeyError)):
        with pytest.raises(error):
            releases.export_bytes(spark, f"{tmp_path}/e", "id", missing)


def test_rtf_surrogates_and_damaged_office_files():
    assert rich_text.plain(r"{\rtf1 a \u-10179?\u-8704? b \u-10179? c}") == "a \U0001f600 b � c"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>first</w:t></w:p><w:p><w:t>cut")
        z.writestr("word/footnotes.xml", "<a><p><t>note</t></p></a>")
    assert "note" in office.paragraphs(held.getvalue())
    assert office.paragraphs(b"no archive") == []


def test_declared_charsets_are_tried(spark):
    bad = b"caf\xe9 "
    rows = [
        (b"caf\xc3\xa9", "utf-8"), (b"\xef\xbb\xbfx", "utf-8-sig"), (b"\xff\xfex\x00", "utf-16"), (b"\xfe\xff\x00x", "utf-16"), (b"", "utf-8"), (bad + b"<meta charset='ISO-8859-1'>", "iso-8859-1"), (bad + b"<meta charset=foo>", None),
        (bad + b"charset=utf-8", None), (bad + b"charset=hex", None), (bad + b"charset=ascii", None), (b"<meta charset=shift_jis>\x83e", "shift_jis"), (b"<meta charset=shift_jis>\x83", None), (bad, "windows-1252"), (bad + b"\x81", None),
        (bad + b" " * 9000 + b"charset=foo", "windows-1252"), (None, None),
    ]
    df = spark.createDataFrame([(bytearray(r) if r is not None else None,) for r, _ in rows], "x binary").coalesce(1)
    assert [r[0] for r in df.select(unicode.encoding(F.col("x"))).collect()] == [want for _, want in rows]
