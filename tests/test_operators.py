"""Operators, sources and the stream on small rows with known results."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.vectors import cosine
from granary.operators import asof, checks, dedup, eligibility, graph, packing, retrieval
from granary.sources import pages, releases
from granary.streaming import snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("owner", "asked", "covers"),
    [
        (("CH", None, None), ("CH", "ZH", "1"), True),
        (("CH", "ZH", None), ("CH", "ZH", None), True),
        (("CH", "ZH", None), ("CH", None, None), False),
        (("CH", "ZH", "1"), ("CH", "ZH", "2"), False),
        (("CH", "ZH", None), ("LI", "ZH", None), False),
    ],
)
def test_places_cover_downwards_only(spark, owner, asked, covers):
    lit = lambda t: tuple(F.lit(x).cast("string") for x in t)
    assert one(spark, F.coalesce(eligibility.contains_place(lit(owner), lit(asked)), F.lit(False))) is covers


@pytest.mark.parametrize(
    ("operator", "value", "expected", "holds"),
    [("equals", "a", ["a"], True), ("not_equals", None, ["a"], False), ("not_in", "b", ["a"], True), ("absent", None, [], True), ("present", None, [], False), ("other", "a", ["a"], False)],
)
def test_missing_values_fail_negations(spark, operator, value, expected, holds):
    assert one(spark, eligibility.holds(F.lit(operator), F.lit(value).cast("string"), F.array(*map(F.lit, expected)).cast("array<string>"))) is holds


def test_scalar_functions(spark):
    assert one(spark, T.tokens(F.lit("Über über_1, x-x"))) == ["über", "über_1", "x"]
    assert one(spark, T.strict_date(F.lit("2026-02-28"))) == datetime.date(2026, 2, 28)
    assert one(spark, T.strict_date(F.lit("2026-02-30"))) is None and one(spark, T.strict_date(F.lit("2026-1-2"))) is None
    assert one(spark, T.normalised_url(F.lit("HTTPS://Example.ORG:443/A/b/?q=1#x"))) == "https://example.org/A/b/?q=1"
    assert one(spark, T.host(F.lit("http://www.Example.org:8080/x"))) == "example.org"
    assert one(spark, cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))) == pytest.approx(1)
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_greedy_selection_skips_what_does_not_fit(spark):
    items = [(1, [1, 2]), (2, [3, 4]), (3, [2, 5]), (4, [1])]
    df = spark.createDataFrame([(items,)], "items array<struct<id:bigint,refs:array<bigint>>>")
    assert df.select(retrieval.greedy(F.col("items"), 3).alias("x")).first()["x"] == [1, 3, 4]


def test_batches_and_offsets(spark):
    weights = spark.createDataFrame([("a", i, x) for i, x in enumerate((3, 4, 9, 1, 5))], "g string, i int, w int")
    assert [r["batch"] for r in packing.batches(weights, ["g"], ["i"], {"w": 8}).orderBy("i").collect()] == [0, 0, 1, 2, 2]
    df = spark.createDataFrame([("a", 1, "xy"), ("a", 2, "z")], "g string, n int, t string")
    assert [(r["start"], r["end"]) for r in packing.offsets(df, ["g"], ["n"], F.length("t"), 2).orderBy("n").collect()] == [(0, 2), (4, 5)]


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "start long")
    assert sorted(tuple(r) for r in graph.reach(edges, seeds).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert {r["node"] for r in graph.on_cycles(edges).collect()} == {1, 2, 3}


def test_as_of_takes_the_last_earlier_row(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k long, at long, v string")
    assert sorted(map(tuple, asof.as_of(left, right, "k", "t", "at", ["v"]).fillna("-").collect())) == [(1, 1, "-"), (1, 5, "b"), (2, 9, "-")]
    assert asof.latest(right, ["k"], F.col("at"), F.lit(5)).first()["v"] == "b"


def test_similar_labels_against_all_pairs(spark):
    labels = [(i, "en", " ".join(w for j, w in enumerate("a b c d e f".split()) if (i * 7 + j * 3) % 5 > 1)) for i in range(25)]
    got = {(r["a"], r["b"]) for r in dedup.similar_labels(spark.createDataFrame(labels, "item long, lang string, label string")).collect()}
    sets = {i: set(t.split()) for i, _, t in labels}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_checks_list_every_violation(spark):
    a = spark.createDataFrame([(1, 2), (1, None), (3, 4)], "id long, ref long")
    found = checks.violations(checks.missing("ref", a, "ref", a, "id"), checks.repeated("id", a, "id"), checks.broken("small", a, "id", "ref < 3"))
    assert sorted(map(tuple, found.collect())) == [("id", "1"), ("ref", "2"), ("ref", "4"), ("small", "1"), ("small", "3")]


def test_checks_of_sets_and_pairs(spark):
    have = spark.createDataFrame([(1, "de"), (1, "fr"), (1, "fr"), (2, "de"), (2, "xx"), (3, None)], "id long, lang string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "id long")
    assert sorted(r["key"] for r in checks.incomplete("lang", keys, "id", have, "lang", ["de", "fr"]).collect()) == ["2", "3", "4"]
    members = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 3), ("z", None)], "grp string, member long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (None, None)], "a long, b long")
    assert [r["key"] for r in checks.together("conflict", pairs, members).collect()] == ["x"]
    assert checks.together("conflict", pairs.limit(0), members).isEmpty() and checks.incomplete("lang", keys.limit(0), "id", have, "lang", ["de"]).isEmpty()


def page_blocks(spark, html, url=None):
    df = spark.createDataFrame([(1, url, html), (2, url, None), (3, url, "")], "page_id long, url string, html string")
    return pages.html_blocks(df).where("page_id = 1").orderBy("at").collect()


def test_html_blocks_have_exact_offsets(spark):
    html = "<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><ul><li>Home</ul></nav><h1>A &amp; B</h1><p>one <b>two</b><p>three<table><tr><td>x<td>y</table></body>"
    got = page_blocks(spark, html)
    assert [(r["kind"], r["text"], r["region"], r["navigation"]) for r in got] == [("list_item", "Home", "nav", True), ("heading", "A & B", "body", False), ("paragraph", "one two", "body", False), ("paragraph", "three", "body", False), ("table", "x\ty", "body", False)]
    joined = "\n\n".join(r["text"] for r in got)
    assert all(joined[r["start"] : r["end"]] == r["text"] for r in got) and got[2]["heading_path"] == "A & B"


def test_regions_of_html_blocks(spark):
    html = (
        '<body><header id="header"><div>menu</div></header><div class="x breadcrumb"><div>home</div><span>now</span></div><div>intro</div>'
        '<article><header id="header"><h1>title</h1></header><aside>note</aside><p>prose <a href="#" class="icon--power">top</a><p><a href="#" class="icon--power">up</a></p></article>'
        '<div role="navigation"><nav><p>a</nav>b</div><p><a href="#">c</a></p><header>plain</header><footer><p>foot</p></footer></nav><div class="mdl-related-content"><p>see also</div>end</body>'
    )
    want = [("menu", "header", True), ("home", "body", True), ("now", "body", True), ("intro", "body", False), ("title", "header", False), ("note", "aside", False), ("prose top", "body", False), ("up", "body", True)]
    want += [("a", "nav", True), ("b", "body", True), ("c", "body", False), ("plain", "header", False), ("foot", "footer", False), ("see also", "body", True), ("end", "body", False)]
    assert [(r["text"], r["region"], r["navigation"]) for r in page_blocks(spark, html)] == want


def test_tables_keep_their_grid(spark):
    html = "<table><caption>Fees</caption><thead><tr><th rowspan=2>Kind</th><th colspan='2'>Price</th></tr><tr><th>new<th>old</thead><tr><td>A <b>x</b><td>1<td>2 <table><tr><td>in</table></tr><tr><td rowspan=oops>B</td></tr></table>"
    (row,) = page_blocks(spark, html)
    cells = [(c["row"], c["column"], c["rowspan"], c["colspan"], c["header"], c["text"]) for c in row["cells"]]
    assert cells == [(0, 0, 2, 1, True, "Kind"), (0, 1, 1, 2, True, "Price"), (1, 1, 1, 1, True, "new"), (1, 2, 1, 1, True, "old"), (2, 0, 1, 1, False, "A x"), (2, 1, 1, 1, False, "1"), (2, 2, 1, 1, False, "2 in"), (3, 0, 1, 1, False, "B")]
    assert row["text"] == "Fees\nKind\tPrice\nnew\told\nA x\t1\t2 in\nB" and row["kind"] == "table"


def test_blocks_know_lists_links_and_scopes(spark):
    html = (
        "<base href='/root/'><body id=top><h1>A</h1><ol><li>one<li><a href='x?y#z'>two</a><ul><li id=deep>three</ul></ol><section><h2>B</h2><p>in B<aside><h3>C</h3><p>beside</aside><p>still B</section>"
        "<p>after<div hidden>gone</div><div style='display: none'>off</div><p id=fn-1>note<p>mail <a href='mailto:a@b.org'>us</a><pre> two\n  lines</pre><a href='http://[bad'>odd</a></body>"
    )
    got = {r["text"]: r for r in page_blocks(spark, html, "https://h.example/dir/page")}
    assert [(x["ordered"], x["position"]) for x in got["three"]["lists"]] == [(True, 2), (False, 1)] and got["three"]["anchor"] == "deep" and got["one"]["anchor"] == "top"
    assert tuple(got["two"]["links"][0]) == ("two", "x?y#z", "https://h.example/root/x?y#z") and got["odd"]["links"][0]["url"] == "http://[bad"
    assert [got[t]["heading_path"] for t in ("one", "in B", "beside", "still B", "after")] == ["A", "A > B", "A > B > C", "A > B", "A"]
    assert got["in B"]["scope"] == got["beside"]["scope"] == got["still B"]["scope"] != got["one"]["scope"] == got["after"]["scope"]
    assert got["gone"]["hidden"] and got["off"]["hidden"] and not got["after"]["hidden"] and got["note"]["footnote"] and got[" two\n  lines"]["kind"] == "preformatted"
    assert got["three"]["dom_path"] == "/body[1]/ol[1]/li[2]/ul[1]/li[1]"


def test_substantive_blocks(spark):
    with_main = "<nav>menu</nav><main><h1>T</h1><ul><li><a href=/x>Only a Link</a><li><a href=/x>link</a> and more<li>plain</ul><button>press</button><p>said</main><p>outside<address>Street 1</address><footer>imprint <p>call <a href='tel:+41'>us</a></footer>"
    without = "<header>top</header><p>said</p><div role=contentinfo>legal</div><aside>note</aside>"
    df = spark.createDataFrame([(1, with_main), (2, without)], "page_id long, html string")
    kept = {p: [r["text"] for r in pages.substantive(pages.html_blocks(df)).where(f"page_id = {p}").orderBy("at").collect()] for p in (1, 2)}
    assert kept == {1: ["T", "link and more", "plain", "said", "Street 1", "call us"], 2: ["said", "note"]}


def test_blocks_keep_all_text_of_any_page(spark):
    import random

    rng, tags = random.Random(3), ["p", "div", "ul", "li", "b", "a", "section", "nav", "h2", "span", "td", "tr", "aside", "article", "br"]
    for _ in range(150):
        html = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f" w{rng.randrange(99)} ", f"w{rng.randrange(99)}"]) for _ in range(60))
        said = "".join("".join(b["text"] for b in pages.blocks(html, "")).split())
        assert said == "".join(re.sub("<[^>]*>", "", html).split()), html
    deep = "<div>" * 30_000 + "<p>x" + "</div>" * 30_000
    assert [b["text"] for b in pages.blocks(deep[:60_000] + "<p>x", "")] == ["x"]


def test_sections_stand_under_their_heading(spark):
    text = "# A\none\n## B\ntwo"
    got = pages.text_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [r["heading"] for r in got] == ["# A", "# A", "## B", "## B"] and all(text[r["start"] : r["end"]] == r["text"] for r in got)


def test_heading_paths_drop_deeper_levels(spark):
    text = "intro\n# A\nx\n### deep\n## B\ny\n# C\nz"
    lines = pages.text_sections(spark.createDataFrame([(1, text), (2, "no heading"), (3, None)], "doc_id long, text string"))
    level = F.when(F.col("text").rlike("^#+ "), F.length(F.regexp_extract("text", "^#+", 0)))
    got = [(r["doc_id"], r["heading_path"]) for r in pages.heading_paths(lines, "doc_id", "line", level).orderBy("doc_id", "line").collect()]
    assert got == [(1, p) for p in ("", "# A", "# A", "# A > ### deep", "# A > ## B", "# A > ## B", "# C", "# C")] + [(2, "")]


def test_imports_are_idempotent_and_refuse_changes(spark, tmp_path):
    path = f"{tmp_path}/assets"
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    assert releases.import_rows(spark, rows, path, "id", "sha").isEmpty() and releases.import_rows(spark, rows, path, "id", "sha").isEmpty()
    assert spark.read.parquet(path).count() == 2 and releases.verify_import(spark, rows, path, "id", "sha").isEmpty()
    assert releases.import_rows(spark, spark.createDataFrame([("a", "9"), ("c", "3")], rows.schema), path, "id", "sha").count() == 1
    assert spark.read.parquet(path).count() == 2


def test_releases_are_written_once(spark, tmp_path):
    from pyspark.errors import AnalysisException

    releases.publish(spark, {"facts": spark.range(3)}, str(tmp_path), "r1")
    with pytest.raises(AnalysisException):
        releases.publish(spark, {"facts": spark.range(4)}, str(tmp_path), "r1")
    assert releases.release_table(spark, str(tmp_path), "facts", "r1").count() == 3
    releases.activate(spark, str(tmp_path), "r1")
    assert releases.active_release(spark, str(tmp_path)) == "r1"


def test_files_have_sizes_and_hashes(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("abc")
    (tmp_path / "b.txt").write_text("abcdef")
    got = {r["path"].rpartition("/")[2]: r for r in releases.read_files(spark, str(tmp_path), "*.txt", max_bytes=4).collect()}
    assert got["a.txt"]["content"] == b"abc" and got["b.txt"]["content"] is None and got["b.txt"]["bytes"] == 6


def test_manifests_are_held_against_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
    files = releases.read_files(spark, str(tmp_path), "*.txt")
    listed = files.where("path not like '%/a.txt'").withColumn("sha256", F.when(F.col("path").like("%/b.txt"), "0").otherwise(F.col("sha256")))
    got = {(r["path"][-5:], r["status"]) for r in releases.manifest_difference(files, listed).collect()}
    assert got == {("a.txt", "only_left"), ("b.txt", "changed")}


def test_stream_keeps_each_content_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, html in enumerate(["a", "b", "a"]):
        (folder / f"{i}.json").write_text(json.dumps({"page_id": i, "url": "u", "html": html, "fetched": "2026-01-01T00:00:00Z"}))
        snapshots.write_new(snapshots.snapshots(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r["html"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "b"} and spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_office_files_give_their_paragraphs(spark, tmp_path):
    import zipfile

    from granary.sources import office

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_text("no archive")
    got = office.office_texts(releases.read_files(spark, str(tmp_path), "*.docx")).orderBy("at").collect()
    assert [r["text"] for r in got] == ["One two", "Three"]


def test_exact_unicode_functions(spark):
    from granary.functions import unicode as U

    df = spark.createDataFrame([("ﬁn Ｆull Straße",), (None,)], "t string").select(U.exact_tokens(F.col("t")).alias("x"), U.without_accents(F.lit("Café ÉTÉ")).alias("y"), U.terminology_key(F.lit("  Abé  C ")).alias("z"), U.term(F.lit("Maß")).alias("w"))
    rows = df.collect()
    assert rows[0]["x"] == ["fin", "full", "strasse"] and rows[1]["x"] is None
    assert (rows[0]["y"], rows[0]["z"], rows[0]["w"]) == ("cafe ete", "abé c", "mass")


def test_each_target_has_one_reader(spark):
    from granary.sources.readers import Readers, output_violations

    readers = Readers()
    give = lambda text: lambda targets: targets.withColumn("text", F.lit(text))
    readers.add("law", r"^https://law\.", give("law"))
    readers.add("all", r"\.org/", give(""))
    with pytest.raises(ValueError):
        readers.add("law", "x", give("y"))
    targets = spark.createDataFrame([("https://law.net/1",), ("https://law.org/2",), ("https://a.org/3",), ("ftp://b/4",), (None,)], "url string")
    got = {r["url"]: (r["reader"], r["error"]) for r in readers.assigned(targets).collect()}
    assert got == {"https://law.net/1": ("law", None), "https://law.org/2": (None, "several readers"), "https://a.org/3": ("all", None), "ftp://b/4": (None, "no reader"), None: (None, "no reader")}
    pages = readers.read(targets)
    assert sorted(map(tuple, pages.collect())) == [("https://a.org/3", "", "all"), ("https://law.net/1", "law", "law")]
    assert sorted(map(tuple, output_violations(pages.union(pages.where("reader = 'law'")), ["a.org"]).collect())) == [("empty", "https://a.org/3"), ("host", "https://law.net/1"), ("host", "https://law.net/1"), ("url", "https://law.net/1")]


def test_rich_text(spark):
    from granary.sources.rich_text import rtf_text

    source = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\b Caf\'e9\b0  \{one\}\par \u8364?two\tab 3}"
    df = spark.createDataFrame([(bytearray(source),), (bytearray(b"plain"),), (None,)], "c binary").select(rtf_text(F.col("c")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["Café {one}\n€two\t3", None, None]


def test_parts_are_assembled_as_their_manifest_says(spark, tmp_path):
    import hashlib

    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name}) + "\n")
    listed = [(f"file:{tmp_path}/{n}.jsonl", hashlib.sha256((tmp_path / f"{n}.jsonl").read_bytes()).hexdigest()) for n in ("a", "b")]
    manifest = spark.createDataFrame(listed, "path string, sha256 string")
    assert sorted(r["id"] for r in releases.assemble(spark, str(tmp_path), manifest, "id string").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        releases.assemble(spark, str(tmp_path), manifest.limit(1), "id string")


def test_equal_labels_are_paired_whatever_their_tokens(spark):
    labels = [(1, "de", "Contact"), (2, "de", " contact\u00a0"), (3, "fr", "Contact"), (4, "de", "?!"), (5, "de", "?!"), (6, None, "Fees"), (7, None, "fees"), (8, "de", None), (9, "de", "Amt der Stadt"), (9, "de", "Contact")]
    df = spark.createDataFrame(labels, "item long, lang string, label string")
    got = sorted((r["lang"] or "", r["label"], r["first"], r["item"]) for r in dedup.shared_labels(df).collect())
    assert got == [("", "fees", 6, 6), ("", "fees", 6, 7), ("de", "?!", 4, 4), ("de", "?!", 4, 5), ("de", "contact", 1, 1), ("de", "contact", 1, 2), ("de", "contact", 1, 9)]


def test_label_classes_give_the_pairs_of_the_reference(spark):
    words = "der amt bau die of stadt ort".split()
    labels = [(i, ["de", "fr", None][i % 3], " ".join(w for j, w in enumerate(words) if (i * 7 + j * 3) % 5 > 1 or (i >> j) & 1)) for i in range(60)]
    df = spark.createDataFrame(labels, "item long, lang string, label string")
    same, near = dedup.shared_labels(df).collect(), {(r["a"], r["b"]) for r in dedup.similar_label_classes(df).collect()}
    first = {i: i for i, *_ in labels} | {r["item"]: r["first"] for r in same}
    got = {(a, b) for a in first for b in first if a < b and (first[a] == first[b] or (min(first[a], first[b]), max(first[a], first[b])) in near)}
    sets, want = {i: set(t.split()) - set(dedup.STOP_WORDS) for i, _, t in labels}, set()
    for a, lang, x in labels:
        for b, other, y in labels:
            n, m = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and lang == other and (x == y or (n >= 2 and n / m >= 0.6)):
                want.add((a, b))
    assert got == want and len(near) > 5 and len(same) > 5


def test_evaluation_counts_every_request_and_can_fail(spark):
    requests = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "request_id long")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 99, 20), (3, 20, 1), (3, 11, 6), (3, 98, 21), (5, 10, 1)], "request_id long, evidence_id long, rank int")
    gold = spark.createDataFrame([(r, e, g, f) for r in (1, 2, 3, 4) for e, g, f in ((10, "a", 1), (11, "b", 1))], "request_id long, evidence_id long, grp string, fact long")
    eligible = gold.select("request_id", "evidence_id").union(spark.createDataFrame([(3, 20), (5, 10)], "a long, b long"))
    got = {r[0]: tuple(r)[1:] for r in retrieval.evaluated(requests, ranked, gold, eligible, 0.5).collect()}
    assert got[1] == (1.0, 1.0, 1.0, 0, True, True)
    assert got[2] == (0.5, 1.0, 1.0, 1, True, False)  # one group of two, and one leaked at 20
    assert got[3] == (0.5, 0.0, 0.0, 0, False, False)  # relevant at 6, within 20 and not within five; 21 is not counted
    assert got[4] == got[5] == (0.0, 0.0, 0.0, 0, False, False)  # nothing found, and nothing to find
