"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, knn, langid, linedup, mixing, neardup, pii, quality, shards, tokencount
from granary.llm.textkit import column, numbered
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __n long, shard int, size long"
WORDS = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
ROWS = [
    (1, "The first line here\nsecond line of it\nthird line of it\nfourth", "en", "a", 10, 0.5, 1, 1, 1),
    (2, "The first line here\nsecond line of it\nthird line of it\nother end", "en", "b", None, None, None, None, None),
    (2, "The first line here\nsecond line of it\nthird line of it\nother end", "en", "b", None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "de", "a", 0, None, None, None, None),
    (5, " \t\n", "de", None, 3, None, None, None, None),
    (None, "text without an id", None, "a", 3, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    (6, WORDS, "fr", "b", len(WORDS), None, None, None, None),
    (7, "x" * 200_000, "fr", "c", 200_000, None, None, None, None),
    (8, "mail me at jane@example.org or +41 44 555 12 34, card 4111 1111 1111 1111 4111 1111 1111 1111 \U0001f600 10.0.0.1", "en", "c", 0, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use inside, and some that they used once.
INSIDE = """row digest one tie range sum_0 key_0 key_1 place content before copies source_size target taken n_tokens n_docs found hits listed h at words ids of starts covered spans
base tight score_ kept row value payload found_0 p o n of_id of_version version node fp sig slot_ __hash __one __bucket __source __before __id __gone __score __found __row __spans __k_doc_id label lot places""".split()


@pytest.fixture(scope="module")
def clashing(docs):
    """docs with a column of each inner name, and of names that need quotes, whose values tell their row."""
    mark = F.monotonically_increasing_id().cast("string")
    return docs.select("*", *[F.concat(F.lit(f"{name}:"), mark).alias(name) for name in [*dict.fromkeys(INSIDE), "a.b", "with space", "tick`ed", "text.x", "ünï"]])


def untouched(got, want, *changed):
    """The rows of got, without columns that an operator sets, as a sorted list of texts; they must be rows of want."""
    columns = [c for c in want.columns if c not in changed]
    exactly = [column(c) for c in columns]
    return sorted(map(repr, got.select(*exactly).collect())), sorted(map(repr, want.select(*exactly).collect()))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(spark, docs, nothing):
    bench = [(1, "second line of it third line of it other"), (2, None), (3, ""), (1, "text without an id"), (None, "w3x3 w4x4")]
    b = items(spark, bench)
    got = [tuple(r) for r in decontaminate.contamination(docs, b).collect()]
    want = brute.contamination([r[:2] for r in ROWS], [x for x in bench if x[0] is not None])
    assert {(r[0], r[1], r[3], r[4]) for r in got} == {(r[0], r[1], r[3], r[4]) for r in want} and len(got) == len(ROWS)
    joined = decontaminate.scan(docs, b, max_windows=0).collect()
    assert sorted(map(repr, joined)) == sorted(map(repr, decontaminate.scan(docs, b).collect()))
    kept = decontaminate.drop_contaminated(docs, items(spark, bench[:4]))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items(spark, bench[:1])).collect()}
    assert cut[2] == "The first line here\n end" and cut[1] == ROWS[0][1]
    assert decontaminate.contamination(nothing, b).count() == 0
    assert decontaminate.contamination(docs, items(spark, [])).where("contaminated").count() == 0


def test_quality(spark, docs, nothing):
    none = quality.assess(docs, labels(spark, [])).collect()
    assert len(none) == len(ROWS) and all(0 <= r["score"] <= 1 for r in none)
    some = labels(spark, [(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0), (6, 1, 1), (99, 1, 0)])
    kept = quality.drop_rejected(docs, some)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    assert quality.assess(nothing, some).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, nothing, width):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, width=width).collect() if r["doc_id"] is not None}
    want = brute.near_duplicates([r[:2] for r in ROWS if r[0] is not None], width)
    assert sorted((d, r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()) == sorted(want)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_copies_of_one_text_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 1500)
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for d in range(120):
        w = list(base)
        for i in rng.integers(0, 120, rng.integers(0, 14)):
            w[i] = f"edit{rng.integers(1 << 30)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(df, width=2).collect())
    assert got == sorted(brute.near_duplicates(rows, 2))
    assert 1 < len({r[2] for r in got}) < 100


def test_sharding(spark, docs, nothing):
    out = shards.with_shards(docs, [1.0, 2.0, 0.0])
    assert set(out.columns) == set(docs.columns) | {"shard", "slot"} and out.count() == len(ROWS)
    assert out.where("shard = 2").count() == 0
    placed = [tuple(r) for r in shards.placement(docs).collect()]
    assert len(placed) == len(ROWS) and shards.placement(nothing).count() == 0
    with pytest.raises(ValueError):
        shards.shard_of(docs["doc_id"], [0.0])


def test_numbered_counts_each_group_without_gaps(spark):
    rows = [(None if i % 3 else "hot", i * 7919 % 101, i, "x") for i in range(700)] + [("one", 5, 700, "x")]
    df = spark.createDataFrame(rows, "at string, first long, n long, `a.b` string").repartition(7)
    out = numbered(df, ["at"], ["first", "n"], "ahead").collect()
    assert len(out) == len(rows)
    for group in {None, "hot", "one"}:
        expected = sorted(r[1:] for r in rows if r[0] == group)
        assert [tuple(r)[1:] for r in sorted((r for r in out if r["at"] == group), key=lambda r: r["ahead"])] == [(*e, i) for i, e in enumerate(expected)]
    assert numbered(df.limit(0), ["at"], ["first"], "ahead").count() == 0


def test_columns_of_any_name_keep_their_values(spark, clashing):
    bench = items(spark, [(1, "second line of it third line of it other")])
    some = labels(spark, [(1, 1, 0), (6, 1, 0), (8, 1, 0)])
    for got in (shards.with_shards(clashing, [1.0, 2.0]), linedup.deduplicated(clashing), pii.masked(clashing), decontaminate.remove_spans(clashing, bench)):
        a, b = untouched(got, clashing, "text", "shard", "slot")
        assert a == b
    for got in (quality.drop_rejected(clashing, some), decontaminate.drop_contaminated(clashing, bench), neardup.drop_near_duplicates(clashing), mixing.mixed(clashing)):
        assert got.columns == clashing.columns
        a, b = untouched(got, clashing)
        assert a and set(a) <= set(b)
    ranks = tokencount.read_ranks(spark)
    counted = tokencount.token_lengths(clashing, ranks)
    assert counted.columns == [*(c for c in clashing.columns if c != "n_tokens"), "n_tokens"]
    a, b = untouched(counted, clashing, "n_tokens")
    assert a == b
    joined = decontaminate.scan(clashing, bench, clashing.columns, max_windows=0, name="f2").drop("f2")
    a, b = untouched(joined, clashing)
    assert a == b


def test_a_third_of_all_rows_under_one_id(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("doc_id"), F.lit("same text of some words").alias("text"), F.lit("a").alias("source"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = shards.with_shards(rows, [1.0] * 3)
        slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
        assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots)
        dealt = rows.select("source", "doc_id", F.monotonically_increasing_id().alias("tie")).repartitionByRange("source", "doc_id", "tie")
        largest = dealt.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
        assert largest < 2000
        taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(rows.limit(0).union(rows)).collect()}
        assert sum(r["taken"] for r in mixing.mixture(rows).collect()) == 6000 * 5 and taken[7] == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    words = [f"word{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words), "a"), (2, near, "b"), (2, "a clean text that nothing else resembles at all", "c"), (2, "a clean text that nothing else resembles at all", "d"), (3, " ".join(words), "e"), (None, near, "f"), (4, "", "g"), (4, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = sorted(r["mark"] for r in neardup.drop_near_duplicates(df).collect())
    assert kept in (["a", "c", "f", "g", "h"], ["a", "d", "f", "g", "h"])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 1, False), (4, 4, True), (4, 4, True)]


def test_line_dedup_keeps_lines_that_stand_once(spark):
    """Rows of one doc_id with other texts are places of their own: only what an earlier place has goes."""
    lines = lambda words: "\n".join(words.split())
    rows = [(1, lines("a b c")), (5, lines("a b c own")), (5, lines("x y z own2")), (6, lines("x y z")), (5, None), (5, lines("x y z own2"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"] or "-", r["n_removed"]) for r in linedup.deduplicated(df).collect())
    assert got == sorted([(1, lines("a b c"), 0), (5, "own", 3), (5, lines("x y z own2"), 0), (5, lines("x y z own2"), 0), (5, "-", 0), (6, "-", 3)])


def test_ids_of_other_types(spark, docs):
    """Ids are texts or integers; every operator keeps their type."""
    for kind in ("string", "int"):
        to = lambda c: F.concat(F.lit("id-"), c.cast("string")) if kind == "string" else c.cast("int")  # noqa: E731, B023
        named = docs.withColumn("doc_id", to(F.col("doc_id")))
        said = labels(spark, [(1, 1, 0), (2, 0, 0), (6, 1, 0)]).withColumn("doc_id", to(F.col("doc_id")))
        bench = items(spark, [(1, "second line of it third line of it other")])
        outs = [quality.assess(named, said), quality.drop_rejected(named, said), neardup.near_duplicates(named), neardup.drop_near_duplicates(named), decontaminate.contamination(named, bench), linedup.deduplicated(named), mixing.mixture(named), pii.report(named), langid.languages(named), shards.placement(named)]
        for out in outs:
            assert dict(out.dtypes)["doc_id"] == kind and out.count() <= len(ROWS)
        same = {str(r["doc_id"]).removeprefix("id-"): r["kept"] for r in neardup.near_duplicates(named).where("doc_id is not null").collect()}
        assert same == {str(r["doc_id"]): r["kept"] for r in neardup.near_duplicates(docs).where("doc_id is not null").collect()}


def test_line_dedup_is_linear_in_lines(spark):
    import time

    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, "head\n" + text + "\ntail")], "doc_id long, text string")
        began = time.time()
        got = {r["doc_id"]: r for r in linedup.deduplicated(df).collect()}
        assert got[2]["text"] == "head\ntail" and got[2]["n_removed"] == n and got[1]["text"] == text
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 3 * seconds(80_000) + 5


def test_weights_decide_shares(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    counts = {r["shard"]: r["count"] for r in shards.with_shards(keys, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert counts[1] / counts[0] == pytest.approx(3, rel=0.1)


def test_line_dedup(spark, docs, nothing):
    got = {(r["doc_id"], r["text"]) for r in linedup.deduplicated(docs).collect()}
    want = brute.line_dedup([r[:2] for r in ROWS if r[0] is not None])
    assert got == {(r[0], want.get(r[0], r[1])) for r in ROWS}
    assert linedup.deduplicated(docs).count() == len(ROWS) and linedup.deduplicated(nothing).count() == 0


def test_mixing(spark, docs, nothing):
    assert mixing.mixture(docs).count() == len(ROWS) and mixing.mixture(nothing).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.mixture(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).agg({"taken": "sum"}).first()[0] == 0


def test_targets_of_a_corpus_beyond_an_int(spark):
    sizes = {"a": 400_000_000, "b": 300_000_000, "c": 200_000_000, "d": 10_000_000_000}
    for some in (list("abc"), list("abcd")):
        sources = spark.createDataFrame([(s, sizes[s]) for s in some], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.water_fill(mixing.ranked_weights(sources)).collect()}
        assert got == pytest.approx({s: float(t) for s, t in brute.targets({s: sizes[s] for s in some}).items()})


def test_nearest(spark):
    nan = float("nan")
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.01 * rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(60)] + [(2000, None), (2100, [nan] * 8), (2200, [1.0, None] * 4), (None, rows[0][1]), (2300, [1.0, 2.0]), (2400, []), rows[5], (2500, [1e30] * 8), (2600, [-0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, v, max(min(s, 2**63 - 1), -(2**63))) for q, r, v, s in brute.nearest(rows)]
    for options in ({}, {"cells": 6, "chunk": 64}):
        got = sorted(tuple(x) for x in knn.knn_join(df, F.col("vec_id") % 100 == 0, **options).collect())
        # Scores beyond a long are clipped, so their order is by vec_id.
        assert [g for g in got if g[0] != 2500 and abs(g[3]) < 2**62] == sorted(w for w in want if w[0] != 2500 and abs(w[3]) < 2**62)
    assert knn.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_goes_through_cells_and_bounds(spark):
    rng = np.random.default_rng(2)
    centres = 5 * rng.normal(size=(8, 8))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.01 * rng.normal(size=8)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    base = df.mapInArrow(knn._quantised(knn.SCALE), "vec_id long, dim int, v binary")
    pivots = knn._pivots(base, 500, None)
    cells = base.mapInArrow(knn._assigned(pivots), knn._ROW)
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("resid").alias("r")).collect()
    assert len(summary) > 4
    radius, parts = {x["cell"]: x["r"] for x in summary}, {x["cell"]: 1 for x in summary}
    asked = cells.where("vec_id % 100 = 0").withColumn("floor", F.lit(None).cast("long"))
    best = {r["query_id"]: r["score"] for r in knn.nearest(df).where("rank = 10").collect()}
    floors = spark.createDataFrame(list(best.items()), "vec_id long, floor long")
    columns = ["vec_id", "dim", "v", "cell", "norm", "floor"]
    route = lambda q: q.select(columns).mapInArrow(knn._router(pivots, radius, parts), "chunk long, vec_id long, dim int, v binary, floor long").count()
    everywhere, pruned = route(asked), route(asked.drop("floor").join(floors, "vec_id"))
    assert everywhere == 5 * (len(summary) - 1) and pruned < everywhere / 2
    assert sorted(tuple(r) for r in knn.nearest(df).collect()) == sorted(brute.nearest(rows))


def test_personal_data(spark, docs, nothing):
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert len(pii.report(docs).collect()) == len(ROWS) and pii.report(nothing).count() == 0
    text = ROWS[-1][1]
    base = [f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text)]
    spans = got[8]["spans"].split(",")
    assert set(base) <= set(spans) and got[8]["n_email"] == 1 and got[8]["n_ip"] == 1 and got[8]["n_card"] == 0
    first = text.index("4111")
    assert f"card:{first}:{first + 19}" in spans and f"card:{first + 20}:{first + 39}" in spans
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert "jane" not in masked[8] and "[email]" in masked[8] and masked[1] == ROWS[0][1]
    odd = spark.createDataFrame([(None, "to a@b.org now"), (5, "x@y.com"), (5, "and then, later, z@w.net or 10.0.0.1"), (6, None)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in pii.masked(odd).collect()) == ["None", "[email]", "and then, later, [email] or [ip]", "to [email] now"]
    many = " ".join(f"u{i}@h{i}.org" for i in range(1000))
    row = pii.report(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert row["n_email"] == 1000 and row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(many))


def test_base_patterns_against_plain_ones(spark):
    rng = np.random.default_rng(9)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "+1 (23) ", "4111 1111 1111 1111", "-", " ", "_x", "5", "55", "é", "\u0001", "a.b", "+49-30-1234567", "\U0001f600", "x@y", ".de"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(1, 25)))) for i in range(400)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        assert [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in got[d]["spans"] if x["base"]] == brute.base_spans(text), text


def test_language(spark, docs, nothing):
    got = langid.languages(docs).collect()
    assert len(got) == len(ROWS) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (3, 4, 5))
    assert langid.languages(nothing).count() == 0
    assert langid.codewords(12).shape[0] == 12


def test_many_languages(spark):
    """Fifty invented languages, each of its own letters in part: distinct codewords, bounded training, right answers."""
    code = langid.codewords(50)
    assert len({tuple(w) for w in code.tolist()}) == 50
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) >= 10
    rng = np.random.default_rng(4)
    rows = []
    for k in range(50):
        letters = [chr(0x4E00 + 40 * k + j) if j < 8 else chr(97 + (3 * k + j) % 26) for j in range(14)]
        rows += [(60 * k + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(12)), f"l{k}") for i in range(60)]
    rows += [(99_999, rows[0][1], "l0")] * 500
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out and doc_id < 3000").collect()
    right = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in got) / len(got) > 0.95


def test_quality_bounds_what_repeated_ids_bring(spark, monkeypatch):
    seen = []
    whole = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, labels, **k: seen.append(len(rows)) or whole(rows, labels, **k))
    docs = spark.createDataFrame([(1, f"text number {i} of a repeated id") for i in range(300)] + [(3, "good words here")], "doc_id long, text string")
    quality.train(docs, labels(spark, [(1, 1, 0), (3, 0, 0)]), sample=50)
    assert seen == [50]


def test_token_counts(spark, docs, nothing):
    ranks = tokencount.read_ranks(spark)
    table = tokencount.limits(tokencount.histogram(tokencount.token_lengths(docs, ranks)))
    assert sum(r["n_docs"] for r in table.collect()) == len(ROWS)
    answers = {(r["kind"], r["at"]): r["value"] for r in tokencount.answers(table, [0, 5, 10**6], [0.5, 1.0]).collect()}
    assert answers["cut", 0.0] == 0 and answers["cut", 1e6] == table.first()["total_tokens"]
    assert tokencount.limits(tokencount.histogram(tokencount.token_lengths(nothing, ranks))).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(1, 1, 0), (6, 1, 0), (8, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, [(1, "second line of it third line of it other")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == set(docs.columns) | {"shard", "slot"} and out.where("doc_id = 2").isEmpty()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_scores_depend_on_the_text_alone():
    import pyarrow as pa

    from granary.llm.sparse import Features, weighted

    texts = ["A.", "", None, " \n", "the end", "A.", "B\n", "longer text of some words " * 50, "A."]
    rng = np.random.default_rng(3)
    for features in (quality.FEATURES, langid.FEATURES, Features(buckets=1 << 10, grams=(1, 2, 3, 4), words=True)):
        w = rng.normal(size=features.buckets).astype(np.float32)
        alone = {t: next(features.frequencies(pa.array([t], pa.string())))[1][0] for t in texts}
        for order in (texts, texts[::-1], texts * 20):
            got = np.concatenate([x for _, x in features.frequencies(pa.array(order, pa.string()))])
            assert all(np.array_equal(x, alone[t]) for t, x in zip(order, got, strict=True))
            assert np.array_equal(weighted(got, w), np.concatenate([weighted(alone[t][None], w) for t in order]))
        assert not any(alone[t].any() for t in ("", None, " \n"))
    # Own grams of "A.", with its two edges: 3 of two signs, 2 of three, 1 of four, and the word.
    assert quality.FEATURES.counts(["A."]).sum() == 7


def test_overlaps_are_searched_in_order(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        ends = np.sort(rng.choice(200, 2 * rng.integers(0, 14), replace=False)).tolist()
        asked = [(a, a + int(rng.integers(1, 20))) for a in rng.integers(0, 200, 30).tolist()]
        rows.append((i, list(zip(ends[::2], ends[1::2], strict=True)), asked))
    span = "array<struct<start:int,end:int>>"
    frame = spark.createDataFrame(rows, f"i int, spans {span}, asked {span}")
    got = {r["i"]: r["hit"] for r in frame.select("i", F.transform("asked", lambda x: pii._meets(x, F.col("spans"))).alias("hit")).collect()}
    for i, spans, asked in rows:
        assert got[i] == [any(s < b and a < e for s, e in spans) for a, b in asked]


def test_many_spans_in_one_text(spark):
    import time

    def asked(n):
        text = " ".join(f"call (212) 555-{i % 10000:04d} or write to u{i}@h{i}.org" for i in range(n))
        began = time.time()
        row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert row["n_email"] == n and row["n_added"] in (0, n)
        return time.time() - began

    asked(100)
    half, whole = asked(10_000), asked(20_000)
    assert whole < 3 * half + 2, (half, whole)
