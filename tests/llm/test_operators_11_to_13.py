"""I-Match fingerprints, periodic runs and the filter audit against plain versions, and their edge cases."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import audit, imatch, periods, queries
from tests.llm import brute
from tests.llm.test_edges import ROWS, SCHEMA, docs, items, labels, nothing, untouched  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def check_fingerprints(got, rows):
    code = brute.imatch([t or "" for _, t in rows], imatch.LOW, imatch.HIGH, imatch.SEEDS, imatch.LEVELS)
    around = brute.edited(rows)
    want = []
    for d, t in rows:
        new, following = around[d, t or ""]
        a, b, c = code(t), code(new), code(following)
        want.append((d, len(t or ""), hashlib.sha256(new.encode()).hexdigest(), a, b, brute.likeness(a, b), brute.likeness(a, c)))
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got))) == sorted(map(repr, want))


def test_op11_equals_the_plain_version(spark, texts):
    got = queries.op11_imatch(spark, SF).collect()
    check_fingerprints(got, [t[:2] for t in texts])
    assert np.mean([r["near_edited"] for r in got]) > 5 * np.mean([r["near_next"] for r in got])


def test_fingerprints_of_odd_rows(spark, docs, nothing):  # noqa: F811
    check_fingerprints(imatch.report(docs).collect(), [r[:2] for r in ROWS])
    one = spark.createDataFrame([(5, "Ab cd \U0001f600 ef gh")], "doc_id long, text string")
    check_fingerprints(imatch.report(one).collect(), [(5, "Ab cd \U0001f600 ef gh")])
    signs = spark.createDataFrame([(1, "!!!"), (2, "???"), (3, "!!!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.report(signs).collect()}
    assert got[1]["fingerprint"] == got[3]["fingerprint"] != got[2]["fingerprint"] and got[1]["near_next"] < 0.2
    assert imatch.report(nothing).count() == 0 and imatch.fingerprinted(nothing).count() == 0


def test_fingerprints_keep_columns_of_any_name(spark, docs):  # noqa: F811
    odd = docs.select("*", *[F.monotonically_increasing_id().cast("string").alias(c) for c in ("a.b", "a b", "a`b", "row", "payload", "found_0", "h", "term", "p", "o", "t0", "fingerprint")])
    got = imatch.fingerprinted(odd)
    assert set(got.columns) == set(odd.columns)
    rows = lambda df: sorted(repr(tuple(v for k, v in r.asDict().items() if k != "fingerprint")) for r in df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in odd.columns]).collect())
    assert rows(got) == rows(odd)


def test_lexicon_larger_than_the_broadcast_bound(spark, docs, monkeypatch):  # noqa: F811
    want = sorted(map(repr, imatch.report(docs).collect()))
    monkeypatch.setattr(imatch, "MAX_LEXICON", 0)
    assert sorted(map(repr, imatch.report(docs).collect())) == want


def test_lexicon_is_a_band_of_all_texts(spark):
    rows = [(i, "common " + ("third " if i % 3 == 0 else "") + f"own{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["term"], r["df"]) for r in imatch.lexicon(df, 0.1, 0.5).collect()}
    assert got == {(brute.hash64("third"), 30)}


def test_op11_uses_no_python_on_rows(spark):
    plan = queries.op11_imatch(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op12_equals_the_plain_version(spark, texts):
    columns = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == {d: brute.period_digest(d, t) for d, t, _ in texts}
    assert sum(v[0] for v in got.values()) > 10


def test_periodic_runs_of_random_words():
    rng = np.random.default_rng(5)
    for _ in range(300):
        w = list(rng.integers(0, 2 if rng.random() < 0.5 else 6, rng.integers(0, 60)))
        for _ in range(rng.integers(0, 4)):
            p = int(rng.integers(1, 12))
            w += list(rng.integers(0, 3, p)) * int(rng.integers(2, 9)) + list(rng.integers(0, 3, rng.integers(0, 5)))
        assert periods.find_runs(np.array(w, dtype=np.uint64)) == brute.period_runs([int(x) for x in w])


def test_periodic_runs_of_odd_rows(spark, docs, nothing):  # noqa: F811
    got = periods.report(docs).collect()
    want = [(r[0], *brute.period_digest(r[0], r[1])) for r in ROWS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert periods.report(nothing).count() == 0 and periods.collapsed(nothing).count() == 0
    loud = spark.createDataFrame([(1, "so " + "go  now " * 30 + "end", "x"), (2, "a  b", "y"), (3, None, "z")], "doc_id long, text string, `a.b` string")
    cut = {r["doc_id"]: r for r in periods.collapsed(loud).collect()}
    assert cut[1]["text"] == "so go now end" and cut[2]["text"] == "a  b" and cut[3]["text"] is None and cut[1]["a.b"] == "x"
    found = {r["doc_id"]: r["runs"] for r in periods.runs(loud).collect()}
    assert [tuple(x) for x in found[1]] == [(1, 60, 2)] and found[2] == found[3] == []
    text_ids = spark.createDataFrame([("k", "go " * 40)], "doc_id string, text string")
    assert tuple(periods.report(text_ids).first()) == ("k", *brute.period_digest("k", "go " * 40))


def test_periodic_runs_take_time_in_proportion():
    def seconds(n):
        best = 9.0
        for _ in range(2):
            began = time.time()
            assert periods.find_runs(np.tile(np.arange(7, dtype=np.uint64), n // 7)) == [(0, n // 7 * 7, 7)]
            many = np.concatenate([np.repeat(np.uint64(k), 24) for k in range(n // 24)])
            assert len(periods.find_runs(many)) == n // 24
            best = min(best, time.time() - began)
        return best

    assert seconds(280_000) < 3.5 * seconds(140_000) + 0.5


def test_op13_equals_the_plain_version(spark, texts):
    said = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.op13_filter_audit(spark, SF)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.collect())) == brute.filter_audit(texts, said)


def test_filter_audit_of_odd_rows(spark, docs, nothing):  # noqa: F811
    said = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (99, 1, 0), (4, None, None)]
    got = audit.audit(docs, labels(spark, said))
    assert sorted(map(tuple, got.collect())) == brute.filter_audit([(r[0], r[1], r[2]) for r in ROWS], said)
    assert audit.audit(nothing, labels(spark, said)).count() == 0
    assert audit.audit(docs, labels(spark, [])).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_copies_are_every_row_but_those_of_the_smallest_id(spark, held):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 400)), f"text {rng.integers(0, 60)}" if rng.random() < 0.6 else "the hot text") for _ in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("a")).repartition(6)
    got = sorted((r["doc_id"], bool(r["mask"] & 16)) for r in audit.masks(df, held).collect())
    least: dict = {}
    for d, t in rows:
        least[t] = min(d, least.get(t, d))
    assert got == sorted((d, d > least[t]) for d, t in rows)
    assert audit.copies(df).count() == sum(d > least[t] for d, t in rows)


def test_equal_hashes_do_not_make_copies(monkeypatch):
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda *_: 7)
    sent = list(audit._before(1 << 20)(iter([(1, "a", "one"), (2, "a", "two"), (3, "b", "one")])))
    got = sorted(audit._after(iter(sorted(sent, key=lambda r: r[0]))))
    assert [(d, m & 16) for d, _, m in got] == [(1, 0), (2, 0), (3, 16)]


def test_a_hot_text_is_sent_once_by_each_task():
    sent = list(audit._before(1 << 20)(iter((i, "en", "same text") for i in range(999, -1, -1))))
    assert sum(text is not None for _, (text, _, _) in sent) == 1
    assert sorted(m & 16 for _, _, m in audit._after(iter(sorted(sent, key=lambda r: r[0])))) == [0] + [16] * 999
