"""The registered queries on the smallest tables against the plain versions of brute.py."""

import hashlib
import zlib

import pytest

from granary.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_op1_matches_every_window(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(queries.op1_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination([d[:2] for d in docs], items))
    assert any(r[-1] for r in got)


def test_op2_separates_held_out_rows(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    scored = {r["doc_id"]: r for r in queries.op2_quality(spark, "/root/testdata/sf0.01").collect()}
    tested = [d for d in labels if brute.held(d, 4, 2)]
    assert all(scored[d]["held_out"] for d in tested)
    assert sum((scored[d]["score"] >= 0.5) == labels[d] for d in tested) / len(tested) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in scored.values())


def test_op3_finds_the_same_components(spark, docs):
    got = rows(queries.op3_near_duplicates(spark, SF), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates([d[:2] for d in docs], 2))
    assert any(not r[-1] for r in got)


def test_op4_places_by_key(spark, docs):
    got = {r["doc_id"]: r for r in queries.op4_sharding(spark, SF).collect()}
    for d, text, *_ in docs:
        raw = (text or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"], got[d]["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert got[d]["grown_shard"] in (got[d]["shard"], 8)
    for shard in range(8):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert 0 < sum(r["grown_shard"] == 8 for r in got.values()) < len(got) / 4


def test_op5_removes_later_windows(spark, docs):
    got = {r["doc_id"]: r["text"] for r in queries.op5_line_dedup(spark, SF).collect()}
    assert got == {**{d[0]: d[1] for d in docs}, **brute.line_dedup([d[:2] for d in docs])}


def test_op6_fills_targets(spark, docs):
    got = queries.op6_mixing(spark, SF).collect()
    import re

    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    source = {d[0]: d[2] for d in docs}
    sizes: dict = {}
    for d, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[d]
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(float(want[source[r["doc_id"]]]))
        assert r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        longest = max(n for d, n in size.items() if source[d] == s)
        assert abs(taken[s] - float(want[s])) <= longest / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op6_mixing(spark, SF).collect()))


def test_op7_equals_a_full_scan(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows(queries.op7_nearest(spark, SF), "query_id", "rank", "vec_id", "score") == sorted(brute.nearest(vectors))


def test_op8_keeps_base_spans(spark, docs):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op8_personal_data(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        spans = brute.base_spans(text)
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        for kind in brute.PATTERNS:
            assert got[d][f"n_{kind}"] == sum(s[0] == kind for s in spans)
        assert set(listed) <= set(filter(None, got[d]["spans"].split(",")))


def test_op9_learns_languages(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_language(spark, sf).collect()}
    tested = [d for d in langs if brute.held(d, 5, 0)]
    assert all(got[d]["held_out"] for d in tested) and len(got) == len(langs)
    assert sum(got[d]["lang_pred"] == langs[d] for d in tested) / len(tested) > 0.95


def test_op10_counts_tokens(spark, docs):
    from granary.llm.tokencount import RANKS, encoder

    encode = encoder(open(RANKS, "rb").read()).encode_ordinary
    lengths = sorted(len(encode(d[1] or "")) for d in docs)
    for r in queries.op10_token_counts(spark, SF).collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_longer"] == sum(x > n for x in lengths)
        assert r["tokens_upto"] == sum(x for x in lengths if x <= n)
        assert r["tokens_cut"] == sum(min(x, n) for x in lengths)
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
