"""Runs that reuse what is done: changed, failed, removed, unclear and repeated targets, and a run that died."""

import os

import pytest
from pyspark.sql import functions as F

from granary.operators import resumable


def extractor(seen):
    def extract(rows):
        seen.append({r["key"] for r in rows.select("key").collect()})
        bad = F.coalesce(F.col("content").contains("broken"), F.lit(False))
        return rows.select("key", F.when(~bad, F.length(F.coalesce("content", F.lit("")))).alias("result"), F.when(bad, "broken page").alias("error"))

    return extract


def table(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_second_run_works_on_what_changed(spark, tmp_path):
    root, seen = str(tmp_path / "state"), []
    run = lambda rows, version="1", **more: resumable.resume(table(spark, rows), "url", "html", extractor(seen), root, version, shards=8, **more)
    first = [("a", "one"), ("b", "broken"), ("c", "three"), ("c", "three"), ("d", None), (None, "lost"), ("e", "x"), ("e", "y")]
    assert run(first) == {"reused": 0, "extracted": 4, "unclear": 1, "removed": 0, "failed": 2, "without_key": 1}
    assert seen[-1] == {"a", "b", "c", "d"}
    got = {r["key"]: (r["result"], r["error"], r["run"]) for r in resumable.results(spark, root).collect()}
    assert got == {"a": (3, None, "run-00000001"), "b": (None, "broken page", "run-00000001"), "c": (5, None, "run-00000001"), "d": (0, None, "run-00000001"), "e": (None, resumable.TWO_CONTENTS, "run-00000001")}
    # The failed one comes again, the changed one too; the rest is not extracted and keeps its run.
    assert run([("a", "one"), ("b", "mended"), ("c", "changed"), ("d", None), ("e", "y")])["reused"] == 2
    assert seen[-1] == {"b", "c", "e"}
    got = {r["key"]: (r["result"], r["error"], r["run"]) for r in resumable.results(spark, root).collect()}
    assert got["a"][2] == got["d"][2] == "run-00000001" and got["c"] == (7, None, "run-00000002") and got["e"] == (1, None, "run-00000002")
    same = [("a", "one"), ("b", "mended"), ("c", "changed"), ("d", None), ("e", "y")]
    assert run(same) == {"reused": 5, "extracted": 0, "unclear": 0, "removed": 0, "failed": 0, "without_key": 0}
    assert len(seen) == 2 and not any(f.startswith("run-00000003") for f in os.listdir(root))
    # Another version of the extractor makes all of them new; a key that is gone leaves the state.
    assert run(same[:3], version="2") == {"reused": 0, "extracted": 3, "unclear": 0, "removed": 2, "failed": 0, "without_key": 0}
    assert {r["key"] for r in resumable.results(spark, root).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="8 shards, not 4"):
        resumable.resume(table(spark, same), "url", "html", extractor(seen), root, "2", shards=4)


def test_failed_targets_wait_unless_asked_for(spark, tmp_path):
    root, seen = str(tmp_path / "state"), []
    for retry in (True, False, True):
        out = resumable.resume(table(spark, [("b", "broken")]), "url", "html", extractor(seen), root, "1", retry_failed=retry)
        assert out["extracted"] == int(retry)


def test_a_run_that_dies_leaves_the_state(spark, tmp_path):
    root, seen = str(tmp_path / "state"), []
    resumable.resume(table(spark, [("a", "one")]), "url", "html", extractor(seen), root, "1")

    def dies(rows):
        return rows.select("key", F.raise_error(F.lit("killed")).cast("int").alias("result"), F.lit(None).cast("string").alias("error"))

    with pytest.raises(Exception, match="killed"):
        resumable.resume(table(spark, [("a", "two")]), "url", "html", dies, root, "1")
    assert [(r["key"], r["result"]) for r in resumable.results(spark, root).collect()] == [("a", 3)]
    os.makedirs(f"{root}/run-00000002/_temporary", exist_ok=True)
    resumable.resume(table(spark, [("a", "two!")]), "url", "html", extractor(seen), root, "1")
    assert [(r["key"], r["result"]) for r in resumable.results(spark, root).collect()] == [("a", 4)]
