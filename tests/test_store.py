"""Releases through the data source: filters, changed and missing parts, pointers."""

import json
import os

import pytest

from granary.sources import store

ROWS = [(i, None if i % 7 == 0 else f"text {i}", float("nan") if i % 5 == 0 else i / 2) for i in range(100)]


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame(ROWS, "id long, text string, `a.b` double")
    store.write_release(spark, {"docs": rows.repartition(3), "none": rows.limit(0)}, root, "r1", rows_a_part=20)
    store.activate(root, "r1")
    return root


def part(root, k=0):
    folder = f"{root}/r1/docs"
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet"))[k]


def test_rows_filters_and_columns(spark, root):
    got = store.read_release(spark, root, "docs")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, ROWS))
    assert {r["id"] for r in got.where("id >= 10 and id < 20").collect()} == set(range(10, 20))
    assert {r["id"] for r in got.where("text in ('text 3', 'text 5')").collect()} == {3, 5}
    assert got.where("text is null").count() == 15
    assert got.where("`a.b` = double('nan')").count() == 20 and got.where("`a.b` > 40").count() == 20 + sum(1 for i in range(81, 100) if i % 5)
    assert store.read_release(spark, root, "docs", columns=["a.b", "id"]).columns == ["a.b", "id"]
    assert store.read_release(spark, root, "none").count() == 0
    assert {r["table"]: r["rows"] for r in store.inventory(spark, root, "r1").collect()}["docs"] == 100


def test_changed_parts_stop_the_read(spark, root):
    path = part(root)
    with open(path, "rb") as f:
        whole = f.read()
    with open(path, "wb") as f:
        f.write(whole[:60] + bytes([whole[60] ^ 1]) + whole[61:])
    with pytest.raises(Exception, match="does not have its hash"):
        store.read_release(spark, root, "docs").count()
    with open(path, "wb") as f:
        f.write(whole + b"x")
    with pytest.raises(Exception, match="differ from their list"):
        store.read_release(spark, root, "docs").count()
    os.rename(path, path + ".kept")
    with pytest.raises(Exception, match="differ from their list"):
        store.read_release(spark, root, "docs").count()
    with open(path + ".kept", "wb") as f:
        f.write(whole)
    os.symlink(path + ".kept", path)
    with pytest.raises(Exception, match="differ from their list"):
        store.read_release(spark, root, "docs").count()


def test_releases_and_pointers(spark, root):
    other = spark.createDataFrame([(1, "b")], "id long, text string")
    with pytest.raises(Exception, match="already exists"):
        store.write_release(spark, {"docs": other}, root, "r1")
    store.write_release(spark, {"docs": other}, root, "r2")
    assert store.active(root) == "r1"
    store.activate(root, "r2")
    assert store.active(root) == "r2" and store.read_release(spark, root, "docs").count() == 1
    assert store.read_release(spark, root, "docs", "r1").count() == 100
    with pytest.raises(ValueError, match="no list of parts"):
        store.activate(root, "r3")
    open(f"{root}/ACTIVE-00000009.abc.draft", "w").close()
    assert store.active(root) == "r2"
    lines = [json.loads(x) for x in open(f"{root}/r1/PARTS.jsonl")]
    assert all(len(x["sha256"]) == 64 for x in lines if "path" in x) and len([x for x in lines if x["table"] == "docs" and "path" in x]) >= 5
