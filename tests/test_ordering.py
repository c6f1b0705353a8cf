"""Places and order statistics, with one group of a third of all rows."""

from pyspark.sql import functions as F

from granary.operators import ordering, packing


def test_places_and_statistics_of_a_hot_group(spark):
    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"g{i % 50}", i * 7919 % 3001 / 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, `the value` double, id long").repartition(6)
    by: dict = {}
    for k, v, _ in rows:
        by.setdefault(k, []).append(v)
    got = {r["kind"]: r for r in ordering.order_statistics(df, "kind", "the value", {"mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}).collect()}
    assert got.keys() == by.keys()
    assert all((got[k]["n"], got[k]["mid"], got[k]["last"]) == (len(v), sorted(v)[len(v) // 2], max(v)) for k, v in by.items())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = df.repartitionByRange("kind", "the value", "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r["n"] for r in spread) < 1500
    bins = packing.bins(df, ["kind"], ["id"], 50).groupBy("kind", "bin").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    hot = sorted((r["bin"], r["n"], r["first"]) for r in bins if r["kind"] == "hot")
    assert hot == [(b, 50, 150 * b) for b in range(20)]
    assert ordering.order_statistics(df.limit(0), "kind", "the value", {"mid": lambda n: n - 1}).count() == 0


def test_visits_interleave_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5), ("b", 6)], "host string, id long")
    got = [(r["host"], r["id"], r["turn"]) for r in packing.round_robin(df, "host", ["id"]).orderBy("visit").collect()]
    assert got == [(None, 5, 1), ("a", 1, 1), ("b", 4, 1), ("a", 2, 2), ("b", 6, 2), ("a", 3, 3)]
