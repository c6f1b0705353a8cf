"""Constraints as queries: each gives the rows that break a rule, so an empty union means a valid release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.tables import settle


def _rows(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def missing(rule: str, df: DataFrame, key: str, into: DataFrame, target: str) -> DataFrame:
    """References that name no row of the other table."""
    refs = df.select(F.col(key).alias("__ref")).where("__ref is not null").distinct()
    return _rows(refs.join(into.select(F.col(target).alias("__ref")), "__ref", "left_anti"), rule, "__ref")


def repeated(rule: str, df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row."""
    return _rows(df.groupBy(key).count().where("count > 1"), rule, key)


def broken(rule: str, df: DataFrame, key: str, condition: str) -> DataFrame:
    """Rows for which the condition is not true."""
    return _rows(df.where(f"not coalesce({condition}, false)"), rule, key)


def broken_rules(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """rule and key of each row and rule that does not hold for it, in one pass over the rows."""
    bad = F.array_compact(F.array(*[F.when(F.expr(f"not coalesce({c}, false)"), F.lit(k)) for k, c in rules.items()]))
    return df.select(F.explode(bad).alias("rule"), F.col(key).cast("string").alias("key"))


def overlapping(rule: str, df: DataFrame, group: str, member: str, most: int = 1) -> DataFrame:
    """Members that stand in more than ``most`` groups."""
    return _rows(df.select(group, member).distinct().groupBy(member).count().where(F.col("count") > most), rule, member)


def mixed(rule: str, df: DataFrame, group: list[str], value: str, most: int = 1) -> DataFrame:
    """Groups with more than ``most`` values of a column."""
    found = df.select(*group, value).where(F.col(value).isNotNull()).distinct().groupBy(*group).count().where(F.col("count") > most)
    return found.select(F.lit(rule).alias("rule"), F.concat_ws(":", *group).alias("key"))


def incomplete(rule: str, keys: DataFrame, key: str, df: DataFrame, value: str, needed: list[str]) -> DataFrame:
    """Keys for which df (key, value) lacks one of the needed values."""
    have = df.where(F.col(value).isin(needed)).groupBy(F.col(key).alias("__key")).agg(F.count_distinct(value).alias("__n"))
    found = keys.select(F.col(key).alias("__key")).distinct().join(have, "__key", "left")
    return _rows(found.where(F.coalesce("__n", F.lit(0)) < len(needed)), rule, "__key")


def together(rule: str, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Groups of members (grp, member) that hold both sides of one of pairs (a, b); all joins are by member or by group and member."""
    first = pairs.join(members.select("grp", F.col("member").alias("a")), "a")
    both = first.join(members.select("grp", F.col("member").alias("b")), ["grp", "b"])
    return _rows(both.select("grp").distinct(), rule, "grp")


def tree_errors(nodes: DataFrame) -> DataFrame:
    """tree and errors (joined by commas) of trees given as rows (tree, node, parent); the root's parent is null.

    What the roots reach is found a level at a time over all trees at once.
    """
    parents = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    n = nodes.join(parents, ["tree", "parent"], "left")
    counted = n.groupBy("tree").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), (F.count("*") - F.count_distinct("node")).alias("repeated"), F.count_if(F.col("parent").isNotNull() & F.col("there").isNull()).alias("dangling")
    )
    front = settle(nodes.where("parent is null").select("tree", "node").distinct())
    known = front
    while not front.isEmpty():
        step = nodes.join(front.withColumnRenamed("node", "parent"), ["tree", "parent"]).select("tree", "node").distinct()
        front = settle(step.join(known, ["tree", "node"], "left_anti"))
        known = known.union(front)
    out = counted.join(known.groupBy("tree").agg(F.count("*").alias("reached")), "tree", "left")
    found = [("duplicate ids", F.col("repeated") > 0), ("root", F.col("roots") != 1), ("dangling", F.col("dangling") > 0), ("unconnected", F.coalesce("reached", F.lit(0)) < F.col("nodes") - F.col("repeated"))]
    return out.select("tree", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found])), ",").alias("errors"))


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def inventory_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key and status (only_left, only_right, changed) where two inventories (key, value) differ."""
    joined = a.select(key, F.col(value).alias("va"), F.lit(True).alias("ina")).join(b.select(key, F.col(value).alias("vb"), F.lit(True).alias("inb")), key, "full")
    status = F.when(F.col("ina").isNull(), "only_right").when(F.col("inb").isNull(), "only_left").when(~F.col("va").eqNullSafe(F.col("vb")), "changed")
    return joined.select(key, status.alias("status")).where("status is not null")
