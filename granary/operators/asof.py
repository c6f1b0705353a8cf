"""As-of lookups: the latest earlier row of the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """left with the columns ``take`` of the last row of right of the same key whose time is not later (null if none).

    Both sides are put in one order and the last right row is carried forward: one shuffle by key and
    no pair of rows is ever made, however many of them share a key.
    """
    taken = [F.col(c).alias(f"__{c}") for c in take]
    one = left.select(F.lit(1).alias("__side"), F.col(left_time).alias("__t"), F.col(key), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__right"))
    two = right.select(F.lit(0).alias("__side"), F.col(right_time).alias("__t"), F.col(key), F.lit(None).alias("__row"), F.struct(*taken).alias("__right"))
    order = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("__last", F.last("__right", ignorenulls=True).over(order))
    return both.where("__side = 1").select("__row.*", *[F.col(f"__last.__{c}").alias(c) for c in take])


def latest(df: DataFrame, key: list[str], version: Column, cutoff: Column | None = None) -> DataFrame:
    """The row of each key with the largest version, not above cutoff if there is one."""
    rows = df if cutoff is None else df.where(version <= cutoff)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), version).alias("__x")).select(*key, "__x.*")
