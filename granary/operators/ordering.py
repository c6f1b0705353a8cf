"""Exact places and order statistics of groups of any size, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.tables import fresh, settle


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the places 0, 1, ... of its rows in their group, in a new column.

    Rows move once: they are dealt into ranges of (group, order) and sorted inside them before they are written with
    their row numbers, so a place is a difference of two numbers and a group may fill any number of ranges. Only the
    ranges' counts are summed in order. Null is a group like any other. ``order`` should end with a column in which rows of one key
    differ, so that a key of any size spreads over ranges.
    """
    at, first, ahead, of = fresh([*df.columns, name], "at", "first", "ahead", "of")
    other = dict(zip(group, fresh([*df.columns, name, at, first, ahead, of], *[f"key_{i}" for i in range(len(group))]), strict=True))
    dealt = settle(df.repartitionByRange(*map(column, [*group, *order])).sortWithinPartitions(*map(column, [*group, *order])).withColumn(at, F.monotonically_increasing_id()))
    # The upper bits of a row number are its range, the lower ones count the rows of the range.
    part = F.shiftright(F.col(at), 33)
    totals = dealt.groupBy(*[column(g).alias(k) for g, k in other.items()], part.alias(of)).agg(F.count("*").alias(ahead), F.min(at).alias(first))
    before = Window.partitionBy(*other.values()).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: it is broadcast below Spark's own threshold only.
    starts = settle(totals.select(*other.values(), of, first, F.coalesce(F.sum(ahead).over(before), F.lit(0)).alias(ahead)))
    matched = dealt.join(starts, [*[column(g).eqNullSafe(F.col(k)) for g, k in other.items()], part == F.col(of)])
    return matched.select(*map(column, df.columns), (F.col(at) - F.col(first) + F.col(ahead)).alias(name))


def order_statistics(df: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, n (its values that are not null), and by name the value at the place that each function makes of n (from 0).

    The places of all values are known from the counts of ranges, so only the wanted rows meet in their group.
    """
    rows = df.select(column(group).alias("g"), column(value).alias("v")).where("v is not null")
    placed = numbered(rows, ["g"], ["v"], "place")
    counts = settle(rows.groupBy("g").agg(F.count("*").alias("n")))
    wanted = [f(F.col("n")).cast("long") for f in ranks.values()]
    met = placed.join(counts.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of"))).where(F.col("place").isin(*wanted))
    found = met.groupBy("g", "n").agg(*[F.max(F.when(F.col("place") == at, F.col("v"))).alias(name) for name, at in zip(ranks, wanted, strict=True)])
    return found.withColumnRenamed("g", group)
