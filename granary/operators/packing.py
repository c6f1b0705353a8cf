"""Ordered packing: bins, greedy batches under limits, round robin over groups, running offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.ordering import numbered


def bins(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """df with bin: consecutive rows of a group, ``size`` to a bin, from 0."""
    return numbered(df, group, order, "bin").withColumn("bin", F.floor(F.col("bin") / size).cast("long"))


def batches(df: DataFrame, group: list[str], order: list[str], limits: dict[str, float], breaks: list[str] = (), name: str = "batch") -> DataFrame:
    """df with ``name``: rows of a group in order, packed greedily; a batch ends before the row that would pass one of the limits.

    limits maps columns of weights to the most that a batch may hold; a single row above a limit is a batch of its own. A
    batch also ends where one of ``breaks`` changes. Null weights count nothing. Rows stream by in order and only
    running sums are held, so a group may be of any length.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, sums, batch = None, None, [], 0
        for frame in frames:
            keys = zip(*[frame.column(c).to_pylist() for c in group], strict=True)
            marks = zip(*[frame.column(c).to_pylist() for c in breaks], strict=True) if breaks else [()] * frame.num_rows
            weights = zip(*[frame.column(c).to_pylist() for c in limits], strict=True)
            out = []
            for key, mark, row in zip(keys, marks, weights, strict=True):
                row = [w or 0 for w in row]
                if key != at:
                    at, batch, sums = key, 0, row
                elif mark != last or any(s + w > most for s, w, most in zip(sums, row, limits.values(), strict=True)):
                    batch, sums = batch + 1, row
                else:
                    sums = [s + w for s, w in zip(sums, row, strict=True)]
                last = mark
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, pa.int64())], schema.names)

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(walk, schema)


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with turn, the place of a row in its group from 1, and visit: the first of each group before the second of any, groups in order, from 1."""
    turns = numbered(df, [group], order, "turn").withColumn("turn", F.col("turn") + 1)
    return numbered(turns, [], ["turn", group, *order], "visit").withColumn("visit", F.col("visit") + 1)


def offsets(df: DataFrame, group: list[str], order: list[str], length: Column, gap: int) -> DataFrame:
    """df with start and end of its pieces in the joined text."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + gap).over(before), F.lit(0)).cast("long")
    return df.withColumn("start", start).withColumn("end", (F.col("start") + length).cast("long"))
