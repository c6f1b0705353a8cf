"""Array kernels for text inside Arrow batches, and the few Spark helpers the operators share.

Texts are handled as UTF-8 bytes: joined with a newline between rows, cut into words with
one table look-up per byte, and hashed with one running polynomial sum, so that no Python
loop runs per word. Work is cut into pieces of about ``PIECE`` bytes of text (a longer text
is a piece of its own), which bounds the memory of a task by its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.tables import free, fresh, settle, shared_folder

__all__ = ["ALNUM", "NOT_SPACE", "Words", "column", "free", "fresh", "mix64", "numbered", "pieces", "running_sum", "settle", "shared_folder", "span_hashes", "window_hashes", "with_texts_mapped"]

PIECE = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: True for bytes of words that white space separates.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: True for bytes of words of ASCII digits and letters and of everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values give unrelated hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * PIECE)
        for key, base in (("up", _MULT), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal contents wherever they stand."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i + width] for each i at which a whole window starts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix64(out)


class Words:
    """The words of a piece: hashes, and for row i the slice bounds[i]:bounds[i + 1] of them."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, dtype=np.uint8)
        inside = np.concatenate([[False], table[self.data]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        row_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, row_starts)
        self.joined = joined

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[i]]


def pieces(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) for runs of rows of about PIECE bytes; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column.cast(pa.large_binary()).to_pylist()):
        text = text or b""
        if held and size + len(text) > PIECE:
            yield first, held
            first, held, size = i, [], 0
        held.append(text.lower() if lower else text)  # bytes.lower() changes A-Z only
        size += len(text)
    if held:
        yield first, held


def with_texts_mapped(docs: DataFrame, keep: list[str], name: str, kind: T.DataType, f: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The columns ``keep`` of docs and ``name``: f of the texts of each Arrow batch. The row travels as one struct, so columns may have any name."""
    wanted = list(dict.fromkeys([*keep, "text"]))
    at = wanted.index("text")
    packed = docs.select(F.struct(*[column(c).cast("string").alias(c) if c == "text" else column(c).alias(c) for c in wanted]).alias("row"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, f(row.field(at))], ["row", "value"])

    out = packed.mapInArrow(rows, T.StructType().add("row", packed.schema["row"].dataType).add("value", kind))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("value").alias(name))


def running_sum(df: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Exclusive running sums of each group, without putting a group, or the rows of one key, into one task.

    values maps new column names to the columns they sum. The rows are dealt into ranges of (group, order) and
    written; ``order`` must end with a column in which rows of one key differ, so that a key of any size spreads over
    ranges. The totals of the ranges, one row for each range and group in it, get offsets by a window, and each
    range is then summed on its own.
    """
    part, *sums = fresh(df.columns + list(values), "range", *[f"sum_{i}" for i in range(len(values))])
    dealt = settle(df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    keys = [*group, part]
    other = dict(zip(keys, fresh([*dealt.columns, *values, *sums], *[f"key_{i}" for i in range(len(keys))]), strict=True))
    totals = dealt.groupBy(*keys).agg(*[F.sum(v).alias(s) for s, v in zip(sums, values.values(), strict=True)])
    ahead = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: it is broadcast below Spark's own threshold only.
    offsets = settle(totals.select(*[F.col(k).alias(other[k]) for k in keys], *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(s) for s in sums]))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(k) for k, v in values.items()])
    matched = summed.join(offsets, [F.col(k).eqNullSafe(F.col(other[k])) for k in keys])
    return matched.select(*[column(c) for c in df.columns], *[(F.col(k) + F.col(s)).alias(k) for k, s in zip(values, sums, strict=True)])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the places 0, 1, ... of its rows in their group, in a new column.

    As running_sum() with a one for each row, but the rows move once: they are sorted inside their ranges before they
    are written with their row numbers, so that a place is a difference of two numbers and needs no window.
    """
    at, first, ahead = fresh([*df.columns, name], "at", "first", "ahead")
    dealt = settle(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn(at, F.monotonically_increasing_id()))
    # The upper bits of a row number are its range, the lower ones count the rows of the range.
    part = F.shiftright(F.col(at), 33)
    other = dict(zip(group, fresh([*dealt.columns, name, first, ahead], *[f"key_{i}" for i in range(len(group))]), strict=True))
    of = fresh([*dealt.columns, name, first, ahead, *other.values()], "of")[0]
    totals = dealt.groupBy(*[F.col(g).alias(k) for g, k in other.items()], part.alias(of)).agg(F.count("*").alias(ahead), F.min(at).alias(first))
    before = Window.partitionBy(*other.values()).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: it is broadcast below Spark's own threshold only.
    starts = settle(totals.select(*other.values(), of, first, F.coalesce(F.sum(ahead).over(before), F.lit(0)).alias(ahead)))
    matched = dealt.join(starts, [*[F.col(g).eqNullSafe(F.col(k)) for g, k in other.items()], part == F.col(of)])
    return matched.select(*[column(c) for c in df.columns], (F.col(at) - F.col(first) + F.col(ahead)).alias(name))
