"""Line deduplication by overlapping windows of three lines.

Each text is cut at newlines; every three consecutive lines are a window, known by two 64-bit
hashes. A window that stands in more than one place of the corpus keeps its first place (by
doc_id, then line); all lines that any later place covers are removed, so overlapping places
merge. Texts of fewer than three lines have no window and stay as they are.

Null and empty texts stay as they are. Rows that repeat doc_id and text are one document: its places are
counted once, and all its rows lose the same lines. Rows of one doc_id with other texts are documents of their own, in
the order of a hash of the text, so a line goes only if its window stands in another place. Null doc_ids come last in order; their rows
are returned unchanged. Windows of equal lines are ties, decided by doc_id and then line. A text of n lines is
n array elements and n windows, and every step on it is linear in n. All columns stay, whatever their names,
but for n_lines and n_removed, which are replaced. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.textkit import column, fresh, settle

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, version (hash of the text), at (first line, from 0), h1, h2 of every window."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= size)
    hashed = lines.select("doc_id", "version", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))

    def window_hash(i, seed):
        return F.xxhash64(F.lit(seed), *[F.element_at("h", i + 1 + j) for j in range(size)])

    each = F.transform(F.sequence(F.lit(0), F.size("h") - size), lambda i: F.struct(i.alias("at"), window_hash(i, 1).alias("h1"), window_hash(i, 2).alias("h2")))
    return hashed.select("doc_id", "version", F.explode(each).alias("w")).select("doc_id", "version", "w.at", "w.h1", "w.h2")


def later_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, version, starts: the first lines, in order, of the windows that stand in an earlier place too."""
    each = windows(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), size)
    place = F.struct("doc_id", "version", "at")
    # Written first: a join of two plain tables is one whose large keys Spark can split.
    first = settle(each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last"))
    later = each.join(first, ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def _covered(starts: Column, size: int) -> Column:
    """Merged intervals (a, b) of lines, b excluded, that windows at the sorted starts cover; windows that touch are one interval."""
    n = F.size(starts)
    a = F.filter(starts, lambda x, i: (i == 0) | (x > starts[F.greatest(i - 1, F.lit(0))] + size))
    b = F.filter(starts, lambda x, i: (i == n - 1) | (starts[F.least(i + 1, n - 1)] > x + size))
    return F.arrays_zip(a.alias("a"), F.transform(b, lambda x: x + size).alias("b"))


def _cut(lines: Column, covered: Column) -> Column:
    """The lines outside the covered intervals, joined again."""
    n = F.size(covered)
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(covered, i - 1)["b"]).alias("a"), F.when(i == n, F.size(lines)).otherwise(F.get(covered, i)["a"]).alias("b")))
    kept = F.transform(F.filter(gaps, lambda g: g["b"] > g["a"]), lambda g: F.array_join(F.slice(lines, g["a"] + 1, g["b"] - g["a"]), "\n"))
    return F.array_join(kept, "\n")


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the removed lines cut out of text, and n_lines and n_removed in place of columns of these names."""
    rest = docs.drop("n_lines", "n_removed")
    of, version, starts, covered = fresh([*rest.columns, "n_lines", "n_removed"], "of", "version", "starts", "covered")
    gone = later_windows(docs.select("doc_id", F.col("text").cast("string").alias("text")), size).select(F.col("doc_id").alias(of), F.col("version").alias(version), F.col("starts").alias(starts))
    joined = rest.join(gone, (F.col("doc_id") == F.col(of)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version)), "left").drop(of, version).withColumn(covered, _covered(F.col(starts), size)).drop(starts)
    # Each text is cut into lines once, and the array is bound to a name: a function on it may not cut the text again for each line.
    once = lambda f: F.transform(F.array(F.split("text", "\n", -1)), f)[0]
    text = F.when(F.col(covered).isNull() | F.col("text").isNull(), F.col("text")).otherwise(once(lambda lines: _cut(lines, F.col(covered))))
    return joined.select(
        *[text.alias(c) if c == "text" else column(c) for c in rest.columns],
        F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(F.col(covered), F.lit(0), lambda acc, x: acc + x["b"] - x["a"]), F.lit(0)).cast("long").alias("n_removed"),
    )
