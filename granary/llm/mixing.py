"""Mixing sources to target weights by capped water-filling.

All words of the corpus are shared among the sources by weight; a source gets at most ``cap``
times its own words, and what it can't take is shared again among the others by weight, until no
source is above. Each source then takes its documents target / size times: whole repetitions of all,
and for the fraction those documents that come first in a seeded hash order until the fraction is
filled (a document is in if its middle lies within it). So a source's words miss its target by at
most half its longest document, and a document is never repeated more than ``cap`` times.

The rounds of water-filling work on one row per source, and the weights are dealt in one task over
these rows: their number is that of the sources, not of the documents. The hash order is cut into
ranges, so that a source of any size is summed in parts, and so are the rows of one id.

A null text has size 0; a text of any length is only counted. Null is a source of its own, last in
order; sources without words have target 0. Repeated rows stand beside each other in the hash order and
are taken one by one; rows of one id, size and text are alike, so a rerun gives the same rows. A null id
is an id. Columns of any name stay as they are: what this module adds is kept apart from the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.textkit import column, free, running_sum, settle

CAP, SEED = 3, 17


def n_words(text):
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources with weight: the given weights in turn over the sources in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (source, source_size, weight) with target.

    Sizes and weights stay whole numbers until the one division that gives a target. They are multiplied as longs: a
    weight times the words of a corpus of 6 GB is beyond an int.
    """
    sources = sources.withColumn("weight", F.col("weight").cast("long"))
    state = settle(sources.select("*", F.lit(False).alias("full")))
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        taken, weight = state.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
        share = F.col("weight") * F.lit(total - taken) / F.lit(weight) if weight else F.lit(0.0)
        above = ~F.col("full") & (F.col("weight") * F.lit(total - taken) > F.col("source_size") * cap * F.lit(weight))
        if not weight or state.where(above).isEmpty():
            return state.select("source", "source_size", "weight", F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))
        before, state = state, settle(state.withColumn("full", F.col("full") | above))
        free(before)


def repetitions(docs: DataFrame, kept: list[str], cap: int = CAP, seed: int = SEED) -> DataFrame:
    """row (a struct of the columns ``kept`` of docs), doc_id, size, source_size, target and copies."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    base = docs.select(F.struct(*[column(c) for c in kept]).alias("row"), "doc_id", "source", n_words(text).alias("size"), place.alias("place"), F.xxhash64(text).alias("content"), F.monotonically_increasing_id().alias("tie"))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(ranked_weights(sources), cap).select(F.col("source").alias("of"), "source_size", "target")
    # One row per source: broadcast only below Spark's own threshold.
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    run = running_sum(rows, ["source"], ["place", "size", "content", "tie"], {"before": "size"})
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    rest = F.col("target") - whole * F.col("source_size")
    more = F.when((F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest), 1).otherwise(0)
    return run.select("row", "doc_id", "size", "source_size", "target", (whole + more).cast("int").alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document)."""
    return repetitions(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns stay, with their values."""
    rows = repetitions(docs, docs.columns).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
