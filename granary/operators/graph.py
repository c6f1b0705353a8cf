"""Closures over edge tables by joins to a fixpoint; each step's rows lie in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.tables import free, settle

#: Fixed value: steps between two looks at all that is known.
_APART = 4


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): nodes reached from each seed (start) over edges (src, dst), with the least number of steps.

    Only the newest rows are joined in a step. All known rows are moved at every fourth step only, when those that
    the steps since then found again are dropped, so cycles end and the known rows are moved less often than steps are made.
    """
    edges = settle(edges.select("src", "dst").distinct())
    known = front = settle(seeds.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    depth, pending = 0, []
    while max_depth is None or depth < max_depth:
        depth += 1
        front = settle(front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        pending.append(front)
        done = front.isEmpty()
        if not done and len(pending) < _APART and depth != max_depth:
            continue
        found = pending[0]
        for more in pending[1:]:
            found = found.union(more)
        new = settle(found.groupBy("start", "node").agg(F.min("depth").alias("depth")).join(known, ["start", "node"], "left_anti"))
        free(*pending)
        known, pending = known.union(new), []
        front = new.where(F.col("depth") == depth)
        if done or front.isEmpty():
            break
    return known


def nearest(edges: DataFrame, seeds: DataFrame, goal: Column) -> DataFrame:
    """(start, node, depth): of the nodes that a seed (start) reaches, itself included, the nearest that meets ``goal`` (of node), by depth and then node; seeds that reach none are left out.

    A seed walks no further than to its first goal.
    """
    edges = settle(edges.select("src", "dst").distinct())
    front = settle(seeds.select("start", F.col("start").alias("node")).distinct())
    known, found, depth = front, front.where(goal).groupBy("start").agg(F.min("node").alias("node")).withColumn("depth", F.lit(0)), 0
    front = front.join(found.select("start"), "start", "left_anti")
    while True:
        depth += 1
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = settle(step.join(known, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return found
        hit = new.where(goal).groupBy("start").agg(F.min("node").alias("node"))
        found = found.union(hit.withColumn("depth", F.lit(depth)))
        front = new.join(hit.select("start"), "start", "left_anti")
        # What was known of the seeds that have arrived is of no more use.
        known = settle(known.union(new).join(front.select("start").distinct(), "start", "left_semi"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: edges whose ends lack a way in or a way out are taken off until none does, then what is left is searched."""
    left = settle(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        fewer = settle(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        free(left)
        left, before = fewer, n
        n = left.count()
        if n == before:
            break
    seeds = left.select(F.col("dst").alias("start")).distinct()
    return reach(left, seeds).join(left, F.col("node") == F.col("src")).where("start = dst").select(F.col("start").alias("node")).distinct()
