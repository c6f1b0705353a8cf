"""Closures, nearest goals and cycles against a search of each node's own."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import graph


def steps(edges, start):
    found, front = {start: 0}, [start]
    for node in front:
        for a, b in edges:
            if a == node and b not in found:
                found[b] = found[node] + 1
                front.append(b)
    return found


@pytest.mark.parametrize("edges", [[(k, (k * 7 + 1) % 14) for k in range(14)], [(k, k // 2) for k in range(2, 24)] + [(k, k // 3) for k in range(3, 24)], [*sorted({(r.randrange(16), r.randrange(16)) for r in [random.Random(5)] for _ in range(22)})]])
def test_graphs_against_single_searches(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    starts = sorted({a for a, _ in edges})
    seeds, all_steps = df.select(F.col("src").alias("start")), {s: steps(edges, s) for s in starts}
    assert {tuple(r) for r in graph.reach(df, seeds).collect()} == {(s, n, d) for s in starts for n, d in all_steps[s].items()}
    assert {tuple(r) for r in graph.reach(df, seeds, 2).collect()} == {(s, n, d) for s in starts for n, d in all_steps[s].items() if d <= 2}
    goals = {s: min((d, n) for n, d in all_steps[s].items() if n % 5 == 0) for s in starts if any(n % 5 == 0 for n in all_steps[s])}
    assert sorted(tuple(r) for r in graph.nearest(df, seeds, F.col("node") % 5 == 0).select("start", "depth", "node").collect()) == sorted((s, *x) for s, x in goals.items())
    assert {r["node"] for r in graph.on_cycles(df).collect()} == {s for s in starts if any(b == s for n in all_steps[s] for a, b in edges if a == n)}
