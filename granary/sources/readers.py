"""Readers of sources by url: each target must match exactly one, and what a reader gives is checked."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import host
from granary.operators import checks


class Readers:
    """Named readers; each is a url pattern and a function from targets (url) to pages (url, text)."""

    def __init__(self):
        self.known: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}

    def add(self, name: str, pattern: str, read: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.known:
            raise ValueError(f"there is a reader named {name}")
        self.known[name] = (pattern, read)

    def assigned(self, targets: DataFrame) -> DataFrame:
        """targets with reader, and error where none or several match."""
        fit = F.array_compact(F.array(*[F.when(F.col("url").rlike(p), F.lit(n)) for n, (p, _) in self.known.items()]).cast("array<string>"))
        out = targets.withColumn("__fit", fit)
        error = F.when(F.size("__fit") == 0, "no reader").when(F.size("__fit") > 1, "several readers")
        return out.withColumn("reader", F.when(F.size("__fit") == 1, F.col("__fit")[0])).withColumn("error", error).drop("__fit")

    def read(self, targets: DataFrame) -> DataFrame:
        """url, text, reader of the targets that have one reader."""
        dealt = self.assigned(targets)
        parts = [read(dealt.where(F.col("reader") == name).select(targets.columns)).select("url", "text", F.lit(name).alias("reader")) for name, (_, read) in self.known.items()]
        return reduce(DataFrame.unionByName, parts)


def output_violations(pages: DataFrame, hosts: list[str], longest: int = 10_000_000) -> DataFrame:
    """rule and key of pages that are empty, too long, from another host, or that repeat a url."""
    held = pages.withColumn("__host", host(F.col("url"))).withColumn("__listed", F.coalesce(F.col("__host").isin(hosts), F.lit(False)))
    return checks.violations(
        checks.broken("empty", held, "url", "length(trim(text)) > 0"),
        checks.broken("too long", held, "url", f"length(text) <= {longest}"),
        checks.broken("host", held, "url", "__listed"),
        checks.repeated("url", held, "url"),
    )
