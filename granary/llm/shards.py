"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash, read as a number u in (0, 1); a record goes to the shard with
the least ``-ln(u) / weight``. The choice for a key compares each pair on its own, so a new shard
only takes records into itself (the share of its weight) and a removed one only gives its own away.
Within a shard records get gapless slots from 0, in the order of their keys' hashes.

A null key is a key of its own. Repeated rows share key and shard and get slots of their own, in the
order of the table they are read from; they may be a third of all rows, as a shard is numbered by ranges. A
null text has no bytes: size 1 and checksum 0; a text of any length is one value. Columns named shard or
slot are replaced, all others stay whatever their names. An empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.textkit import fresh, numbered

_TOP = 1 << 52


def unit_hash(key: Column, salt: str) -> Column:
    """An even number in (0, 1) from the first 52 bits of the MD5 of salt and key."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / _TOP


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of key among len(weights) shards; a shard of weight 0 takes nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite, not negative and not all 0")
    costs = [F.struct((-F.ln(unit_hash(key, str(i))) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*costs))["shard"]


def with_shards(docs: DataFrame, weights: list[float], key: str = "doc_id") -> DataFrame:
    """docs with shard and slot in place of columns of these names."""
    rest = docs.drop("shard", "slot")
    digest, tie = fresh([*rest.columns, "shard", "slot"], "digest", "tie")
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary"))
    at = rest.select("*", shard_of(F.col(key), weights).alias("shard"), order.alias(digest), F.monotonically_increasing_id().alias(tie))
    return numbered(at, ["shard"], [digest, tie], "slot").drop(digest, tie)


def write_sharded(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Write docs as Parquet, one folder for each shard."""
    docs.withColumn("shard", shard_of(F.col(key), weights)).write.partitionBy("shard").parquet(path)


def placement(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    out = with_shards(rows, [1.0] * shards)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), shard_of(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"))
