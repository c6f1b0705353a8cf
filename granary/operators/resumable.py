"""Runs that go on where the last one stopped: only what is new, changed or failed is worked on again.

State is kept in shards by a hash of the key. A run writes the shards that change to a folder of its own,
``run-<n>-<random>``, and then names, for each shard, the folder that holds it in ``STATE-<n>``, written under another name and
renamed. A run that dies leaves the state before it as it was; shards that nothing touched are neither read as content
nor written. The list of shards is bounded by their number, whatever the number of targets.

A target is done if its key, the hash of its content and the version of the extractor are those of a row that did not
fail. Keys of two contents can't be told apart: they are kept as failed, with that reason, and never extracted. Rows
that repeat key and content are one target. Targets without a key are counted, not run. Keys no longer among the targets
leave the state. A null content is a content of its own. Of two runs at once the one that ends last is the state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.tables import free, settle
from granary.sources.store import file_system, put

STATE = "STATE-"
TWO_CONTENTS = "two contents of one key"


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key by the first 32 bits of its sha256."""
    return F.pmod(F.conv(F.left(F.sha2(key.cast("string").cast("binary"), 256), F.lit(8)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _latest(root: str) -> dict:
    fs, at = file_system(root)
    found = [f for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.base_name.startswith(STATE) and f.base_name[len(STATE) :].isdigit()]
    if not found:
        return {"run": 0, "shards": None, "at": {}}
    with fs.open_input_stream(max(found, key=lambda f: f.base_name).path) as stream:
        return json.loads(stream.read().decode())


def results(spark: SparkSession, root: str) -> DataFrame | None:
    """key, sha256, version, error, run, result, shard of the last whole run; None before the first."""
    state = _latest(root)
    if not state["at"]:
        return None
    # Each run's folder is read for the shards it still holds.
    by_folder: dict[str, list[int]] = {}
    for shard, folder in state["at"].items():
        by_folder.setdefault(folder, []).append(int(shard))
    paths = [f"{root}/{folder}/shard={s}" for folder, held in sorted(by_folder.items()) for s in sorted(held)]
    rows = spark.read.parquet(*paths)
    return rows.withColumn("shard", shard_of(F.col("key"), state["shards"]))


def resume(targets: DataFrame, key: str, content: str, extract: Callable[[DataFrame], DataFrame], root: str, version: str, shards: int = 64, retry_failed: bool = True) -> dict[str, int]:
    """Bring the state at root up to targets; gives the numbers of reused, extracted, failed and removed targets.

    ``extract`` takes rows (key, content) and gives key, result and error (null if it went well), one row for each key.
    """
    spark, state = targets.sparkSession, _latest(root)
    if state["shards"] not in (None, shards):
        raise ValueError(f"the state has {state['shards']} shards, not {shards}")
    run = f"run-{state['run'] + 1:08d}"
    # A run that died may have left a folder of this number.
    folder = f"{run}-{uuid.uuid4().hex[:12]}"
    rows = targets.select(F.col(key).alias("key"), F.col(content).alias("content"))
    hashed = rows.where("key is not null").select("key", F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("")).alias("sha256"))
    wanted = settle(hashed.groupBy("key").agg(F.min("sha256").alias("sha256"), (F.min("sha256") != F.max("sha256")).alias("unclear")).withColumn("shard", shard_of(F.col("key"), shards)))
    before = results(spark, root)
    if before is None:
        known = wanted.select("key", F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("failure")).limit(0)
    else:
        known = before.select("key", F.col("sha256").alias("was"), F.col("version").alias("by"), F.col("error").alias("failure"))
    marked = known.withColumn("known", F.lit(True)).join(wanted.withColumn("asked", F.lit(True)), "key", "full")
    same = (F.col("was") == F.col("sha256")) & (F.col("by") == version) & ~F.col("unclear")
    done = same & (F.col("failure").isNull() if retry_failed else F.lit(True))
    # Two contents that were told apart from nothing before stay as they are.
    stays = F.col("unclear") & F.col("known") & (F.col("failure") == TWO_CONTENTS) & (F.col("was") == F.col("sha256")) & (F.col("by") == version)
    step = F.when(F.col("asked").isNull(), "removed").when(F.coalesce(done | stays, F.lit(False)), "reused").when(F.col("unclear"), "unclear").otherwise("todo")
    plan = settle(marked.select("key", "sha256", step.alias("step"), shard_of(F.col("key"), shards).alias("shard")))
    counts = {r["step"]: r["count"] for r in plan.groupBy("step").count().collect()}
    changed = [r["shard"] for r in plan.where("step <> 'reused'").select("shard").distinct().collect()]  # at most the number of shards
    failed = 0
    if changed:
        todo = plan.where("step = 'todo'")
        work = rows.join(todo.select("key"), "key", "left_semi").dropDuplicates(["key"])
        fresh = todo.drop("step").join(extract(work).select("key", "result", F.col("error").cast("string").alias("error")), "key", "left")
        # A target for which the extractor gives no row has failed.
        lost = F.when(F.col("error").isNull() & F.col("result").isNull(), F.lit("no result")).otherwise(F.col("error"))
        out = fresh.select("key", "sha256", F.lit(version).alias("version"), lost.alias("error"), F.lit(run).alias("run"), "result", "shard")
        unclear = plan.where("step = 'unclear'").select("key", "sha256", F.lit(version).alias("version"), F.lit(TWO_CONTENTS).alias("error"), F.lit(run).alias("run"), F.lit(None).cast(out.schema["result"].dataType).alias("result"), "shard")
        out = out.unionByName(unclear)
        if before is not None:
            held = before.where(F.col("shard").isin(changed)).join(plan.where("step = 'reused'").select("key"), "key", "left_semi")
            out = out.unionByName(held.select(*out.columns))
        # A shard may be written by several tasks, so that none holds one of them whole.
        out.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{root}/{folder}")
        filled = spark.read.parquet(f"{root}/{folder}").groupBy("shard").agg(F.count_if((F.col("run") == run) & F.col("error").isNotNull()).alias("failed")).collect() if not _is_empty(root, folder) else []
        failed = sum(r["failed"] for r in filled)
        holders = {s: r for s, r in state["at"].items() if int(s) not in changed} | {str(r["shard"]): folder for r in filled}
        put(f"{root}/{STATE}{state['run'] + 1:08d}", json.dumps({"run": state["run"] + 1, "shards": shards, "at": holders}, sort_keys=True))
    free(wanted, plan)
    without = rows.where("key is null").count()
    return {"reused": counts.get("reused", 0), "extracted": counts.get("todo", 0), "unclear": counts.get("unclear", 0), "removed": counts.get("removed", 0), "failed": failed, "without_key": without}


def _is_empty(root: str, folder: str) -> bool:
    """Whether a run wrote no shard: all its targets were removed."""
    fs, at = file_system(f"{root}/{folder}")
    return not any(f.base_name.startswith("shard=") for f in fs.get_file_info(FileSelector(at)))
