"""Releases and corpora as write-once Parquet tables partitioned by release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.checks import inventory_difference
from granary.operators.tables import free, settle


def read_files(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = 50 << 20) -> DataFrame:
    """path, bytes, sha256, content of the files below folder; larger ones have no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def manifest_difference(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status of every file that the manifest (path, sha256) lacks, misses or lists with another hash."""
    return inventory_difference(files.select("path", "sha256"), manifest.select("path", "sha256"), "path", "sha256")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; a line that doesn't fit the schema stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def import_rows(spark: SparkSession, rows: DataFrame, path: str, key: str, content: str) -> DataFrame:
    """Append the rows whose key is new; returns those whose key is there, or among the rows, with other content, and appends nothing if there are any."""
    try:
        there = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = spark.createDataFrame([], rows.schema)
    known = settle(there.select(key, F.col(content).alias("__known")))
    new = settle(rows.dropDuplicates([key, content]))
    twice = new.groupBy(key).count().where("count > 1").select(key)
    clash = settle(new.join(known, key).where(~F.col(content).eqNullSafe(F.col("__known"))).select(rows.columns).union(new.join(twice, key, "left_semi").select(rows.columns)).distinct())
    if clash.isEmpty():
        new.join(known, key, "left_anti").select(rows.columns).write.mode("append").parquet(path)
    free(known)
    return clash


def export_bytes(spark: SparkSession, path: str, key: str, value: str, content: str = "content", digest: str = "sha256") -> bytes:
    """The stored bytes of one row; raises KeyError if it is not there and ValueError if they no longer have the hash they came with."""
    rows = spark.read.parquet(path).where(F.col(key) == value).select(content, digest, F.sha2(content, 256).alias("now")).limit(1).collect()
    if not rows:
        raise KeyError(value)
    if rows[0]["now"] != rows[0][digest]:
        raise ValueError(f"{value} does not have its hash")
    return bytes(rows[0][content])


def verify_import(spark: SparkSession, rows: DataFrame, path: str, key: str, content: str) -> DataFrame:
    """What of rows can't be read back as written: empty after a whole import."""
    back = spark.read.parquet(path).join(rows.select(key), key, "left_semi")
    return inventory_difference(rows.dropDuplicates([key]), back, key, content)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, release_id: str) -> None:
    """Write the tables of one release; a release that is there is never changed."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}/release_id={release_id}")


def release_table(spark: SparkSession, path: str, name: str, release_id: str) -> DataFrame:
    """One table of one release: only its partition is read."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("release_id") == release_id)


def activate(spark: SparkSession, path: str, release_id: str) -> None:
    """Point to the active release: one row, overwritten."""
    spark.createDataFrame([(release_id,)], "release_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/active")


def active_release(spark: SparkSession, path: str) -> str | None:
    row = spark.read.parquet(f"{path}/active").first()
    return row["release_id"] if row else None


def assemble(spark: SparkSession, folder: str, manifest: DataFrame, schema: str) -> DataFrame:
    """Rows of all JSON lines parts below folder as one table; raises if a part differs from the manifest (path, sha256)."""
    wrong = manifest_difference(read_files(spark, folder, "*.jsonl"), manifest).limit(5).collect()
    if wrong:
        raise ValueError(f"parts differ from their manifest: {[tuple(r) for r in wrong]}")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True)
    return rows.json(folder)
