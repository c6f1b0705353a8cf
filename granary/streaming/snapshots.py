"""New snapshot files as a stream: each content is kept once, whenever it arrives again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "page_id long, url string, html string, fetched timestamp"


def snapshots(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of the JSON files that appear in folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_contents(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once within the watermark: the state holds hashes of that time only."""
    hashed = stream.withColumn("sha256", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    return hashed.withWatermark("fetched", late).dropDuplicatesWithinWatermark(["sha256"])


def write_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's contents to path and stop when what is there now has been read."""
    return first_contents(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
