"""Releases as a data source: ``spark.read.format("granary_release")`` gives the tables of a published release.

A store is a folder: ``<release>/<table>/`` holds write-once Parquet parts, ``<release>/PARTS.jsonl`` lists the schema of each
table and the path, size, rows and sha256 of each part, and ``ACTIVE-<n>`` names the active release. A pointer is
written under another name and renamed to the next number; the greatest number holds, so a reader always finds one.

Planning looks at the list and at the sizes of the parts: one that is missing, grown, shrunk, a link or not listed
stops the read. Each part is one partition; its task hashes it before any of its rows goes out, so one changed byte stops
the read too. Filters on whole numbers, texts and dates reach the row groups; Spark tests all filters again.

An empty table has parts without rows; columns may be null or of any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from datetime import date, datetime

import pyarrow as pa
import pyarrow.dataset as pad
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PARTS, ACTIVE = "PARTS.jsonl", "ACTIVE-"
_CHUNK = 4 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or uri, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def file_digest(fs: pafs.FileSystem, path: str) -> str:
    """Hex sha256 of a file, read in chunks."""
    digest = hashlib.sha256()
    with fs.open_input_stream(path) as stream:
        while chunk := stream.read(_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def put(path: str, text: str) -> None:
    """Write a small file whole: under another name first, then renamed."""
    fs, at = file_system(path)
    draft = f"{at}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        out.write(text.encode())
    fs.move(draft, at)


def _listed(root: str, release_id: str) -> list[dict]:
    fs, at = file_system(f"{root}/{release_id}/{PARTS}")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        raise ValueError(f"release {release_id} has no list of parts")
    with fs.open_input_stream(at) as stream:
        return [json.loads(line) for line in stream.read().decode().splitlines()]


def write_release(spark: SparkSession, tables: dict[str, DataFrame], root: str, release_id: str, rows_a_part: int = 1_000_000) -> None:
    """Write the tables of a release and the list of their parts; a release that is there is never changed."""
    lines = []
    for name, df in tables.items():
        folder = f"{root}/{release_id}/{name}"
        df.write.option("maxRecordsPerFile", rows_a_part).mode("errorifexists").parquet(folder)
        lines.append({"table": name, "schema": df.schema.jsonValue()})
        # Without its content column the scan lists files only; the tasks then read them in chunks.
        paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    fs, at = file_system(row["path"])
                    found.append({"path": os.path.basename(at), "bytes": row["length"], "sha256": file_digest(fs, at), "rows": pq.read_metadata(at, filesystem=fs).num_rows})
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("rows", pa.int64())]))

        parts = paths.mapInArrow(seen, "path string, bytes long, sha256 string, rows long").collect()  # a row for each file
        lines += [{"table": name, **part.asDict()} for part in sorted(parts)]
    put(f"{root}/{release_id}/{PARTS}", "".join(json.dumps(line, sort_keys=True) + "\n" for line in lines))


def _pointers(root: str) -> list[tuple[int, str]]:
    fs, at = file_system(root)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted((int(f.base_name[len(ACTIVE) :]), f.path) for f in found if f.base_name.startswith(ACTIVE) and f.base_name[len(ACTIVE) :].isdigit())


def activate(root: str, release_id: str) -> None:
    """Make a whole release the active one."""
    _listed(root, release_id)
    there = _pointers(root)
    put(f"{root}/{ACTIVE}{(there[-1][0] if there else 0) + 1:08d}", release_id)


def active(root: str) -> str | None:
    """The id of the active release."""
    there = _pointers(root)
    if not there:
        return None
    fs, _ = file_system(root)
    with fs.open_input_stream(there[-1][1]) as stream:
        return stream.read().decode()


class Part(InputPartition):
    def __init__(self, path: str, digest: str):
        super().__init__(None)
        self.path, self.digest = path, digest


class ReleaseReader(DataSourceReader):
    def __init__(self, root: str, release_id: str, table: str, schema: StructType, max_parts: int):
        self.root, self.release_id, self.table, self.names, self.max_parts = root, release_id, table, schema.fieldNames(), max_parts
        self.kept: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            sign = signs.get(type(f))
            values = (f.value if sign == "in" else [f.value]) if sign else []
            # Floating point is left to Spark, where NaN is a value.
            if sign and len(f.attribute) == 1 and values and all(isinstance(v, (int, str, date)) and not isinstance(v, datetime) for v in values):
                self.kept.append((f.attribute[0], sign, list(values) if sign == "in" else f.value))
            yield f

    def partitions(self) -> list[Part]:
        fs, folder = file_system(f"{self.root}/{self.release_id}/{self.table}")
        listed = {p["path"]: p for p in _listed(self.root, self.release_id) if p["table"] == self.table and "path" in p}
        if len(listed) > self.max_parts:
            raise ValueError(f"{self.table} has {len(listed)} parts, more than {self.max_parts}")
        there = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet")}
        wrong = sorted(listed.keys() ^ there.keys())
        wrong += [name for name in sorted(listed.keys() & there.keys()) if there[name].size != listed[name]["bytes"]]
        if isinstance(fs, pafs.LocalFileSystem):
            wrong += [name for name, f in sorted(there.items()) if os.path.islink(f.path)]
        if wrong:
            raise ValueError(f"parts of {self.table} differ from their list: {wrong[:5]}")
        return [Part(f"{self.root}/{self.release_id}/{self.table}/{name}", part["sha256"]) for name, part in sorted(listed.items())]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(partition.path)
        if file_digest(fs, at) != partition.digest:
            raise ValueError(f"{partition.path} does not have its hash")
        wanted = None
        for name, sign, value in self.kept:
            x = pad.field(name)
            test = {"==": x == value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[sign] if sign != "in" else x.isin(value)
            wanted = test if wanted is None else wanted & test
        yield from pad.dataset(at, format="parquet", filesystem=fs).to_batches(columns=self.names, filter=wanted, batch_size=4096, batch_readahead=1, fragment_readahead=1)


class ReleaseSource(DataSource):
    """Options: path (the store), table, release (default: the active one), columns (names as a JSON array; default: all), maxParts."""

    @classmethod
    def name(cls) -> str:
        return "granary_release"

    def _release(self) -> str:
        # Looked up once, so that schema and parts are those of one release.
        if "release" not in self.options:
            found = active(self.options["path"])
            if found is None:
                raise ValueError("no release is active")
            self.options["release"] = found
        return self.options["release"]

    def schema(self) -> StructType:
        lines = [x for x in _listed(self.options["path"], self._release()) if x["table"] == self.options["table"] and "schema" in x]
        if not lines:
            raise ValueError(f"release {self._release()} has no table {self.options['table']}")
        whole = StructType.fromJson(lines[0]["schema"])
        return StructType([whole[c] for c in json.loads(self.options["columns"])]) if "columns" in self.options else whole

    def reader(self, schema: StructType) -> ReleaseReader:
        return ReleaseReader(self.options["path"], self._release(), self.options["table"], schema, int(self.options.get("maxparts", 1_000_000)))


def read_release(spark: SparkSession, root: str, table: str, release_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table of a release, the active one unless another is named."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReleaseSource)
    reader = spark.read.format(ReleaseSource.name()).option("path", root).option("table", table).option("release", release_id or active(root) or "")
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()


def inventory(spark: SparkSession, root: str, release_id: str) -> DataFrame:
    """table, parts, bytes and rows of a release, as its list says."""
    lines = _listed(root, release_id)
    parts = [(x["table"], x["path"], x["bytes"], x["rows"]) for x in lines if "path" in x]
    rows = spark.createDataFrame(parts, "table string, path string, bytes long, rows long")
    return rows.groupBy("table").agg(F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
