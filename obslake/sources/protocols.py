"""Collectors and exporters of one's own as Spark data sources.

* A collector names its partitions on the driver and reads each of them in a task. Its drafts are staged in the shared folder while
  integer diagnostics are observed in the same pass; only then is the run accepted or refused.
* An exporter delivers a task's rows and returns a receipt; the driver confirms a delivery with all receipts, or withdraws
  it when a task has failed. A delivery that was confirmed isn't made again, so a repeated batch changes nothing.

Both work on what they are given as objects: anything that pickles and has the methods below.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from .registry import MOST_DRAFTS, Registry

#: fixed values: the form of names, the number of diagnostics, and the largest whole number that JSON keeps
NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")
MOST_DIAGNOSTICS, MOST_INT = 64, 2**53 - 1


class Collector(Protocol):
    """descriptor: {collector_id, version, schema (DDL of the drafts)}."""

    descriptor: dict[str, Any]

    def partitions(self, options: dict[str, str]) -> list[Any]:
        """What the tasks read, one each; called on the driver."""

    def collect(self, part: Any) -> Iterator[pa.RecordBatch]:
        """Drafts of one part; called in a task, and again if the task is lost."""


class Exporter(Protocol):
    """A destination."""

    exporter_id: str

    def deliver(self, rows: Iterator[pa.RecordBatch], delivery: str, task: str) -> dict:
        """Takes a task's rows, in the task; the receipt goes to the driver. Raises where it fails."""

    def confirm(self, delivery: str, receipts: list[dict]) -> None:
        """All tasks have delivered; called on the driver."""

    def withdraw(self, delivery: str, receipts: list[dict]) -> None:
        """A task has failed: nothing of the delivery may stay."""

    def delivered(self, delivery: str) -> bool:
        """Whether the delivery was confirmed."""


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, for use in tasks and on the driver alike."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    value: Any


def reading(collector: Collector) -> type[DataSource]:
    """A data source that reads what a collector collects."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [Part(p) for p in collector.partitions(self.options)]

        def read(self, partition):
            if partition is not None:
                yield from collector.collect(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return f"collect_{collector.descriptor['collector_id']}"

        def schema(self):
            return collector.descriptor["schema"]

        def reader(self, schema):
            return Reader(self.options)

    return Source


@dataclass
class Receipt(WriterCommitMessage):
    value: dict = field(default_factory=dict)


def writing(exporter: Exporter) -> type[DataSource]:
    """A data source, batch and stream, that writes to an exporter. Option `delivery`: the name of a batch; a stream adds the number of its batch."""

    class Writer(DataSourceArrowWriter):
        def __init__(self, delivery: str):
            self.delivery, self.again = delivery, exporter.delivered(delivery)

        def write(self, iterator):
            if self.again:
                return Receipt()
            context = TaskContext.get()
            return Receipt(exporter.deliver(iterator, self.delivery, f"{context.partitionId():05d}-{context.taskAttemptId()}"))

        def commit(self, messages):
            if not self.again:
                exporter.confirm(self.delivery, [m.value for m in messages if m is not None])

        def abort(self, messages):
            if not self.again:
                exporter.withdraw(self.delivery, [m.value for m in messages if m is not None])

    class StreamWriter(DataSourceStreamArrowWriter):
        """The number of a batch is only known when it commits: tasks deliver under a passing name, and receipts say what they wrote."""

        def __init__(self, delivery: str):
            self.delivery, self.staged = delivery, f"{delivery}-{uuid.uuid4().hex}"

        def write(self, iterator):
            context = TaskContext.get()
            return Receipt(exporter.deliver(iterator, self.staged, f"{context.partitionId():05d}-{context.taskAttemptId()}"))

        def commit(self, messages, batchId):
            receipts = [m.value for m in messages if m is not None]
            name = f"{self.delivery}-{batchId}"
            if exporter.delivered(name):
                exporter.withdraw(self.staged, receipts)
            else:
                exporter.confirm(name, receipts)

        def abort(self, messages, batchId):
            exporter.withdraw(self.staged, [m.value for m in messages if m is not None])

    class Source(DataSource):
        @classmethod
        def name(cls):
            return f"export_{exporter.exporter_id}"

        def writer(self, schema, overwrite):
            return Writer(self.options["delivery"])

        def streamWriter(self, schema, overwrite):
            return StreamWriter(self.options["delivery"])

    return Source


@dataclass
class FolderExporter:
    """An exporter to a folder that all executors reach: Parquet parts, and a manifest for each delivery that names its parts.

    Readers take the parts of manifests only, and a manifest comes into being as a whole: it is written under another name and moved.
    """

    exporter_id: str
    root: str

    def deliver(self, rows, delivery, task):
        disk, root = store(self.root)
        disk.create_dir(f"{root}/parts", recursive=True)
        name, n, writer = f"{delivery}-{task}.parquet", 0, None
        try:
            for batch in rows:
                if writer is None:
                    writer = pq.ParquetWriter(f"{root}/parts/{name}", batch.schema, filesystem=disk)
                writer.write_batch(batch)
                n += batch.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                disk.delete_file(f"{root}/parts/{name}")
            raise
        if writer is None:
            return {}
        writer.close()
        return {"part": name, "rows": n}

    def confirm(self, delivery, receipts):
        disk, root = store(self.root)
        disk.create_dir(f"{root}/manifests", recursive=True)
        parts = [r for r in receipts if r]
        with disk.open_output_stream(f"{root}/_{delivery}.json") as out:
            out.write("\n".join(json.dumps({"delivery": delivery, **p}) for p in parts or [{"part": None, "rows": 0}]).encode())
        disk.move(f"{root}/_{delivery}.json", f"{root}/manifests/{delivery}.json")

    def withdraw(self, delivery, receipts):
        disk, root = store(self.root)
        mine = {r["part"] for r in receipts if r}
        for info in disk.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
            if info.base_name in mine or info.base_name.startswith(f"{delivery}-"):
                disk.delete_file(info.path)

    def delivered(self, delivery):
        disk, root = store(self.root)
        return disk.get_file_info(f"{root}/manifests/{delivery}.json").type == fs.FileType.File

    def manifests(self, spark: SparkSession) -> DataFrame:
        """(delivery, part, rows) of what was confirmed."""
        return spark.read.schema("delivery string, part string, rows bigint").json(f"{self.root}/manifests")

    def published(self, spark: SparkSession) -> DataFrame:
        """The rows of confirmed deliveries, with the delivery."""
        rows = spark.read.parquet(f"{self.root}/parts").withColumn("part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        return rows.join(self.manifests(spark).select("delivery", "part"), "part").drop("part")


@dataclass
class JsonLinesCollector:
    """Collects the files of a folder of JSON lines, a file a task. A line that isn't an object with an id is a draft with an error code only."""

    folder: str
    descriptor: dict = field(default_factory=lambda: {"collector_id": "json_lines", "version": 1, "schema": "draft_id string, kind string, error string"})
    id_key: str = "id"
    kind_key: str = "kind"

    def partitions(self, options):
        disk, root = store(self.folder)
        return sorted(f.path for f in disk.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def collect(self, part):
        disk, _ = store(self.folder)
        with disk.open_input_stream(part) as raw:
            rows = []
            for line in _lines(raw):
                rows.append(self._draft(line))
                if len(rows) == 10_000:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _draft(self, line: bytes):
        try:
            x = json.loads(line)
        except ValueError:
            return None, None, "OL_SOURCE_JSON"
        if not isinstance(x, dict) or type(x.get(self.id_key)) not in (str, int):
            return None, None, "OL_SOURCE_SHAPE"
        kind = x.get(self.kind_key)
        return str(x[self.id_key]), kind if isinstance(kind, str) else None, None

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["draft_id", "kind", "error"])


def _lines(raw) -> Iterator[bytes]:
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x)
    if rest:
        yield rest


def register(spark: SparkSession, registry: Registry, thing: Collector | Exporter) -> str:
    """Registers a collector or an exporter by its name, here and with Spark, once; returns the name of its data source."""
    name = thing.exporter_id if hasattr(thing, "exporter_id") else thing.descriptor["collector_id"]
    if not NAME.fullmatch(name):
        raise ValueError("OL_REGISTRY_NAME")
    source = writing(thing) if hasattr(thing, "exporter_id") else reading(thing)
    registry.register(source.name(), lambda: thing)
    spark.dataSource.register(source)
    return source.name()


def collect(spark: SparkSession, registry: Registry, name: str, folder: str, diagnostics: dict[str, Column] | None = None, most: int = MOST_DRAFTS) -> tuple[DataFrame, dict[str, int]]:
    """(drafts, diagnostics) of one run of a registered collector; the drafts are a table under `folder`.

    Diagnostics are whole numbers, found while the drafts are written: no second pass counts them. A run with more than
    `most` drafts, or with a diagnostic that is no count, is refused with a code after that pass.
    """
    registry.resolve(name)
    more = diagnostics or {}
    if len(more) > MOST_DIAGNOSTICS or not all(NAME.fullmatch(k) for k in more):
        raise ValueError("OL_COLLECTOR_DIAGNOSTICS")
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    at = f"{folder}/{name}-{uuid.uuid4().hex}"
    drafts = spark.read.format(name).load()
    drafts.observe(seen, F.count(F.lit(1)).alias("drafts"), *[c.alias(k) for k, c in more.items()]).write.parquet(at)
    got = {k: 0 if v is None else v for k, v in seen.get.items()}
    if got["drafts"] > most:
        raise ValueError("OL_COLLECTOR_DRAFTS")
    if not all(type(v) is int and 0 <= v <= MOST_INT for v in got.values()):
        raise ValueError("OL_COLLECTOR_DIAGNOSTICS")
    return spark.read.schema(drafts.schema).parquet(at), got


def export(registry: Registry, name: str, batch: DataFrame, delivery: str) -> None:
    """Writes a batch to a registered exporter, under the name of a delivery: a second time changes nothing."""
    registry.resolve(name)
    batch.write.format(name).mode("append").option("delivery", delivery).save()


def export_stream(registry: Registry, name: str, stream: DataFrame, delivery: str, checkpoint: str):
    """Runs a stream into a registered exporter over all that is there."""
    registry.resolve(name)
    query = stream.writeStream.format(name).option("delivery", delivery).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
