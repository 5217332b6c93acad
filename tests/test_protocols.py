"""Collectors and exporters of one's own: bounds, names, receipts, and what a failing task leaves."""

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from obslake.plans.protocol_queries import Refusing
from obslake.sources import protocols as P
from obslake.sources.registry import Registry


class Numbers:
    """A collector of three parts."""

    descriptor = {"collector_id": "numbers", "version": 1, "schema": "part int, n bigint"}

    def partitions(self, options):
        return [0, 1, 2]

    def collect(self, part):
        for k in range(2):
            yield pa.RecordBatch.from_arrays([pa.array([part] * 4, pa.int32()), pa.array(range(4 * k, 4 * k + 4), pa.int64())], names=["part", "n"])


def test_collectors_read_a_part_a_task_and_are_counted_once(spark, tmp_path):
    registry = Registry()
    name = P.register(spark, registry, Numbers())
    assert registry.names() == ["collect_numbers"] and spark.read.format(name).load().rdd.getNumPartitions() == 3
    drafts, seen = P.collect(spark, registry, name, str(tmp_path), {"large": F.count(F.when(F.col("n") > 5, 1)), "none": F.max(F.lit(None).cast("long"))})
    assert seen == {"drafts": 24, "large": 6, "none": 0} and drafts.count() == 24
    with pytest.raises(ValueError, match="OL_COLLECTOR_DRAFTS"):
        P.collect(spark, registry, name, str(tmp_path), most=23)
    for bad in ({"Large": F.count("n")}, {f"d{k}": F.count("n") for k in range(65)}, {"below": F.min(F.col("n") - 9)}, {"text": F.max(F.lit("secret"))}):
        with pytest.raises(ValueError, match="OL_COLLECTOR_DIAGNOSTICS"):
            P.collect(spark, registry, name, str(tmp_path), bad)
    with pytest.raises(KeyError):
        P.collect(spark, registry, "collect_gone", str(tmp_path))
    with pytest.raises(ValueError):
        P.register(spark, registry, Numbers())


def test_json_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes('{"id": 1, "kind": "x"}\n{"id": "é", "kind": 5}\n\n{broken\n[2]\n{"id": true}\n{"id": 1.5}'.encode())
    (tmp_path / "in/b").write_bytes(b"")
    (tmp_path / "in/_c").write_bytes(b"{broken")
    registry = Registry()
    drafts, _ = P.collect(spark, registry, P.register(spark, registry, P.JsonLinesCollector(str(tmp_path / "in"))), str(tmp_path / "out"))
    got = sorted(map(tuple, drafts.collect()), key=str)
    assert got == sorted([("1", "x", None), ("é", None, None), (None, None, "OL_SOURCE_JSON"), *[(None, None, "OL_SOURCE_SHAPE")] * 3], key=str)


def test_a_delivery_is_made_once_and_a_failed_one_leaves_nothing(spark, tmp_path):
    registry = Registry()
    to = P.FolderExporter("once", str(tmp_path))
    name = P.register(spark, registry, to)
    rows = spark.range(100).select("id", F.lit("view").alias("event_type")).repartition(4)
    P.export(registry, name, rows, "a")
    P.export(registry, name, rows, "a")
    P.export(registry, name, rows.where("id < 0"), "none")
    assert to.published(spark).groupBy("delivery").count().collect()[0]["count"] == 100
    assert sum(r["rows"] for r in to.manifests(spark).collect()) == 100 and to.delivered("none")
    before = sorted(p.name for p in (tmp_path / "parts").iterdir())
    bad = P.register(spark, registry, Refusing("bad", str(tmp_path)))
    with pytest.raises(PySparkException):
        P.export(registry, bad, rows.withColumn("event_type", F.when(F.col("id") == 77, "error").otherwise("view")), "b")
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == before and not to.delivered("b")
    P.export(registry, bad, rows, "b")
    assert to.published(spark).where("delivery = 'b'").count() == 100


def test_names(spark):
    with pytest.raises(ValueError, match="OL_REGISTRY_NAME"):
        P.register(spark, Registry(), P.FolderExporter("Not a name", "/tmp"))
