"""Queries over tables with more rows in a group than the small scale factors have."""

import datetime as dt

import duckdb
import pytest

from obslake.plans import registry

from .test_queries import plain


def tables(spark, sf_dir, folder, **rows):
    """The folder with tables of rows, as dicts, and the small ones as they are; and DuckDB over them."""
    duck = duckdb.connect()
    duck.sql("SET TimeZone = 'UTC'")
    for name in ("nation", "region", *rows):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in rows:
            df = spark.createDataFrame([tuple(r.get(f.name) for f in df.schema) for r in rows[name]], df.schema)
        df.write.parquet(f"{folder}/{name}.parquet")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), duck


def agree(spark, folder, duck, name):
    got = registry.QUERIES[name](spark, folder).toPandas()
    assert plain(got.convert_dtypes()) == plain(duck.sql(registry.ORACLES[name]).df().convert_dtypes())


@pytest.fixture(scope="module")
def busy(spark, sf_dir, tmp_path_factory):
    """Two days of 1,300 events each of one target, which are two segments a day, and some events of another one."""
    start = dt.datetime(2024, 1, 3)
    events = [{"event_id": i, "ts": start + dt.timedelta(days=i % 2, seconds=i), "user_id": 4 if i < 2600 else 5, "event_type": ("view", "error")[i % 3 == 0], "value": 1.0, "props": "{}"} for i in range(2620)]
    return tables(spark, sf_dir, tmp_path_factory.mktemp("busy"), events=events)


def test_days_of_several_damaged_segments_count_once(spark, busy):
    agree(spark, *busy, "record_metadata")


def test_high_water_lies_beyond_any_number_of_files(spark, sf_dir, tmp_path):
    suppliers = [{"s_suppkey": i, "s_nationkey": 6 if i < 1200 else i % 25} for i in range(1400)]
    agree(spark, *tables(spark, sf_dir, tmp_path, supplier=suppliers), "rotation_losses")
