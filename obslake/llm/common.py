"""What the operators' queries share: tables, schemas, digests."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def extended(schema: T.StructType, **more: str) -> T.StructType:
    """schema without columns of the new names, then the new columns: a result replaces an input column of its name."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    fields = [f for f in schema.fields if f.name not in more]
    return T.StructType([*fields, *[T.StructField(k, kinds[v] if isinstance(v, str) else v) for k, v in more.items()]])


def none_of(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def with_columns(batch, **more):
    """An Arrow batch or table with columns put at its end, replacing those of the same names."""
    names = [c for c in batch.schema.names if c not in more]
    make = pa.table if isinstance(batch, pa.Table) else pa.RecordBatch.from_arrays
    cols = [*[batch.column(c) for c in names], *more.values()]
    return make(cols, names=[*names, *more])


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local mode makes one; a cluster must name it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one run in the shared folder, removed at its end but for the result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.folders: dict[int, str] = {}

    def __enter__(self):
        return self

    def __exit__(self, *error):
        for folder in self.folders.values():
            self._remove(folder)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a table: written, its lineage cut, read again."""
        self.n += 1
        folder = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = folder
        out._scratch = self  # keeps the id in use
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing will read any more."""
        self._remove(self.folders.pop(id(df)))

    def result(self, df: DataFrame) -> DataFrame:
        """df as a table that stays."""
        out = self.keep(df)
        self.folders.pop(id(out))
        return out
