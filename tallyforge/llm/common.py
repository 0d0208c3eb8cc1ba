"""What the training-data operators share: the shared folder, written tables, group counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K

_own: dict[str, str] = {}


#: Bytes of rows that one Arrow batch to or from Python holds, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session by bytes, so that memory doesn't follow the length of texts.

    It stays so: plans are lazy, and a batch is cut when its plan runs.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key).lower().rstrip("b")
    if not have.isdigit() or int(have) > BATCH_BYTES or int(have) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is this process, as in tests, a temporary folder is made.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, _own[key], True)
    return f"file://{_own[key]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads start there and no executor is needed for it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one call in the shared folder; ``clear`` deletes them once what they led to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` in a folder for each value of ``column``, so that those of one value are read alone."""
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.repartition(column).write.partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            deleted(self.spark, path)
        self.paths = []


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store by way of Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name.

    The numbers are fixed only once the result is written: read the written table, don't compute them twice.
    """
    row = unused(docs, name)
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if the table has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, all their columns, for whose texts ``keep`` is true; no shuffle and no join."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at))))

    return docs.mapInArrow(K.lean(run), docs.schema)
