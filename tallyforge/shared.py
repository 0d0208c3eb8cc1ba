"""Tables in the folder that driver and executors share, for plans that must read the same rows twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and the master is this process, as in tests, a folder of it."""
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


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: every later read finds the same rows, and no executor is needed for them."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`fixed` wrote, once what they led to is written or at the driver."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
