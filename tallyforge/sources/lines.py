"""Lines of text files with their numbers, read in splits; documents that may lack."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.shared import fixed


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def present(spark: SparkSession, path: str) -> str | None:
    """The path, or its compressed or plain sibling where it lacks; null without either."""
    sibling = path.removesuffix(".gz") if path.endswith(".gz") else f"{path}.gz"
    return next((p for p in (path, sibling) if exists(spark, p)), None)


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no from 1, line) of text files; a file is as many tasks' work as it has splits."""
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    raw = fixed(raw, "lines")  # the numbers of rows are fixed once they are written
    splits = raw.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))  # a row a split
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("path").alias("_path"), F.col("split").alias("_split"), (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("_zero"))
    return raw.join(splits, (F.col("path") == F.col("_path")) & (F.col("split") == F.col("_split"))).select("path", (F.col("id") - F.col("_zero")).alias("line_no"), "line")


def read_json(spark: SparkSession, path: str, default=None):
    """The document at a path (or its compressed sibling) on the driver; the default where it lacks or can't be read."""
    at = present(spark, path)
    if at is None:
        return default
    try:
        return json.loads(spark.read.text(at, wholetext=True).first()["value"])
    except (ValueError, TypeError):
        return default
