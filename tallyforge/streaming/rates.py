"""The same questions over streams: windowed rates, sessions with keyed state, first-of-message usage.

Late rows are bounded by a watermark, so state is too, but for running phases without a
time, whose runs are kept.  Each query equals its batch counterpart once the stream is drained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.shared import path


def stream_of(spark: SparkSession, folder: str, schema: T.StructType, *, files: int = 1) -> DataFrame:
    """A folder of Parquet as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_rates(events: DataFrame, *, outcome: str = "hit", group: str = "condition_id", time: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Known rows, successes and unknowns by window and group."""
    x = F.col(outcome)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size).alias("w"), group).agg(F.count(x).alias("n"), F.count_if(F.coalesce(x, F.lit(False))).alias("k"), (F.count("*") - F.count(x)).alias("n_unknown"))
    return out.select(F.col("w.start").alias("window_start"), group, "n", "k", "n_unknown")


def sessions(events: DataFrame, *, key: str = "user_id", time: str = "ts", gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a key by gaps in time."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def usage_once(events: DataFrame, *, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Events whose message wasn't seen before, within the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.dropDuplicatesWithinWatermark(["run_id", "message_id"]) if events.isStreaming else rows.dropDuplicates(["run_id", "message_id"])


PHASE_STATE = "first_edit long, last_edit long, n long, before array<long>, tokens long"
PHASE_OUT = "run_id string, first_edit long, last_edit long, n long, n_before_edit long, tokens long"


def _phases(idle: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, n, before, tokens = state.get if state.exists else (-1, -1, 0, [], 0)
        # only rows before the first edit can still change what is told: it never moves to a later place
        early = [np.asarray(before, np.int64)]
        for pdf in batches:
            seq = pdf["seq"].to_numpy()
            edits = seq[pdf["is_edit"].to_numpy(bool)]
            if len(edits):
                first = int(edits.min()) if first < 0 else min(first, int(edits.min()))
                last = max(last, int(edits.max()))
            n += len(pdf)
            early.append(seq)
            tokens += int(pdf["tokens_in"].sum())
        early = np.concatenate(early)
        early = early if first < 0 else early[early < first]
        state.update((first, last, n, early.tolist(), tokens))
        if idle is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle * 1000)
        yield pd.DataFrame([(key[0], first, last, n, len(early), tokens)], columns=["run_id", "first_edit", "last_edit", "n", "n_before_edit", "tokens"])

    return run


def running_phases(log: DataFrame, *, idle: int | None = None, late: str = "2 days") -> DataFrame:
    """A run's first and last edit, events before the first, and tokens, kept as state and updated a batch at a time.

    An edit that comes late moves the first one back, and events are counted anew: their places are kept up to the
    first edit. With ``idle`` seconds (and a time ``ts``) a run that the watermark left behind by as much is dropped.
    """
    if idle is None:
        return log.groupBy("run_id").applyInPandasWithState(_phases(None), PHASE_OUT, PHASE_STATE, "update", GroupStateTimeout.NoTimeout)
    return log.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(_phases(idle), PHASE_OUT, PHASE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, *, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a stream has now, as a written table.

    Every batch is a folder of its own in the shared store, written by the executors and overwritten if
    it is tried again. Complete output is the last batch's; updates are the last of each of ``keys``.
    """
    spark = stream.sparkSession
    at = path(spark, "drained")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/n={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows")
    except AnalysisException:  # a stream without batches
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))  # one row
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    elif mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("v")).select(*keys, "v.*")
    return rows.select(*stream.columns)


def write_stream(stream: DataFrame, folder: str, checkpoint: str, *, mode: str = "append"):
    """To Parquet, exactly once: the checkpoint remembers which batches are in."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
