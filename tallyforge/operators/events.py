"""Joins and windows over ordered logs: gates, turns, probe windows, as-of lookups.

Rows: run_id, seq, kind, message_id, tool_use_id, ...; gate: run_id, line_no,
tool_use_id, barrier, decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.prefix import running_count
from tallyforge.operators.scan import count, last_known, ordinal, ranged, row_before, scanned


def gate_index(gate: DataFrame) -> DataFrame:
    """A call's first barrier, how often it fired, and the first decision that isn't allow, else the first that is."""
    odd = F.when(~F.coalesce(F.col("decision"), F.lit("allow")).eqNullSafe(F.lit("allow")), F.struct("line_no", "decision"))
    return gate.groupBy("run_id", "tool_use_id").agg(F.min_by("barrier", "line_no").alias("barrier"), F.count("*").alias("fires"), F.coalesce(F.min(odd)["decision"], F.min_by("decision", "line_no")).alias("decision"))


def gate_join(tool_uses: DataFrame, gate: DataFrame) -> DataFrame:
    """Full outer join by tool_use_id; calls that only the gate saw are numbered after the run's last."""
    g = gate_index(gate).select(F.col("run_id").alias("g_run"), F.col("tool_use_id").alias("g_id"), "barrier", "fires", "decision")
    both = tool_uses.select("run_id", "seq", "tool_use_id").join(g, (F.col("run_id") == F.col("g_run")) & (F.col("tool_use_id") == F.col("g_id")), "full_outer")
    status = F.when(F.col("g_id").isNull(), "stream_only").when(F.col("tool_use_id").isNull(), "gate_only").otherwise("joined")
    rows = both.select(F.coalesce("run_id", "g_run").alias("run_id"), "seq", F.coalesce("tool_use_id", "g_id").alias("tool_use_id"), "barrier", "fires", "decision", status.alias("join_status"))
    last = tool_uses.groupBy(F.col("run_id").alias("_run")).agg(F.max("seq").alias("_last"))
    # the gate's own calls are numbered by their ids, in ranges of them
    late = scanned(ranged(rows.where("seq is null").drop("seq"), ["run_id"], ["tool_use_id"], "_range"), ["run_id"], ["tool_use_id"], {"_late": ordinal()}, F.col("_range"))
    late = late.join(last, F.col("run_id") == F.col("_run"), "left").withColumn("seq", F.coalesce("_last", F.lit(-1)) + F.col("_late"))
    return rows.where("seq is not null").unionByName(late.select(rows.columns))


def join_coverage(joined: DataFrame) -> DataFrame:
    return joined.groupBy("run_id").agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.count_if(F.col("join_status") == "joined"), F.count("*")), F.lit(1.0)).alias("coverage"))


def turn_index(rows: DataFrame) -> DataFrame:
    """Dense index of messages by first sight; null before the first."""
    named = F.coalesce(F.col("message_id"), F.lit("")) != ""
    # rows without a message are no group of their own
    own = Window.partitionBy("run_id", "message_id", F.when(~named, F.col("seq"))).orderBy("seq")
    rows = rows.withColumn("_first", named & (F.row_number().over(own) == 1))
    return scanned(rows, ["run_id"], ["seq"], {"turn_idx": count(F.col("_first"))}).withColumn("turn_idx", F.nullif(F.col("turn_idx") - 1, F.lit(-1))).drop("_first")


def next_tool_after(points: DataFrame, tools: DataFrame) -> DataFrame:
    """Forward as-of join: for each point (run_id, at), the first tool call (run_id, seq, tool) after it.

    Both sides meet in one order of their run, scanned from its end; nothing is paired.
    """
    both = points.select("run_id", F.col("at").alias("seq"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("long").alias("tool_seq")).unionByName(tools.select("run_id", "seq", F.lit(-1).alias("side"), "tool", F.col("seq").cast("long").alias("tool_seq")))
    call = F.when(F.col("side") == -1, F.struct("tool_seq", "tool"))
    rows = scanned(both, ["run_id"], ["seq", "side", "tool_seq", "tool"], {"next": last_known(call, before=True)}, back=True)
    return rows.where("side = 0").select("run_id", F.col("seq").alias("at"), F.col("next.tool_seq").alias("next_seq"), F.col("next.tool").alias("next_tool"))


def first_sights(values: DataFrame, value: str) -> DataFrame:
    """(run_id, at, ordinal, value): each run's distinct values by first sight, ties by value, numbered from 1.

    A value counts from its first sight: a row a value, not a use.
    """
    first = values.where(F.col(value).isNotNull()).groupBy("run_id", value).agg(F.min("seq").alias("at")).select("run_id", "at", F.col(value).alias("value"))
    return scanned(first, ["run_id"], ["at", "value"], {"ordinal": ordinal()})


def prefix_sizes(points: DataFrame, values: DataFrame, value: str, name: str) -> DataFrame:
    """Prefix sets in short: for each point how many of its run's first sights (:func:`first_sights`) came up to it.

    The set of a point is the values whose ordinal isn't above the number, so the result is a row a point.
    """
    first = first_sights(values, value).select("run_id", "at", F.lit(0).alias("side"))
    both = first.unionByName(points.select("run_id", "at", F.lit(1).alias("side")).distinct())
    return scanned(both, ["run_id"], ["at", "side"], {name: count(F.col("side") == 0)}).where("side = 1").drop("side")


def seen_before(points: DataFrame, values: DataFrame, value: str, name: str) -> DataFrame:
    """Prefix sets written out: for each point, the distinct values of its run up to it, sorted.

    That is as many values as the sets hold together; :func:`prefix_sizes` has them in a number each.
    """
    sizes = prefix_sizes(points, values, value, "_size")
    first = first_sights(values, value).withColumnsRenamed({"run_id": "_run", "at": "_at"})
    held = sizes.join(first, (F.col("run_id") == F.col("_run")) & (F.col("ordinal") <= F.col("_size")), "left")
    return held.groupBy("run_id", "at").agg(F.array_sort(F.collect_list("value")).alias(name))


def probe_windows(rows: DataFrame) -> DataFrame:
    """Rows with their probe window: it opens at probe_in and closes at the answer, the next tool call or the next probe.

    Rows have kind (probe_in, tool_use, assistant, ...) and answers (whether an assistant text answers a probe).
    """
    rows = running_count(rows, ["run_id"], "seq", [], (F.col("kind") == "probe_in").cast("int"), "window_no")
    own = Window.partitionBy("run_id", "window_no")
    closer = F.when((F.col("kind") == "tool_use") | ((F.col("kind") == "assistant") & F.col("answers")), F.col("seq"))
    rows = rows.withColumn("close_seq", F.when(F.col("window_no") > 0, F.min(closer).over(own)))
    inside = (F.col("window_no") > 0) & (F.col("close_seq").isNull() | (F.col("seq") < F.col("close_seq")) | ((F.col("seq") == F.col("close_seq")) & (F.col("kind") == "assistant")))
    rows = rows.withColumn("is_probe_turn", inside)
    return rows.withColumn("is_probe_out", inside & (F.col("seq") == F.col("close_seq")))


def probe_lifecycle(probes: DataFrame) -> DataFrame:
    """Outcome of each probe: refused or answered if there is a reply, superseded if another was sent later, else unanswered."""
    last = probes.groupBy(F.col("run_id").alias("_run")).agg(F.max("sent_seq").alias("last_sent"))
    rows = probes.join(last, F.col("run_id") == F.col("_run")).drop("_run")
    outcome = F.when(F.col("raw_response").isNull(), F.when(F.col("sent_seq") < F.col("last_sent"), "superseded").otherwise("unanswered")).when(F.col("refusing") & ~F.coalesce("parse_ok", F.lit(False)), "refused").otherwise("answered")
    return rows.withColumn("outcome", outcome).drop("last_sent")


def truncation_index(signals: DataFrame) -> DataFrame:
    """How a tool's answer was cut: the last read error, else the first truncation."""
    error = F.when(F.col("kind") == "read_error", F.struct("seq", "source"))
    cut = F.when(F.col("kind") == "truncated", F.struct("seq", "source"))
    return signals.groupBy("run_id", "tool_use_id").agg(F.coalesce(F.max(error)["source"], F.min(cut)["source"]).alias("truncation_source"))


def carried_seq(rows: DataFrame) -> DataFrame:
    """A row's own seq, else its tool's, else its message's, else the last known before it."""
    known = F.coalesce("seq", "tool_seq", "message_seq")
    return scanned(rows, ["run_id"], ["line_no"], {"resolved_seq": last_known(known)})


def barrier_ordinals(gate: DataFrame) -> DataFrame:
    """1-based barrier number of each gate row and how often its key came before."""
    numbered = scanned(gate, ["run_id"], ["line_no"], {"ordinal": ordinal()})
    return scanned(numbered, ["run_id", "tool_use_id"], ["line_no"], {"repeats": ordinal()}).withColumn("repeats", F.col("repeats") - 1)


def islands(rows: DataFrame, key: str, by: str = "run_id", order: str = "seq") -> DataFrame:
    """Numbers of consecutive runs of an equal key, along ``order`` of each ``by``."""
    rows = scanned(rows, [by], [order], {"_before": row_before(F.col(key))})
    change = F.col("_before").isNull() | ~F.col(key).eqNullSafe(F.col("_before")["v"])
    return scanned(rows, [by], [order], {"island": count(change)}).drop("_before")
