"""One row a run and fact: was it available, read, mentioned, used, kept; and does the row count.

Every step is a conditional expression over aggregates that were joined once; the
order of the conditions is the precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import tools as T


def available(meta: Column, factor: Column, token: Column) -> Column:
    return F.coalesce(meta, factor, F.coalesce(token, F.lit("")) != "")


def basis(meta: Column, arm: Column, channel: Column) -> Column:
    return F.coalesce(meta, F.when((arm == "d0-push") | (channel == "push"), "manifest_canary").otherwise("event_stream"))


def exposure_flags(exposure: DataFrame) -> DataFrame:
    """By run and fact: inbound and thinking hits, the first of each, echoes, the first exact and the first counted hit."""
    inbound = F.col("inbound") & F.col("counts_toward_read")
    thinking = F.col("channel") == "self_thinking"
    echo = F.col("channel").isin("self_text", "tool_input", "probe_answer")
    at = F.struct("seq", "region_idx")
    pick = F.struct("seq", "channel", "bytes_before")
    return exposure.groupBy("run_id", "fact_id").agg(
        F.bool_or(inbound).alias("has_inbound"), F.bool_or(thinking).alias("has_thinking"), F.bool_or(echo).alias("echoed"), F.min(F.when(inbound, F.col("seq"))).alias("inbound_seq"), F.min(F.when(thinking, F.col("seq"))).alias("thinking_seq"),
        F.min_by(F.when(F.col("inbound") & (F.col("match_form") == "exact"), pick), F.when(F.col("inbound") & (F.col("match_form") == "exact"), at)).alias("first_exact"), F.min_by(F.when(F.col("counts_toward_read"), pick), F.when(F.col("counts_toward_read"), at)).alias("first_counted"),
    )


def read_status() -> Column:
    """canary, read, not available, read error, cut short, else not read."""
    canary = F.col("exposure_basis") == "manifest_canary"
    return F.when(canary | F.col("has_inbound") | F.col("has_thinking"), "read").when(~F.col("available"), "not_read").when(F.col("error_on_target"), "read_error").when(F.col("cut_on_target"), "unknown").otherwise("not_read")


def mention_runs(probes: DataFrame) -> DataFrame:
    """By run: first and last mention, the leading streak, lapse before first use, horizon; over probes with a reply.

    Probes: run_id, probe_idx, sent_seq, observed, mentioned, first_used_seq.
    """
    seen = probes.where("observed")
    # what holds for a whole run is a row a run, joined back: no run is one task's work
    firsts = seen.groupBy(F.col("run_id").alias("_run")).agg(F.min(F.when(F.col("mentioned"), F.col("probe_idx"))).alias("i0"), F.min(F.when(F.col("sent_seq") > F.col("first_used_seq"), F.col("probe_idx"))).alias("use_idx"))
    rows = seen.join(firsts, F.col("run_id") == F.col("_run")).drop("_run")
    after = ~F.col("mentioned") & (F.col("probe_idx") > F.col("i0"))
    stops = rows.groupBy(F.col("run_id").alias("_run")).agg(F.min(F.when(after, F.col("probe_idx"))).alias("stop"))
    rows = rows.join(stops, F.col("run_id") == F.col("_run")).drop("_run")
    early = after & (F.col("use_idx").isNull() | (F.col("probe_idx") < F.col("use_idx")))
    return rows.groupBy("run_id").agg(F.count("*").alias("n_probes_observed"), F.bool_or("mentioned").alias("ever_mention"), F.min("i0").alias("first_mention_probe"), F.max(F.when(F.col("mentioned"), F.col("probe_idx"))).alias("last_mention_probe"), F.min(F.when(F.col("mentioned"), F.col("sent_seq"))).alias("first_mention_seq"), F.nullif(F.count_if(F.col("mentioned") & (F.col("probe_idx") >= F.col("i0")) & (F.col("stop").isNull() | (F.col("probe_idx") < F.col("stop")))), F.lit(0)).alias("mention_run_length"), F.min("use_idx").alias("first_use_probe_index"), (F.min(F.when(early, F.col("probe_idx"))) - F.min("i0")).alias("lapse_probe_index"), (F.max("probe_idx") - F.min("i0")).alias("at_risk_horizon"))


def censoring_reason() -> Column:
    return F.when(~F.coalesce("ever_mention", F.lit(False)), "never_mentioned").when(F.col("lapse_probe_index").isNotNull(), F.lit(None).cast("string")).when(F.col("first_use_probe_index").isNotNull(), "post_discharge").when(F.coalesce("run_completed", F.lit(False)), "administrative").otherwise("truncated_run")


def probe_integrity() -> Column:
    return F.when(F.coalesce("sidechain_barriers", F.lit(0)) > 0, "sidechain_barrier").when(F.coalesce("superseded", F.lit(0)) > 0, "superseded_answers").when(F.col("parse_ok_rate") < 0.90, "parse_degraded").otherwise("ok")


def quarantine_reason() -> Column:
    """All that hold, joined by +; null if none does."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    confab = ~F.col("available") & no("ever_mention")
    order = no("read") & no("ever_mention") & F.coalesce(F.col("first_exposure_seq") >= F.col("first_mention_seq"), F.lit(False))
    broken = ~F.col("available") & (no("read") | (F.col("read_status") != "not_read") | no("has_inbound") | no("unexplained_possession") | no("ever_mention")) & ~confab
    return F.nullif(F.concat_ws("+", F.when(no("unexplained_possession"), "unexplained_possession"), F.when(order, "ordering_violation"), F.when(confab, "confabulation"), F.when(broken, "control_invariant_broken")), F.lit(""))


def exclusion_reason() -> Column:
    """The first that holds; null means the row counts."""
    q = F.coalesce("quarantine_reason", F.lit(""))
    return F.when(~F.coalesce("plant_ok", F.lit(True)), "plant_missing").when(~F.coalesce("hygiene_ok", F.lit(True)), "hygiene_violation").when(F.coalesce("max_tool_uses", F.lit(1)) > 1, "pacing_failed").when(F.coalesce("join_coverage", F.lit(1.0)) < 0.99, "join_coverage_low").when(q.contains("unexplained_possession"), "unexplained_possession").when(q.contains("ordering_violation"), "ordering_violation").when(q.contains("confabulation"), "confabulation").when(F.col("probe_integrity") == "sidechain_barrier", "probe_integrity")


def fact_trace(runs: DataFrame, exposure: DataFrame, mentions: DataFrame) -> DataFrame:
    """Runs (with fact_id, factors, gates, use verdicts) joined with their exposure and mentions, and judged."""
    e = exposure_flags(exposure).withColumnsRenamed({"run_id": "_e_run", "fact_id": "_e_fact"})
    m = mentions.withColumnRenamed("run_id", "_m_run")
    rows = runs.join(e, (F.col("run_id") == F.col("_e_run")) & (F.col("fact_id") == F.col("_e_fact")), "left").join(m, F.col("run_id") == F.col("_m_run"), "left").drop("_e_run", "_e_fact", "_m_run")
    rows = rows.fillna(False, ["has_inbound", "has_thinking", "echoed", "ever_mention"])
    rows = rows.withColumn("available", available(F.col("meta_available"), F.col("factor_present"), F.col("token"))).withColumn("exposure_basis", basis(F.col("meta_basis"), F.col("condition_id"), F.col("factor_channel")))
    rows = rows.withColumn("read_status", read_status()).withColumn("read", F.when(F.col("read_status") == "read", True).when(F.col("read_status") == "not_read", False))
    canary = F.col("exposure_basis") == "manifest_canary"
    rows = rows.withColumn("read_inbound_only", F.when(canary, True).when(F.col("has_inbound"), True).when(F.col("read_status").isin("unknown", "read_error"), F.lit(None).cast("boolean")).otherwise(False))
    rows = rows.withColumn("unexplained_possession", F.col("has_thinking") & ~F.coalesce(F.col("inbound_seq") < F.col("thinking_seq"), F.lit(False)) & ~canary)
    first = F.when(~canary, F.coalesce("first_exact", F.when(F.coalesce("read", F.lit(False)), F.col("first_counted"))))
    rows = rows.withColumn("first_exposure_seq", first["seq"]).withColumn("exposure_channel", first["channel"]).withColumn("first_exposure_bytes_before", first["bytes_before"])
    rows = rows.withColumn("censoring_reason", censoring_reason()).withColumn("probe_integrity", probe_integrity()).withColumn("quarantine_reason", quarantine_reason()).withColumn("quarantined", F.col("quarantine_reason").isNotNull()).withColumn("exclusion_reason", exclusion_reason())
    return rows.withColumn("analyzable", F.col("exclusion_reason").isNull()).drop("first_exact", "first_counted")


def targets_fact_file(tool: Column, path: Column, command: Column, planted: str) -> Column:
    """Whether a call could have shown the planted file: reads of it, searches over its folder, shell words that name it."""
    name = planted.rsplit("/", 1)[-1]
    folder = planted.rsplit("/", 1)[0] if "/" in planted else ""
    shown = F.coalesce(path, F.lit(""))
    return F.coalesce(F.when(tool == "Read", shown.endswith(planted) | (T.basename(shown) == name)).when(tool.isin("Grep", "Glob"), (shown == "") | (shown == ".") | F.lit(planted).startswith(shown) | shown.endswith(folder)).when(tool == "Bash", F.contains(F.coalesce(command, F.lit("")), F.lit(name))).otherwise(False), F.lit(False))


def opened_fact_file(tool: Column, path: Column, command: Column, planted: str) -> Column:
    name = planted.rsplit("/", 1)[-1]
    verb = F.coalesce(command, F.lit("")).rlike(r"\b(?:cat|sed|head|tail|less|more|nl|awk)\b[^|;&]*" + name.replace(".", r"\."))
    return F.coalesce(F.when(tool == "Read", F.coalesce(path, F.lit("")).endswith(planted)).when(tool == "Bash", verb).otherwise(False), F.lit(False))
