"""From normalised events to event logs, run records and scorecards.

Normalised events: run_id, seq, ts, role, message_id, tokens_in, tokens_out,
cache_read, cache_write, tools ARRAY<STRUCT<name, input MAP, tool_use_id>>.
A run is the unit that windows and groups keep together; runs are small, many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import tools as T
from tallyforge.operators.prefix import running_count



def by_run():
    return Window.partitionBy("run_id")
TOKENS = ("tokens_in", "tokens_out", "cache_read", "cache_write")


def has_id() -> Column:
    return F.coalesce(F.col("message_id"), F.lit("")) != ""


def first_of_message(events: DataFrame) -> DataFrame:
    """``events`` with a flag: the first of its message; events without a message id all are."""
    # events without a message are no group of their own
    rank = F.row_number().over(Window.partitionBy("run_id", "message_id", F.when(~has_id(), F.col("seq"))).orderBy("seq"))
    return events.withColumn("is_first", ~has_id() | (rank == 1))


def deduped(events: DataFrame) -> DataFrame:
    """Usage once a message: later lines of it count nothing."""
    flagged = first_of_message(events)
    return flagged.select(*(F.when(F.col("is_first"), F.col(c)).otherwise(0).alias(c) if c in TOKENS else F.col(c) for c in events.columns), (~F.col("is_first")).alias("usage_duplicate"))


def event_log(events: DataFrame) -> DataFrame:
    """One row an event and tool; tokens on the first tool only, and their running sum."""
    spread = events.select("run_id", "seq", "ts", "role", *TOKENS, F.posexplode_outer("tools").alias("k", "tool"))
    first = F.coalesce(F.col("k") == 0, F.lit(True))
    name, given, command = F.col("tool.name"), F.col("tool.input")["cmd_class"], F.col("tool.input")["command"]
    rows = spread.select("run_id", "seq", F.coalesce("k", F.lit(0)).alias("k"), "ts", "role", *(F.when(first, F.col(c)).otherwise(0).alias(c) for c in TOKENS), name.alias("tool"), T.classify_tool(name, command, given).alias("tool_class"), T.summary(name, F.col("tool.input")).alias("tool_input_summary"), T.is_edit(name, given).alias("is_edit"))
    return running_count(rows, ["run_id"], "seq", ["k"], F.col("tokens_in"), "cumulative_input_tokens")


def token_curve(log: DataFrame) -> DataFrame:
    """(run_id, seq, cumulative) at each assistant event."""
    return log.where("role = 'assistant'").groupBy("run_id", "seq").agg(F.max("cumulative_input_tokens").alias("cumulative"))


def edits(log: DataFrame) -> DataFrame:
    """First and last edit of each run that has one."""
    return log.where("is_edit").groupBy("run_id").agg(F.min("seq").alias("first_edit"), F.max("seq").alias("last_edit"))


def phase() -> Column:
    """Orientation before the first edit, implementation to the last, verification after."""
    return F.when(F.col("first_edit").isNull() | (F.col("seq") < F.col("first_edit")), "orientation").when(F.col("seq") <= F.col("last_edit"), "implementation").otherwise("verification")


def phased(events: DataFrame) -> DataFrame:
    return events.join(edits(event_log(events)).withColumnRenamed("run_id", "_run"), F.col("run_id") == F.col("_run"), "left").drop("_run").withColumn("phase", phase())


def run_tokens(events: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Token totals and phase sums a run; a terminal result's totals take precedence and the difference is kept."""
    rows = phased(first_of_message(events)).where("is_first and role = 'assistant'")
    one = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("tokens_in"))), F.lit(0)).alias(p)
    t = rows.groupBy("run_id").agg(*(F.sum(c).cast("long").alias(c) for c in TOKENS), one("orientation"), one("implementation"), one("verification"))
    if results is not None:
        r = results.select(F.col("run_id").alias("_run"), *(F.col(c).alias(f"r_{c}") for c in ("total_input", "total_output", "cache_read", "cache_write")))
        t = t.join(r, F.col("run_id") == F.col("_run"), "left").drop("_run")
    else:
        t = t.select("*", *(F.lit(None).cast("long").alias(f"r_{c}") for c in ("total_input", "total_output", "cache_read", "cache_write")))
    total = F.coalesce("r_total_input", "tokens_in")
    out, read = F.coalesce("r_total_output", "tokens_out"), F.coalesce("r_cache_read", "cache_read")
    single = (F.col("orientation") == 0) & (F.col("implementation") == 0) & (total > 0)
    return t.select("run_id", total.alias("total_input"), out.alias("total_output"), read.alias("cache_read"), F.coalesce("r_cache_write", "cache_write").alias("cache_write"), (total - (read * 9 / 10).cast("long") + out).alias("total_effective"), F.when(single, total).otherwise(F.col("orientation")).alias("phase_orientation_input"), F.col("implementation").alias("phase_implementation_input"), F.when(single, 0).otherwise(F.col("verification")).alias("phase_verification_input"), (F.col("tokens_in") - F.col("r_total_input")).alias("dedupe_delta_input"), (F.col("tokens_out") - F.col("r_total_output")).alias("dedupe_delta_output"))


def overlaid_tokens(tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """``tokens`` with the totals that a backend reports itself, where it does: (run_id, total_input, total_output, cache_read).

    Such totals know no written cache, and the effective ones follow from them.
    """
    t = totals.select(F.col("run_id").alias("_run"), *(F.col(c).alias(f"o_{c}") for c in ("total_input", "total_output", "cache_read")))
    rows = tokens.join(t, F.col("run_id") == F.col("_run"), "left")
    given, read = F.col("o_total_input").isNotNull(), F.coalesce("o_cache_read", F.lit(0))
    effective = F.col("o_total_input") - (read * 9 / 10).cast("long") + F.coalesce("o_total_output", F.lit(0))
    new = {"total_input": F.col("o_total_input"), "total_output": F.coalesce("o_total_output", F.lit(0)), "cache_read": read, "cache_write": F.lit(0), "total_effective": effective}
    return rows.select(*(F.when(given, new[c]).otherwise(F.col(c)).cast("long").alias(c) if c in new else F.col(c) for c in tokens.columns))


def stdout_totals(documents: DataFrame) -> DataFrame:
    """Totals of a backend's closing statistics: (run_id, agent_id, doc), those of the agent's model or else of the first.

    The prompt has the cached tokens in it; where it isn't told, it is input and cached together.
    """
    kind = "struct<tokens:struct<prompt:bigint,input:bigint,cached:bigint,candidates:bigint>>"
    models = F.from_json(F.get_json_object("doc", "$.stats.models"), f"map<string,{kind}>")
    rows = documents.select("run_id", F.coalesce(F.try_element_at(models, F.col("agent_id")), F.get(F.map_values(models), F.lit(0)))["tokens"].alias("t")).where("t is not null")
    zero = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(0))
    return rows.select("run_id", F.coalesce("t.prompt", zero("input") + zero("cached")).alias("total_input"), zero("candidates").alias("total_output"), zero("cached").alias("cache_read"))


def run_timing(events: DataFrame) -> DataFrame:
    """Wall clock, time to the first edit, and seconds in each phase that has two stamps."""
    rows = phased(events).withColumn("t", T.parse_ts(F.col("ts"))).where("t is not null")
    span = lambda when: F.when(F.count(F.when(when, F.col("t"))) >= 2, T.seconds_between(F.min_by(F.when(when, F.col("t")), F.when(when, F.col("seq"))), F.max_by(F.when(when, F.col("t")), F.when(when, F.col("seq")))))
    at_edit = F.col("seq") == F.col("first_edit")
    return rows.groupBy("run_id").agg(span(F.lit(True)).alias("wall_clock_seconds"), T.seconds_between(F.min_by("t", "seq"), F.min_by(F.when(at_edit, F.col("t")), F.when(at_edit, F.col("seq")))).alias("time_to_first_edit_seconds"), *(span(F.col("phase") == p).alias(f"phase_{p}_seconds") for p in ("orientation", "implementation", "verification")))


def is_read() -> Column:
    return F.coalesce((F.col("tool") == "Read") | (F.col("tool_class") == "nav"), F.lit(False))


def relative(path: Column, workspace: str | None) -> Column:
    if not workspace:
        return path
    root = workspace.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def entropy(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Shannon entropy in bits of each key's counts."""
    sums = counts.groupBy(key).agg(F.sum(n).alias("t"), F.sum(F.col(n) * F.log2(n)).alias("s"))
    return sums.select(key, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def run_navigation(log: DataFrame, workspace: str | None = None) -> DataFrame:
    path = relative(F.col("tool_input_summary"), workspace)
    rows = log.withColumn("path", F.nullif(path, F.lit(""))).join(edits(log).withColumnRenamed("run_id", "_run"), F.col("run_id") == F.col("_run"), "left")
    read = is_read() & F.col("path").isNotNull()
    before = F.col("first_edit").isNull() | (F.col("seq") <= F.col("first_edit"))
    starts = lambda p: F.coalesce(F.col("path").startswith(p), F.lit(False))
    has = lambda p: F.coalesce(F.col("path").contains(p), F.lit(False))
    main = rows.groupBy("run_id").agg(F.count_if(read).alias("file_reads_total"), F.countDistinct(F.when(read, F.col("path"))).alias("file_reads_unique"), F.countDistinct(F.when(F.col("is_edit") & F.col("path").isNotNull(), F.col("path"))).alias("files_edited"), F.count_if(is_read() & starts("memory/")).alias("memory_reads"), F.count_if(F.col("is_edit") & starts("memory/")).alias("memory_writes"), F.count_if(is_read() & starts(".xo/")).alias("xo_reads"), F.coalesce(F.bool_or(is_read() & has("AGENTS.md")), F.lit(False)).alias("agents_md_read"), F.coalesce(F.bool_or(is_read() & has("PROJECT.md")), F.lit(False)).alias("project_md_read"))
    reads = rows.where(read).groupBy("run_id", "path").agg(F.count("*").alias("n"), F.count_if(before).alias("n_before"))
    every = entropy(reads, "run_id").select(F.col("run_id").alias("_a"), F.col("entropy").alias("nav_entropy"))
    early = entropy(reads.where("n_before > 0"), "run_id", "n_before").select(F.col("run_id").alias("_b"), F.col("entropy").alias("nav_entropy_pre_edit"))
    return main.join(every, F.col("run_id") == F.col("_a"), "left").join(early, F.col("run_id") == F.col("_b"), "left").drop("_a", "_b")


def read_sequence(log: DataFrame, most: int = 200) -> DataFrame:
    rows = log.where(is_read() & (F.coalesce("tool_input_summary", F.lit("")) != "")).withColumn("r", F.row_number().over(by_run().orderBy("seq", "k"))).where(F.col("r") <= most)
    return rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tool_input_summary"))), lambda x: x["tool_input_summary"]).alias("files_read_sequence"))


def run_operations(events: DataFrame, log: DataFrame) -> DataFrame:
    tool = F.col("tool")
    calls = log.groupBy("run_id").agg(F.count("tool").alias("tool_calls_total"), F.count_if(tool == "Bash").alias("bash_calls"), F.count_if(F.col("tool_class") == "search").alias("search_calls"), F.count_if(F.col("tool_class") == "git_op").alias("git_calls"), F.count_if(F.col("tool_class") == "web").alias("web_searches"), F.count_if(F.col("tool_class") == "agent").alias("agent_spawns"), F.count_if(tool.isin("TodoWrite", "ExitPlanMode")).alias("replanning_events"))
    said = events.where("role = 'assistant'").withColumn("key", F.when(has_id(), F.col("message_id")).otherwise(F.concat(F.lit("__line_"), F.col("seq").cast("string"))))
    per = said.groupBy("run_id", "key").agg(F.sum(F.size(F.coalesce("tools", F.array()))).alias("uses"), F.max(has_id()).alias("named"), F.count("*").alias("lines"))
    turns = per.groupBy("run_id").agg(F.nullif(F.count_if(F.col("named")), F.lit(0)).alias("named"), F.sum("lines").alias("lines"), F.max("uses").alias("max_tool_uses_per_message"))
    turns = turns.select(F.col("run_id").alias("_run"), F.coalesce("named", "lines").alias("turns_total"), "max_tool_uses_per_message")
    lines = events.groupBy(F.col("run_id").alias("_r")).agg(F.count("*").alias("message_count"))
    return calls.join(turns, F.col("run_id") == F.col("_run"), "left").join(lines, F.col("run_id") == F.col("_r"), "left").drop("_run", "_r")


def context_acquisition(log: DataFrame) -> DataFrame:
    """Input tokens up to the first edit; all of them if that is nothing."""
    rows = log.join(edits(log).withColumnRenamed("run_id", "_run"), F.col("run_id") == F.col("_run"), "left")
    early = F.col("first_edit").isNull() | (F.col("seq") <= F.col("first_edit"))
    return rows.groupBy("run_id").agg(F.sum(F.when(early, F.col("tokens_in")).otherwise(0)).alias("early"), F.sum("tokens_in").alias("every")).select("run_id", F.when(F.col("early") == 0, F.col("every")).otherwise(F.col("early")).alias("context_acquisition"))


def run_record(events: DataFrame, results: DataFrame | None = None, workspace: str | None = None) -> DataFrame:
    """One nested row a run: tokens, timing, navigation, operations."""
    log = event_log(deduped(events).drop("usage_duplicate"))
    parts = {"tokens": run_tokens(events, results), "timing": run_timing(events), "navigation": run_navigation(log, workspace), "operations": run_operations(events, log), "context": context_acquisition(log)}
    out = None
    for name, df in parts.items():
        one = df.select("run_id", F.struct(*(c for c in df.columns if c != "run_id")).alias(name))
        out = one if out is None else out.join(one, "run_id", "left")
    return out


# scorecards over run records


def upper_median(name: str) -> Column:
    """The element after the middle of a column's sorted values, as reports take it; counts of values are kept, not rows."""
    return F.expr(f"percentile_disc(0.500000000001D) WITHIN GROUP (ORDER BY `{name}`)")


def by_condition(runs: DataFrame, key: str = "condition_id") -> DataFrame:
    """Runs, acceptance, mean and upper-median cost by condition."""
    return runs.groupBy(key).agg(F.count("*").alias("n_runs"), F.avg(F.when(F.col("terminal_state").isNotNull(), (F.col("terminal_state") == "accepted").cast("int"))).alias("accept_rate"), F.avg("total_effective").alias("tokens_mean"), upper_median("total_effective").alias("tokens_upper_median"))


def totals(runs: DataFrame, *keys: str) -> DataFrame:
    """Counts and sums at every level of the keys, down to the grand total."""
    return runs.rollup(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n_runs"), F.sum("total_effective").alias("tokens"))


def normalised(runs: DataFrame, value: str, baseline: str, key: str = "condition_id") -> DataFrame:
    """Mean over runs of the value relative to the baseline's mean for the same task; nothing without a baseline."""
    base = runs.where((F.col(key) == baseline) & (F.col(value) != 0)).groupBy(F.col("task_id").alias("of_task")).agg(F.avg(value).alias("base"))
    rows = runs.where(F.col(value) != 0).join(base, F.col("task_id") == F.col("of_task")).where("base <> 0")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(value) / F.col("base")).alias("ratio"))


def file_access(log: DataFrame, top: int = 20) -> DataFrame:
    """The files accessed most, ties by which came first."""
    path = F.col("tool_input_summary")
    rows = log.where(is_read() & path.rlike(r"[./]") & ~path.rlike(r"\s"))
    return rows.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.min(F.struct("run_id", "seq", "k")).alias("first")).orderBy(F.desc("n"), "first").limit(top).select("path", "n")


def phase_activity(log: DataFrame) -> DataFrame:
    """Shares of tool calls before the first edit, between, and after the last."""
    rows = log.where("tool is not null").join(edits(log).withColumnRenamed("run_id", "_run"), F.col("run_id") == F.col("_run"), "left").withColumn("phase", phase())
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), *(F.avg((F.col("phase") == p).cast("int")).alias(f"{p}_share") for p in ("orientation", "implementation", "verification")))


def derived(runs: DataFrame) -> DataFrame:
    """Efficiency figures of a run view."""
    some = (F.col("phase_implementation_input") > 0) | (F.col("phase_verification_input") > 0)
    return runs.select("run_id", F.try_divide(F.col("score"), F.log2(1 + F.col("total_input"))).alias("efficiency"), F.coalesce(F.try_divide("files_edited", "file_reads_total"), F.lit(0.0)).alias("nav_efficiency"), F.try_divide(F.col("memory_reads") + F.col("memory_writes"), "tool_calls_total").alias("memory_utilization"), F.when(some, F.try_divide("phase_orientation_input", "total_input")).alias("opts"), F.when(some, F.try_divide("context_acquisition", "total_input")).alias("cac_ratio"), F.try_divide(F.col("replanning_events") * 3600, F.nullif(F.col("wall_clock_seconds"), F.lit(0.0))).alias("replanning_per_hour"))


def verdict(exit_code: Column, graded: Column, score: Column, errored: Column) -> Column:
    return F.when(exit_code == 124, "timeout").when(F.coalesce(graded, F.lit(0)) == 0, "error").when((score == 1) & (errored == 0), "accepted").when((score == 0) & (errored == 0), "rejected").otherwise("partial")


def success_of(verdict_: Column, errored: Column) -> Column:
    """Three-valued success: an error, or a partial grade with errors, is unknown."""
    v = F.lower(F.trim(verdict_))
    return F.when(v.isin("accepted", "pass", "passed", "success", "ok"), True).when(v.isin("rejected", "timeout", "fail", "failed"), False).when(v == "partial", F.when(F.coalesce(errored, F.lit(0)) == 0, False))


def job_scorecard(runs: DataFrame, baseline: str) -> dict[str, DataFrame]:
    """Tables of a job's report. Runs: run_id, task_id, condition_id, terminal_state, total_effective, accounting_version, grader_sha, regraded_state, seen (their order)."""
    accepted = F.avg(F.when(F.col("terminal_state").isNotNull(), (F.col("terminal_state") == "accepted").cast("int")))
    cost = by_condition(runs)
    base = cost.where(F.col("condition_id") == baseline).select(F.col("tokens_upper_median").alias("base"))
    return {
        "acceptance by task": runs.groupBy("task_id").agg(F.min("seen").alias("seen"), F.count("*").alias("n_runs"), accepted.alias("accept_rate")).orderBy("seen").drop("seen"),
        "cost by condition": cost.join(base, F.lit(True), "left").select("*", F.try_divide("tokens_upper_median", "base").alias("ratio")).drop("base"),  # one row
        "versions": runs.groupBy(F.coalesce("accounting_version", F.lit("unset")).alias("version")).agg(F.count("*").alias("n")),
        "graders": runs.groupBy("task_id").agg(F.countDistinct("grader_sha").alias("n_graders")),
        "regrade drift": runs.where("regraded_state is not null and regraded_state <> terminal_state").select("run_id", "terminal_state", "regraded_state"),
    }
