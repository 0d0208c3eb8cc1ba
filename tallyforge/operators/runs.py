"""Runs of a job: their identity, artifacts, views, token accounting, checkpoints and summaries.

Documents (run_record.json, judge.json, ...) come as JSON text, a row a run: they are read
by path expressions, so that a field that lacks is null and a broken document is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Generations of records and of token accounting that reports can read together.
SCHEMA_VERSIONS = ("1", "2")
ACCOUNTING_VERSIONS = ("per_line_v1", "per_message_v2")
ACCOUNTING_VERSION = "per_message_v2"
#: Arms in the order in which reports show them, by experiment.
ARMS = {
    "wur": ("d0-push", "d1-ptr", "d1", "d2", "d3", "d2-check", "d2-table", "d2-dist", "ctrl", "ctrl-nofile", "ctrl-np", "d1-np", "d3-np"),
    "ladder": ("E0", "E1", "E2", "E3", "E4", "E5", "E6"),
}
#: Bounds of a run's gates.
JOIN_COVERAGE, PARSE_OK = 0.99, 0.90
ARTIFACTS = {"run_record.json": "run_record", "hygiene.json": "hygiene", "reconcile.json": "reconcile", "fact_trace.jsonl": "fact_trace", "probes.jsonl": "probes"}


def field(doc: Column, path: str) -> Column:
    """The text at a path of a JSON document; null, empty and missing are all null."""
    return F.nullif(F.get_json_object(doc, f"$.{path}"), F.lit(""))


def number(doc: Column, path: str, kind: str = "bigint") -> Column:
    return F.get_json_object(doc, f"$.{path}").try_cast(kind)


def folder_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def identity_of(meta: Column, run_dir: Column) -> Column:
    """run_id, job_id, task_id, condition_id, rep: each name is looked up in the document, then its run, then its condition."""
    pick = lambda *keys: F.coalesce(*(field(meta, at + k) for k in keys for at in ("", "run.", "condition.")))
    return F.struct(
        F.coalesce(pick("run_id"), folder_name(run_dir)).alias("run_id"),
        pick("job_id").alias("job_id"),
        pick("task_id", "task").alias("task_id"),
        F.coalesce(pick("condition_id"), _text_condition(meta), pick("arm", "env_id")).alias("condition_id"),
        pick("rep", "replicate").alias("rep"),
    )


def _text_condition(meta: Column) -> Column:
    """The condition where it is a name and not an object."""
    own = F.coalesce(*(field(meta, at + "condition") for at in ("", "run.", "condition.")))
    return F.when(~own.startswith("{"), own)


def probe_plan(doc: Column) -> Column:
    """A plan's settings by name, as JSON texts; those of a nested ``plan`` override."""
    settings = lambda text: F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    outer, inner = settings(doc), settings(F.get_json_object(doc, "$.plan"))
    return F.map_concat(F.map_filter(outer, lambda k, v: ~F.map_contains_key(inner, k)), inner)


def is_path(text: Column) -> Column:
    """Whether a read's target is a path and not a piece of a command."""
    plain = (text != "") & (F.length(text) <= 80) & ~text.rlike(r"""[ '"();|&$`\n\t]""")
    return F.coalesce(plain & text.rlike(r"[./]") & ~text.startswith("-"), F.lit(False))


def model_of(model: Column, agent: Column) -> Column:
    known = F.lit(None).cast("string")
    for name in ("agy", "gemini", "claude", "codex"):
        known = F.when(agent.startswith(name), name).otherwise(known)
    return F.coalesce(F.nullif(model, F.lit("")), known, F.nullif(agent, F.lit("")), F.lit("agent"))


def collected(records: DataFrame) -> DataFrame:
    """What reports use of each readable record. Records: run_dir, doc."""
    doc, strings = F.col("doc"), "array<string>"
    listed = lambda path: F.coalesce(F.from_json(F.get_json_object(doc, path), strings), F.array().cast(strings))
    files = F.filter(F.concat(listed("$.navigation.files_read_sequence"), listed("$.navigation.files_edited")), is_path)
    return records.where(readable(doc)).select(
        "run_dir",
        F.coalesce(F.get_json_object(doc, "$.condition.env_id"), F.lit("E0")).alias("env"),
        F.coalesce(F.get_json_object(doc, "$.condition.task_id"), F.lit("t1")).alias("task"),
        model_of(field(doc, "condition.model"), F.coalesce(field(doc, "condition.agent_id"), F.lit(""))).alias("model"),
        F.coalesce(number(doc, "tokens.total_input"), F.lit(0)).alias("input"),
        files.alias("files"),
        F.coalesce(F.get_json_object(doc, "$.schema_version"), F.lit("None")).alias("schema_version"),
        F.coalesce(field(doc, "tokens.accounting_version"), F.lit("per_line_v1")).alias("accounting_version"),
        F.coalesce(field(doc, "run.experiment"), F.lit("ladder")).alias("experiment"),
    )


def readable(doc: Column) -> Column:
    return F.coalesce(F.try_parse_json(doc).isNotNull() & F.trim(doc).startswith("{"), F.lit(False))


def provenance(records: DataFrame) -> DataFrame:
    """(kind, value, n) of the generations and experiments that a job's records are of, and how many can't be read."""
    seen = collected(records).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("schema_version", "accounting_version", "experiment")))).alias("s"))
    lost = records.where(~readable(F.col("doc"))).select(F.struct(F.lit("unreadable").alias("kind"), F.lit("").alias("value")).alias("s"))
    return seen.unionByName(lost).groupBy("s.kind", "s.value").agg(F.count("*").alias("n"))


def mixing_problems(provenance_: DataFrame) -> DataFrame:
    """(problem, versions) that forbid one figure of all these records; none is as it should be."""
    of = lambda kind: F.col("kind") == kind
    odd = lambda kind, known: F.array_sort(F.collect_set(F.when(of(kind) & ~F.col("value").isin(*known), F.col("value"))))
    one = provenance_.agg(odd("schema_version", SCHEMA_VERSIONS).alias("schema"), odd("accounting_version", ACCOUNTING_VERSIONS).alias("accounting"), F.array_sort(F.collect_set(F.when(of("accounting_version"), F.col("value")))).alias("every"))
    told = lambda when, problem, versions: F.when(when, F.struct(F.lit(problem).alias("problem"), F.array_join(versions, ",").alias("versions")))
    found = F.array(told(F.size("schema") > 0, "unknown schema", "schema"), told(F.size("accounting") > 0, "unknown accounting", "accounting"), told(F.size("every") > 1, "mixed accounting", "every"))
    return one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.*")


def bundles(files: DataFrame) -> DataFrame:
    """One row a run folder with its five artifacts (null where one lacks) and its id. Files: path, text."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("run_dir"), name.alias("name"), "text").where(F.col("name").isin(*ARTIFACTS))
    by = rows.groupBy("run_dir").agg(*(F.max(F.when(F.col("name") == n, F.col("text"))).alias(c) for n, c in ARTIFACTS.items()))
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), readable)
    return by.select("run_dir", F.coalesce(field(F.col("run_record"), "run.run_id"), folder_name(F.col("run_dir"))).alias("run_id"), "run_record", "hygiene", "reconcile", lines(F.col("fact_trace")).alias("fact_trace"), lines(F.col("probes")).alias("probes"))


def run_view(records: DataFrame) -> DataFrame:
    """One wide row a run for a dashboard. Records: run_dir, doc (run_record), judge (or null).

    What a backend doesn't report is marked as unavailable, and figures that rest on it are null.
    """
    doc, judge = F.col("doc"), F.col("judge")
    n = lambda path: F.coalesce(number(doc, path), F.lit(0))
    score = F.coalesce(number(judge, "score", "double"), number(doc, "outcome.score_automated", "double"))
    wall, total = number(doc, "timing.wall_clock_seconds", "double"), n("tokens.total_input")
    orient, impl, verif = (n(f"tokens.phase_{p}_input") for p in ("orientation", "implementation", "verification"))
    curve = F.coalesce(F.from_json(F.get_json_object(doc, "$.token_curve"), "array<array<double>>"), F.array().cast("array<array<double>>"))
    heights = F.array_distinct(F.filter(F.transform(curve, lambda p: F.get(p, F.lit(1))), lambda v: v > 0))
    edited = F.size(F.coalesce(F.from_json(F.get_json_object(doc, "$.navigation.files_edited"), "array<string>"), F.array().cast("array<string>")))
    phased, calls, reads = (impl > 0) | (verif > 0), n("operations.tool_calls_total"), n("navigation.file_reads_total")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    criteria = F.coalesce(F.from_json(F.get_json_object(judge, "$.criteria"), "array<struct<id:string,met:boolean>>"), F.array().cast("array<struct<id:string,met:boolean>>"))
    return records.where(readable(doc)).select(
        F.coalesce(field(doc, "run.run_id"), folder_name(F.col("run_dir"))).alias("run_id"),
        F.coalesce(F.get_json_object(doc, "$.condition.task_id"), F.lit("t1")).alias("task"),
        F.coalesce(F.get_json_object(doc, "$.condition.env_id"), F.lit("E0")).alias("env"),
        F.coalesce(number(doc, "run.replication"), F.lit(1)).alias("rep"),
        F.coalesce(field(judge, "verdict"), field(doc, "outcome.verdict"), F.lit("error")).alias("verdict"),
        score.alias("score"),
        total.alias("input"),
        n("tokens.total_output").alias("output"),
        n("tokens.total_effective").alias("effective"),
        phased.alias("has_phase"),
        (F.size(heights) >= 2).alias("has_curve"),
        wall.isNotNull().alias("has_timing"),
        (total + n("tokens.total_output")).alias("total_token_cost"),
        F.when((total > 0) & score.isNotNull(), score / F.log2(1 + total)).alias("efficiency_ratio"),
        share(edited, reads).alias("nav_efficiency"),
        share(n("navigation.memory_reads") + n("navigation.memory_writes"), calls).alias("memory_utilization_rate"),
        F.when(phased & (total > 0), orient / total).alias("opts"),
        F.when(phased & (total > 0), n("tokens.context_acquisition") / total).alias("cac_ratio"),
        F.when(wall > 0, n("operations.replanning_events") / (wall / 3600)).alias("replanning_rate"),
        F.size(criteria).alias("n_criteria"),
        F.size(F.filter(criteria, lambda c: F.coalesce(c["met"], F.lit(False)))).alias("n_met"),
    )


def by_environment(views: DataFrame, baseline: str = "E0") -> DataFrame:
    """Counts, acceptance, cost, scores and cost relative to the baseline's mean for the same task, by environment."""
    from tallyforge.operators.telemetry import normalised, upper_median

    accepted = F.count_if(F.col("verdict") == "accepted")
    mean = lambda c: F.avg(c).alias(f"{c}_mean")
    by = views.groupBy("env").agg(F.count("*").alias("n"), accepted.alias("accepted"), (accepted / F.count("*")).alias("accept_rate"), mean("input"), upper_median("input").alias("input_median"), mean("effective"), mean("score"), mean("efficiency_ratio"), mean("nav_efficiency"))
    norm = normalised(views.withColumnRenamed("task", "task_id"), "input", baseline, "env").select(F.col("env").alias("of_env"), F.col("ratio").alias("norm_mean"))
    return by.join(norm, F.col("env") == F.col("of_env"), "left").drop("of_env")


def by_task(views: DataFrame) -> DataFrame:
    return views.groupBy("task").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.avg("score").alias("score_mean"), F.avg("input").alias("input_mean"))


def pareto_front(environments: DataFrame) -> DataFrame:
    """Environments that none other beats in acceptance at no more cost. A row an environment, held against each other."""
    e = environments.select("env", "effective_mean", "accept_rate")
    o = e.toDF("o_env", "o_cost", "o_rate")
    better = (F.col("o_cost") <= F.col("effective_mean")) & (F.col("o_rate") >= F.col("accept_rate")) & ((F.col("o_cost") < F.col("effective_mean")) | (F.col("o_rate") > F.col("accept_rate")))
    return e.join(o, better, "left_anti")


def job_totals(views: DataFrame, job: str = "job_id") -> DataFrame:
    """Runs, acceptance and tokens of every job and, where the job is null and ``level`` 1, of all."""
    accepted = F.count_if(F.col("verdict") == "accepted")
    return views.rollup(job).agg(F.grouping_id().alias("level"), F.count("*").alias("n_runs"), accepted.alias("accepted"), (accepted / F.count("*")).alias("accept_rate"), F.countDistinct("task").alias("n_tasks"), *(F.sum(c).alias(f"tokens_{c}") for c in ("input", "effective", "output")))


# tokens


def token_accounting(usages: DataFrame, results: DataFrame) -> DataFrame:
    """Totals of a run's terminal results, the sums by message, and how they differ.

    Usages: run_id, seq, message_id and results: run_id, k, cost_usd, tool_uses, each with input_tokens, cache_read,
    cache_creation, output_tokens. The first usage of a message counts; a result's usage is its own turn's, while its cost accumulates.
    """
    inputs = sum((F.coalesce(c, F.lit(0)) for c in ("cache_read", "cache_creation")), F.coalesce("input_tokens", F.lit(0)))
    output = F.coalesce("output_tokens", F.lit(0))
    once = usages.groupBy("run_id", "message_id").agg(F.min_by(F.struct(inputs.alias("i"), output.alias("o")), "seq").alias("u"))
    said = once.groupBy("run_id").agg(F.sum("u.i").alias("deduped_input"), F.sum("u.o").alias("deduped_output_stream"), F.count("*").alias("distinct_message_ids"))
    each = results.select("run_id", "k", inputs.alias("i"), output.alias("o"), "cost_usd", "tool_uses")
    ends = each.groupBy(F.col("run_id").alias("_run")).agg(F.sum("i").alias("result_input_sum"), F.sum("o").alias("result_output_sum"), F.max_by("i", "k").alias("result_input_last"), F.max_by("o", "k").alias("result_output_last"), F.max_by("cost_usd", F.when(F.col("cost_usd").isNotNull(), F.col("k"))).alias("cost_usd"), F.count("*").alias("n_results"), F.array_sort(F.collect_list(F.struct("k", F.col("i").alias("input"), F.col("o").alias("output"), "cost_usd", "tool_uses"))).alias("per_result"))
    both = said.join(ends, F.col("run_id") == F.col("_run"), "full_outer").select(F.coalesce("run_id", "_run").alias("run_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("deduped_input", "deduped_output_stream", "distinct_message_ids", "n_results", "result_input_sum", "result_output_sum", "result_input_last", "result_output_last")), "cost_usd", "per_result")
    delta = (F.col("deduped_input") - F.col("result_input_sum")).alias("dedupe_delta_input"), (F.col("deduped_output_stream") - F.col("result_output_sum")).alias("dedupe_delta_output")
    return both.select("*", *delta, (F.col("deduped_input") == F.col("result_input_sum")).alias("dedupe_equals_result_input"), (F.col("deduped_output_stream") != F.col("result_output_sum")).alias("stream_output_unreliable"))


def token_problems(records: DataFrame) -> DataFrame:
    """(run_id, problem) of records whose totals may not be pooled. Records: run_id, accounting_version, dedupe_delta_input, dedupe_delta_output."""
    found = [F.when(~F.col("accounting_version").eqNullSafe(F.lit(ACCOUNTING_VERSION)), "accounting_version"), *(F.when(F.col(c) != 0, c) for c in ("dedupe_delta_input", "dedupe_delta_output"))]
    return records.select("run_id", F.explode(F.filter(F.array(*found), lambda p: p.isNotNull())).alias("problem"))


# checkpoints and summaries


def probe_summary(events: DataFrame) -> DataFrame:
    """Checkpoints sent and answered, resumes, and the distinct messages and calls of their turns, by run.

    Events: run_id, kind (null is a probe), outcome, turn_message_ids, tool_use_ids. A run without rows has no row: that it was not probed
    is not that nothing was sent.
    """
    resume = F.coalesce(F.nullif("kind", F.lit("")), F.lit("probe")) == "resume"
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))), lambda x: x != "")))
    return events.groupBy("run_id").agg(F.count_if(~resume).alias("sent"), F.count_if(~resume & (F.col("outcome") == "answered")).alias("answered"), F.count_if(resume).alias("resumes"), ids("turn_message_ids").alias("message_ids"), ids("tool_use_ids").alias("tool_use_ids"))


def trace_summary(trace: DataFrame) -> DataFrame:
    """Counts of a run's fact rows: alarms, those that count, and each read status."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    status = lambda s: F.count_if(F.col("read_status") == s).alias(f"n_{s}")
    return trace.groupBy("run_id").agg(F.count("*").alias("n_rows"), yes("ordering_violation"), yes("confabulation"), yes("unexplained_possession"), yes("quarantined"), yes("analyzable"), *(status(s) for s in ("read", "not_read", "unknown", "read_error")))


def run_gates(runs: DataFrame) -> DataFrame:
    """(run_id, gate, value, threshold, passed): the seven gates of each run.

    Runs: run_id, join_coverage, max_tool_uses, dedupe_delta_input, dedupe_delta_output, n_unknown_visible, n_probes, n_parse_ok, n_refused, n_facts.
    """
    parse = F.try_divide("n_parse_ok", F.nullif("n_probes", F.lit(0)))
    off = F.coalesce(F.abs("dedupe_delta_input"), F.lit(0)) + F.coalesce(F.abs("dedupe_delta_output"), F.lit(0))
    known = F.col("dedupe_delta_input").isNotNull() & F.col("dedupe_delta_output").isNotNull()
    gate = lambda name, value, threshold, passed: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))
    c = F.col
    gates = F.array(
        gate("join_coverage", c("join_coverage"), JOIN_COVERAGE, c("join_coverage") >= JOIN_COVERAGE),
        gate("pacing_one_tool_call_per_message", c("max_tool_uses"), 1, c("max_tool_uses") <= 1),
        gate("deduped_tokens_equal_result_usage", F.when(known, off), 0, known & (off == 0)),
        gate("channel_enum_closed", c("n_unknown_visible"), 0, c("n_unknown_visible") == 0),
        gate("probe_parse_ok", parse, PARSE_OK, parse.isNull() | (parse >= PARSE_OK)),
        gate("probe_refused", c("n_refused"), 0, c("n_refused") == 0),
        gate("fact_cards_loaded", c("n_facts"), 1, c("n_facts") >= 1),
    )
    return runs.select("run_id", F.explode(gates).alias("g")).select("run_id", "g.*")


def runs_ok(gates: DataFrame) -> DataFrame:
    """Whether all gates of a run passed, and which didn't."""
    return gates.groupBy("run_id").agg(F.bool_and("passed").alias("ok"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failed"))


# order and labels


def arm_rank(arm: Column, experiment: str) -> Column:
    """Where reports show an arm: the design's order first, then by name."""
    place = F.array_position(F.array(*(F.lit(a) for a in ARMS["wur" if experiment == "wur" else "ladder"])), arm)
    return F.struct(F.when(place > 0, place).otherwise(F.lit(1 << 30).cast("bigint")).alias("place"), arm.alias("name"))


def environment_rank(env: Column) -> Column:
    """``E<n>`` by number, then other names."""
    numbered = env.rlike(r"^[Ee]\d+$")
    return F.struct((~numbered).alias("other"), F.when(numbered, F.substring(env, 2, 1 << 30).try_cast("int")).alias("n"), F.when(~numbered, env).alias("name"))


def ordered_arms(rows: DataFrame, arm: str, experiment: str) -> DataFrame:
    """(arm, position) of the arms that rows have. A table of arms, so one window holds it."""
    from pyspark.sql import Window

    arms = rows.select(arm).distinct()
    return arms.select(arm, F.row_number().over(Window.orderBy(arm_rank(F.col(arm), experiment))).alias("position"))


def file_access_by_arm(collected_: DataFrame, top: int = 20) -> DataFrame:
    """(path, arm, mean accesses a run) of the files accessed most, ties by name; an arm without access has none."""
    runs = collected_.groupBy(F.col("env").alias("of_env")).agg(F.count("*").alias("runs"))
    reads = collected_.select("env", F.explode("files").alias("path")).groupBy("path", "env").agg(F.count("*").alias("n"))
    most = reads.groupBy(F.col("path").alias("of_path")).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "of_path").limit(top)
    rows = reads.join(F.broadcast(most), F.col("path") == F.col("of_path")).join(runs, F.col("env") == F.col("of_env"))  # ``top`` rows
    return rows.select("path", "env", (F.col("n") / F.col("runs")).alias("mean_accesses"), "total")


def accounting_label(version: Column) -> Column:
    """A version as figures name it: totals of the oldest are inflated."""
    v = F.coalesce(F.nullif(version, F.lit("")), F.lit("per_line_v1"))
    return F.when(v == "per_line_v1", F.concat(v, F.lit(" (INFLATED, V7)"))).otherwise(v)


def json_object(text: Column) -> Column:
    """The JSON object of a reply: of a fenced block, else from the first brace to the last; null if it can't be read."""
    t = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    outer = F.when((start > 0) & t.contains("}") & (end > start), F.substr(t, start, end - start + 1))
    found = F.coalesce(fenced, outer)
    # a reader of one value would pass over what follows it; as the one entry of a list it may have no rest
    return F.when(F.json_array_length(F.concat(F.lit("["), found, F.lit("]"))) == 1, found)


def normal_criteria(criteria: DataFrame) -> DataFrame:
    """Criteria with defaults for what they lack. Criteria: pack, position (from 1), id, kind, command, expect_on_base, description, criterion."""
    id_ = F.coalesce("id", F.concat(F.lit("C"), F.col("position").cast("string")))
    kind = F.coalesce("kind", F.when(F.coalesce("command", F.lit("")) != "", "mechanical").otherwise("llm"))
    return criteria.select("pack", "position", id_.alias("id"), kind.alias("kind"), "command", F.coalesce("expect_on_base", F.lit("fail")).alias("expect_on_base"), F.coalesce("description", "criterion", id_).alias("description"))


# proofs of detectors


#: Cases that a pack needs at least, and fires that leave it weak.
REFERENCES, NEAR_MISSES, WEAK_FIRES = 3, 2, 1


def truth_table(cases: DataFrame) -> DataFrame:
    """Cases with whether each came out as it must, and what is wrong with it.

    Cases: fact_id, case_id, kind (reference, near_miss, ...), fired, eligible, allow_ineligible, error.
    A reference must fire where it has a site; a near miss must have a site and not fire.
    """
    fired, eligible = F.coalesce("fired", F.lit(False)), F.coalesce("eligible", F.lit(False))
    expected = F.col("kind") == "reference"
    ok = F.col("error").isNull() & F.when(expected, fired & eligible).otherwise(~fired & (eligible | F.coalesce("allow_ineligible", F.lit(False))))
    problem = F.when(F.col("error").isNotNull(), "error").when(expected, "reference did not fire").when(fired, "near miss fired").otherwise("near miss had no site")
    return cases.select("fact_id", "case_id", "kind", "fired", "eligible", "error", expected.alias("expected_fired"), ok.alias("ok"), F.when(~ok, problem).alias("problem"))


def verified_packs(table: DataFrame) -> DataFrame:
    """(fact_id, n_reference, n_near_miss, n_problems, separates): whether a detector tells compliance from what looks like it."""
    by = table.groupBy("fact_id").agg(F.count_if(F.col("kind") == "reference").alias("n_reference"), F.count_if(F.col("kind") == "near_miss").alias("n_near_miss"), F.count("problem").alias("n_wrong"))
    few = (F.col("n_reference") < REFERENCES).cast("int") + (F.col("n_near_miss") < NEAR_MISSES).cast("int")
    return by.select("fact_id", "n_reference", "n_near_miss", (F.col("n_wrong") + few).alias("n_problems"), (F.col("n_wrong") + few == 0).alias("separates"))


def prior_checks(cases: DataFrame) -> DataFrame:
    """Whether a detector fires where nobody was told: on the pristine tree (kind prior_base), on other finished work, on near misses.

    Status pass, weak (one fire) or n_a, and the disposition: a pack with too few near misses is rejected.
    """
    fired = F.coalesce("fired", F.lit(False))
    base, near = F.col("kind") == "prior_base", F.col("kind") == "near_miss"
    by = cases.where(base | near | (F.col("kind") == "prior_workspace")).groupBy("fact_id").agg(F.count("*").alias("n_checked"), F.count_if(fired).alias("n_fires"), F.count("error").alias("n_errors"), F.count_if(near).alias("near"), (~F.bool_or(base & (fired | F.col("error").isNotNull()))).alias("gate1_ok"), (~F.bool_or(~base & (fired | F.col("error").isNotNull()))).alias("gate1b_ok"))
    enough = F.col("near") >= NEAR_MISSES
    status = F.when(~enough, "n_a").when(F.col("n_fires") == 0, "pass").when(F.col("n_fires") <= WEAK_FIRES, "weak").otherwise("n_a")
    disposition = F.when(~enough, "reject").when(F.col("n_fires") == 0, "admit").when(F.col("n_fires") <= WEAK_FIRES, "admit_weak").otherwise("reject")
    return by.select("fact_id", "n_checked", "n_fires", "n_errors", "gate1_ok", "gate1b_ok", (F.col("n_fires") / F.col("n_checked")).alias("control_fire_rate"), status.alias("prior_check_status"), disposition.alias("disposition"))


# texts that must not change


def with_token(text: Column, token: Column) -> Column:
    """A registry's text with its token in place; one that asks for a token that isn't minted is an error."""
    missing = F.raise_error(F.concat(F.lit("no token is minted for: "), F.substring(text, 1, 60))).cast("string")
    return F.when(~F.contains(text, F.lit("{nonce}")), text).when(token.isNotNull(), F.replace(text, F.lit("{nonce}"), token)).otherwise(missing)


def frozen_hashes(texts: DataFrame) -> DataFrame:
    """(name, sha256) of texts that runs are compared under. Texts: name, text."""
    return texts.select(F.concat("name", F.lit("_sha256")).alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def changed_texts(texts: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name, problem) of texts that differ from their recorded hash, have none, or are gone."""
    now, then = frozen_hashes(texts), recorded.select(F.col("name").alias("of"), F.col("sha256").alias("was"))
    both = now.join(then, F.col("name") == F.col("of"), "full_outer")
    problem = F.when(F.col("name").isNull(), "gone").when(F.col("of").isNull(), "not recorded").when(F.col("sha256") != F.col("was"), "changed")
    return both.select(F.coalesce("name", "of").alias("name"), problem.alias("problem")).where("problem is not null")


def undigested(regions: DataFrame, visible: str = "model_visible", digested: str = "digested") -> DataFrame:
    """``regions``, or an error at the first visible one whose text was already replaced by a digest: tokens are looked for before."""
    bad = F.coalesce(F.col(visible), F.lit(False)) & F.coalesce(F.col(digested), F.lit(False))
    seen = F.when(bad, F.raise_error(F.lit("a visible region was digested before it was scanned")).cast("boolean")).otherwise(F.lit(True))
    return regions.where(seen)
