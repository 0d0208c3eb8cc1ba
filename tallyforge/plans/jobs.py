"""Queries of a job's runs, charts, round trips and transcripts, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import shared
from tallyforge.operators import chart as C
from tallyforge.operators import runs as RN
from tallyforge.operators import telemetry as TM
from tallyforge.plans import frames, ledger, logs
from tallyforge.plans.statistics import rounded
from tallyforge.sources import ledgers as S
from tallyforge.sources import transcripts as TS

#: A run a user, from the user's events.
_BASE = """
SELECT user_id AS u, concat('/job/runs/u', user_id) AS run_dir, cast(count(*) AS bigint) AS n, cast(sum(k) AS bigint) AS s, cast(min(k) AS bigint) AS lo, cast(max(k) AS bigint) AS hi, cast(count(DISTINCT k % 7) AS bigint) AS d
FROM (SELECT *, {k} AS k FROM {events}) AS e GROUP BY user_id
"""
BASE = frames._sql(_BASE, "duckdb")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(frames._sql(_BASE, "spark", sf_dir))


def _when(condition: str, value: str):
    return F.expr(f"CASE WHEN {condition} THEN {value} END")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_dir, doc, judge: records of several generations; one in thirteen can't be read."""
    e = F.expr
    agent = e("CASE u % 5 WHEN 0 THEN 'codex-x' WHEN 1 THEN 'claude-y' WHEN 2 THEN 'gemini-z' WHEN 3 THEN 'other' ELSE '' END")
    doc = F.to_json(
        F.struct(
            e("CASE u % 10 WHEN 0 THEN '3' WHEN 1 THEN '1' ELSE '2' END").alias("schema_version"),
            F.struct(e("concat('run-', u)").alias("run_id"), e("u % 3 + 1").alias("replication"), _when("u % 6 = 0", "'wur'").alias("experiment")).alias("run"),
            F.struct(_when("u % 11 <> 0", "concat('E', u % 12)").alias("env_id"), e("concat('t', u % 4)").alias("task_id"), _when("u % 3 = 0", "'m1'").alias("model"), agent.alias("agent_id")).alias("condition"),
            F.struct(e("s").alias("total_input"), e("n").alias("total_output"), e("s - n").alias("total_effective"), _when("u % 4 <> 0", "'per_message_v2'").alias("accounting_version"), e("lo").alias("phase_orientation_input"), e("u % 2 * hi").alias("phase_implementation_input"), e("hi").alias("context_acquisition")).alias("tokens"),
            F.struct(_when("u % 7 <> 0", "n * 10").alias("wall_clock_seconds")).alias("timing"),
            F.struct(e("d").alias("file_reads_total"), e("u % 3").alias("memory_reads"), e("array(concat('src/f', lo, '.py'), 'grep -n x', 'a.md', 'noslash')").alias("files_read_sequence"), e("array(concat('src/f', hi, '.py'), '-v.x')").alias("files_edited")).alias("navigation"),
            F.struct(e("n").alias("tool_calls_total"), e("u % 5").alias("replanning_events")).alias("operations"),
            e("array(array(1, s), array(2, IF(u % 9 = 0, s, s + 1)))").alias("token_curve"),
        )
    )
    judge = F.when(F.expr("u % 8 <> 0"), F.to_json(F.struct(e("CASE u % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'partial' ELSE 'rejected' END").alias("verdict"), e("(u % 3) / 2.0D").alias("score"), e("array(named_struct('id', 'C1', 'met', u % 2 = 0), named_struct('id', 'C2', 'met', true))").alias("criteria"))))
    return base(spark, sf_dir).select("u", "run_dir", F.when(F.expr("u % 13 = 5"), F.lit("{broken")).otherwise(doc).alias("doc"), judge.alias("judge"))


def on_records(f):
    return lambda spark, sf_dir: rounded(f(records(spark, sf_dir)))


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by documents that keep their names in different places."""
    b = base(spark, sf_dir).withColumn("shape", F.expr("u % 5"))
    docs = ('{"run_id":"top","task":"t9","condition":"d1","rep":2}', '{"run":{"run_id":"inner","job_id":"j1","task_id":"t2"},"condition":{"env_id":"E3","replicate":"4"}}', '{"run_id":"","run":{"task_id":""},"condition":{"task_id":"t5","arm":"ctrl"}}', "not json", None)
    doc = F.element_at(F.array(*(F.lit(d) for d in docs)), F.col("shape").cast("int") + 1)
    return b.select("u", RN.identity_of(doc, F.concat("run_dir", F.lit("/"))).alias("i")).select("u", "i.*")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr("""CASE u % 4 WHEN 0 THEN concat('{"budget":', u, ',"salt":"s","plan":{"budget":7,"lo":1}}') WHEN 1 THEN concat('{"budget":', u, '}') WHEN 2 THEN '[1]' END""")
    p = base(spark, sf_dir).select("u", RN.probe_plan(doc).alias("p"))
    return p.select("u", F.try_element_at("p", F.lit("budget")).alias("budget"), F.try_element_at("p", F.lit("lo")).alias("lo"), F.try_element_at("p", F.lit("salt")).alias("salt"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of runs as files, not all of each."""
    r = records(spark, sf_dir)
    file = lambda name, text: F.struct(F.concat("run_dir", F.lit(f"/{name}")).alias("path"), text.alias("text"))
    own = F.array(file("run_record.json", F.col("doc")), file("probes.jsonl", F.expr("repeat('{\"parse_ok\":true}\\nodd\\n\\n', cast(u % 3 as int))")), file("notes.txt", F.lit("x")))
    some = F.when(F.expr("u % 4 = 1"), F.array(file("hygiene.json", F.lit('{"ok":true}')))).otherwise(F.array().cast("array<struct<path:string,text:string>>"))
    return r.select(F.explode(F.concat(own, some)).alias("f")).select("f.*")


def _probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs.flat(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "resume").when(F.col("event_type") == "view", F.lit(None)).otherwise("probe")
    return e.select("run_id", kind.alias("kind"), F.expr("CASE k % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'refused' WHEN 2 THEN 'superseded' END").alias("outcome"), F.expr("CASE WHEN k % 3 <> 0 THEN array(message_id, concat('x', k % 5)) END").alias("turn_message_ids"), F.expr("array(concat('id', k % 4), '')").alias("tool_use_ids"))


def _probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RN.probe_summary(_probe_events(spark, sf_dir)).select("run_id", "sent", "answered", "resumes", F.array_join("message_ids", "|").alias("message_ids"), F.array_join("tool_use_ids", "|").alias("tool_use_ids"))


def _usages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = logs.flat(spark, sf_dir)
    said = e.where("role = 'assistant' and message_id <> ''").select("run_id", "seq", "message_id", F.col("tokens_in").alias("input_tokens"), F.when(F.col("k") % 2 == 0, F.col("cache_read")).alias("cache_read"), F.col("cache_write").alias("cache_creation"), F.col("tokens_out").alias("output_tokens"))
    ends = e.where("event_type = 'purchase'").select("run_id", F.col("seq").alias("k"), F.when(F.col("k") % 3 != 0, F.col("k") / 100).alias("cost_usd"), F.lit(1).alias("tool_uses"), (F.col("tokens_in") * 2).alias("input_tokens"), F.col("cache_read"), F.lit(None).cast("bigint").alias("cache_creation"), F.col("tokens_out").alias("output_tokens"))
    return said, ends


def _accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(RN.token_accounting(*_usages(spark, sf_dir)).withColumn("n_listed", F.coalesce(F.size("per_result"), F.lit(0))).drop("per_result"))


def _token_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return RN.token_problems(b.select(F.expr("concat('u', u)").alias("run_id"), _when("u % 3 <> 0", "'per_message_v2'").alias("accounting_version"), _when("u % 4 <> 0", "lo").alias("dedupe_delta_input"), F.expr("hi % 2").alias("dedupe_delta_output")))


def _trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.trace(spark, sf_dir)
    status = F.when(F.col("read"), "read").when(~F.col("read"), F.when(F.col("event_id") % 9 == 0, "read_error").otherwise("not_read")).otherwise("unknown")
    return t.select(F.col("task_id").alias("run_id"), status.alias("read_status"), (F.col("event_id") % 31 == 0).alias("ordering_violation"), F.col("echoed").alias("confabulation"), "unexplained_possession", "quarantined", "analyzable")


def _run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    runs = b.select(F.expr("concat('u', u)").alias("run_id"), F.expr("(100 - u % 3) / 100.0D").alias("join_coverage"), F.expr("1 + u % 2").alias("max_tool_uses"), _when("u % 5 <> 0", "u % 4 - 1").alias("dedupe_delta_input"), F.lit(0).alias("dedupe_delta_output"), F.expr("u % 7 - u % 7").alias("n_unknown_visible"), F.expr("u % 6").alias("n_probes"), F.expr("u % 6 - (u % 6) % 2").alias("n_parse_ok"), F.expr("u % 11 - u % 11 + u % 2 * 0").alias("n_refused"), F.expr("u % 3").alias("n_facts"))
    return RN.run_gates(runs)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of forty packs from the labels."""
    v = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return v.select(F.expr("concat('f', doc_id % 40)").alias("fact_id"), F.expr("concat('c', doc_id)").alias("case_id"), F.expr("CASE doc_id % 7 WHEN 0 THEN 'near_miss' WHEN 1 THEN 'near_miss' WHEN 2 THEN 'prior_base' WHEN 3 THEN 'prior_workspace' ELSE 'reference' END").alias("kind"), F.expr("CASE WHEN doc_id % 7 < 4 THEN toxic = 1 AND doc_id % 2 = 0 ELSE quality = 1 OR doc_id % 40 < 30 END").alias("fired"), F.expr("doc_id % 13 <> 0").alias("eligible"), F.expr("doc_id % 2 = 0").alias("allow_ineligible"), _when("doc_id % 101 = 0", "'broke'").alias("error"))


def _json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict in replies of six shapes, with each turn's own text round it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    body = F.expr("""concat('{"verdicts":[{"id":"C', turn, '"}],"n":', conv_id, '}')""")
    shape = F.expr("pmod(conv_id + turn, 6)")
    fence = lambda tag: F.concat("t", F.lit(f"\n```{tag}\n"), body, F.lit("\n``` "), F.col("t"))
    reply = F.when(shape == 0, fence("json")).when(shape == 1, fence("")).when(shape == 2, F.concat("t", body, F.col("t"))).when(shape == 3, F.concat(body, F.lit(" } odd"))).when(shape == 4, F.col("t"))
    found = c.select("conv_id", "turn", reply.alias("reply")).select("conv_id", "turn", RN.json_object(F.col("reply")).alias("o"))
    return found.select("conv_id", "turn", F.get_json_object("o", "$.verdicts[0].id").alias("id"), F.get_json_object("o", "$.n").alias("n"))


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion for every order, each without some of its fields."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("position"), _when("o_orderkey % 3 = 0", "concat('K', o_orderkey)").alias("id"), _when("o_orderkey % 5 = 0", "'llm'").alias("kind"), _when("o_orderkey % 2 = 0", "'pytest'").alias("command"), _when("o_orderkey % 7 = 0", "'pass'").alias("expect_on_base"), _when("o_orderkey % 4 = 0", "o_orderpriority").alias("description"), _when("o_orderkey % 4 = 1", "o_orderstatus").alias("criterion"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.concat(F.lit("ask {nonce} of "), F.col("n_name")).alias("text"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat(F.lit("ask {nonce} of "), F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 0, " now").otherwise(""))
    return RN.frozen_hashes(n.where("n_nationkey % 7 <> 1").select(F.when(F.col("n_nationkey") == 3, "old").otherwise(F.col("n_name")).alias("name"), text.alias("text")))


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's chart with codes that a chart may not have among them."""
    odd = spark.createDataFrame([("assets", False), ("assets.receivable", False), ("", False), ("assets..x", False), ("assets.a b", False), ("misc.x", True), ("assets", True)], "code string, closed boolean")
    return ledger.chart(spark, sf_dir).unionByName(odd).select("code", F.lit("").alias("name"), F.lit("usd").alias("currency"), "closed")


def on_chart(f):
    return lambda spark, sf_dir: rounded(f(_chart(spark, sf_dir)))


def _sums(p: DataFrame) -> DataFrame:
    """By account and currency: counts, amounts, and a sum of hashes over every column of the rows."""
    none = F.array().cast("array<string>")
    tags = F.array_join(F.array_sort(F.array_union(F.coalesce("txn_tags", none), F.coalesce("post_tags", none))), " ")
    told = F.concat_ws("|", F.col("date").cast("string"), F.coalesce("ref", F.lit("")), F.col("description"), tags, F.col("account"), F.col("amount_minor").cast("string"), F.col("currency"))
    digest = F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("bigint")
    return p.groupBy("account", "currency").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("amount_minor"), F.countDistinct("txn_id").alias("n_transactions"), F.sum(digest).alias("digest"))


def _spoken(p: DataFrame) -> DataFrame:
    """Descriptions with the marks that formats quote: commas, quotes and, for every seventh transaction, a line's end."""
    return p.withColumn("description", F.concat(F.col("description"), F.when(F.col("txn_id") % 7 == 0, F.lit(', "so"\nto say')).when(F.col("txn_id") % 7 == 1, F.lit(', "so"')).otherwise(F.lit(""))))


def _csv_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings written as CSV and read again; a file's consecutive rows of one head are a transaction."""
    at = shared.path(spark, "postings-csv")
    S.write_postings_csv(_spoken(ledger.postings(spark, sf_dir)), at, "gzip")
    return rounded(_sums(S.read_postings_csv(spark, at)).drop("n_transactions"))


def _json_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions written as lines of JSON under the export's head, and read again."""
    at = shared.path(spark, "transactions-json")
    rows = S.export_envelope(_spoken(ledger.postings_by_order(spark, sf_dir)), generated_at="2024-01-01T00:00:00", source_system="tables")
    rows.select(F.col("json").alias("value")).write.text(at, compression="gzip")
    return rounded(_sums(S.read_transactions_json(spark, at)))


def _text_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions written in the text format and parsed again, every other one with its last amount left out."""
    at = shared.path(spark, "ledger-text")
    text = S.ledger_text(ledger.postings_by_order(spark, sf_dir)).select(F.col("text").alias("value"))
    blank = F.regexp_replace("value", r"(\n {4}\S+) +[-0-9.,]+ [A-Z]{3}([^\n]*)$", "$1$2")
    text = text.withColumn("value", F.when((F.pmod(F.xxhash64("value"), F.lit(2)) == 0) & (F.size(F.split("value", "\n")) > 2), blank).otherwise(F.col("value")))
    text.write.option("lineSep", "\n\n").text(at, compression="gzip")
    return rounded(_sums(S.read_ledger(spark, at)))


def _log(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every event as a line of a log of the given dialect."""
    e = logs.flat(spark, sf_dir)
    use = "CASE WHEN tool IS NOT NULL THEN concat('{\"type\":\"tool_use\",\"name\":\"', tool, '\",\"id\":\"i', seq, '\",\"input\":{\"file_path\":\"', file_path, '\"}}') ELSE '{\"type\":\"text\",\"text\":\"hm\"}' END"
    lines = {
        "messages": f"""concat('{{"type":"', role, '","message":{{"id":"', message_id, '","role":"', role, '","content":[', {use}, '],"usage":{{"input_tokens":', tokens_in, ',"cache_read_input_tokens":', cache_read, ',"cache_creation_input_tokens":', cache_write, ',"output_tokens":', tokens_out, '}}}}}}')""",
        "items": """CASE event_type WHEN 'signup' THEN concat('{"type":"item.completed","item":{"id":"i","type":"command_execution","command":"', command, '"}}') WHEN 'purchase' THEN concat('{"type":"item.completed","item":{"id":"i","type":"file_change","changes":[{"path":"', file_path, '"},{"path":""}]}}') WHEN 'view' THEN concat('{"type":"turn.completed","usage":{"input_tokens":', tokens_in, ',"cached_input_tokens":', cache_read, ',"output_tokens":', tokens_out, '}}') WHEN 'click' THEN '{"type":"item.completed","item":{"type":"agent_message","text":"done"}}' ELSE '{"type":"item.started"}' END""",
        "cumulative": """CASE event_type WHEN 'view' THEN concat('{"type":"user","id":"q', seq, '","content":"x"}') WHEN 'error' THEN '{"sessionId":"h"}' ELSE concat('{"type":"gemini","id":"g', seq, '","tokens":{"input":', tokens_in, ',"cached":', cache_read, ',"output":', tokens_out, '},"toolCalls":[{"name":"read_file","args":{"file_path":"', file_path, '"}}]}') END""",
        "steps": """CASE event_type WHEN 'view' THEN '{"type":"USER_INPUT","content":"q"}' WHEN 'error' THEN '{"type":"CHECKPOINT"}' ELSE concat('{"type":"PLANNER_RESPONSE","tool_calls":[{"name":"view_file","args":{"AbsolutePath":"', file_path, '"}},{"name":"run_command","args":{"CommandLine":"', command, '"}}]}') END""",
    }
    return e.select("run_id", F.col("seq").cast("bigint").alias("line_no"), F.expr(lines[kind]).alias("line"))


def _events_of(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = getattr(TS, kind)(_log(spark, sf_dir, kind))
        flat = e.select("run_id", "role", *TM.TOKENS, F.size("tools").alias("uses"), F.filter("tools", lambda t: t["name"] == "Read").alias("reads"))
        return rounded(flat.groupBy("run_id", "role").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in TM.TOKENS), F.sum("uses").alias("n_tools"), F.sum(F.size("reads")).alias("n_reads")))

    return run


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of runs whose backends report their own in two forms, or not at all."""
    b = base(spark, sf_dir).withColumn("run_id", F.expr("concat('u', u)"))
    tokens = b.select("run_id", F.col("s").alias("total_input"), F.col("n").alias("total_output"), F.col("lo").alias("cache_read"), F.col("hi").alias("cache_write"), (F.col("s") + F.col("n")).alias("total_effective"))
    own = F.expr("""concat('{"stats":{"models":{"a":{"tokens":{"input":', lo, ',"cached":', hi, ',"candidates":5}},"b":{"tokens":{"prompt":', s, ',"cached":', lo, '}}}}}')""")
    docs = b.where("u % 3 <> 0").select("run_id", F.expr("CASE u % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'none' ELSE 'a' END").alias("agent_id"), F.when(F.expr("u % 7 <> 0"), own).otherwise("{}").alias("doc"))
    return TM.overlaid_tokens(tokens, TM.stdout_totals(docs))


QUERIES = {
    "overlaid_tokens": lambda s, d: rounded(_overlaid(s, d)),
    "job_runs": on_records(lambda r: RN.collected(r).select("run_dir", "env", "task", "model", "input", F.array_join("files", "|").alias("files"), "schema_version", "accounting_version", "experiment")),
    "job_provenance": on_records(RN.provenance),
    "job_mixing_problems": on_records(lambda r: RN.mixing_problems(RN.provenance(r))),
    "run_views": on_records(RN.run_view),
    "views_by_environment": on_records(lambda r: RN.by_environment(RN.run_view(r))),
    "views_by_task": on_records(lambda r: RN.by_task(RN.run_view(r))),
    "pareto_front": on_records(lambda r: RN.pareto_front(RN.by_environment(RN.run_view(r)))),
    "job_totals": on_records(lambda r: RN.job_totals(RN.run_view(r).withColumn("job_id", F.concat(F.lit("j"), F.length("run_id") % 3)))),
    "file_access_by_arm": on_records(lambda r: RN.file_access_by_arm(RN.collected(r))),
    "arm_order": lambda s, d: RN.ordered_arms(frames.trace(s, d), "condition_id", "wur"),
    "environment_order": on_records(lambda r: RN.collected(r).select("env").distinct().select("env", F.to_json(RN.environment_rank(F.col("env"))).alias("rank"))),
    "accounting_labels": on_records(lambda r: RN.collected(r).groupBy(RN.accounting_label(F.col("accounting_version")).alias("label")).agg(F.count("*").alias("n"))),
    "identities": lambda s, d: rounded(_identities(s, d)),
    "probe_plans": lambda s, d: rounded(_plans(s, d)),
    "run_bundles": lambda s, d: rounded(RN.bundles(_files(s, d)).select("run_id", F.col("hygiene").isNotNull().alias("has_hygiene"), F.col("reconcile").isNotNull().alias("has_reconcile"), F.size("probes").alias("n_probes"), F.size("fact_trace").alias("n_facts"))),
    "probe_summary": lambda s, d: rounded(_probe_summary(s, d)),
    "token_accounting": _accounting,
    "token_problems": lambda s, d: rounded(_token_problems(s, d)),
    "trace_summary": lambda s, d: rounded(RN.trace_summary(_trace_rows(s, d))),
    "run_gates": lambda s, d: rounded(_run_gates(s, d)),
    "runs_ok": lambda s, d: rounded(RN.runs_ok(_run_gates(s, d))),
    "truth_table": lambda s, d: rounded(RN.truth_table(_cases(s, d)).select("fact_id", "case_id", "ok", "problem")),
    "verified_packs": lambda s, d: rounded(RN.verified_packs(RN.truth_table(_cases(s, d)))),
    "prior_checks": lambda s, d: rounded(RN.prior_checks(_cases(s, d))),
    "json_objects": lambda s, d: rounded(_json_objects(s, d)),
    "normal_criteria": lambda s, d: rounded(RN.normal_criteria(_criteria(s, d))),
    "frozen_hashes": lambda s, d: RN.frozen_hashes(_texts(s, d)),
    "changed_texts": lambda s, d: RN.changed_texts(_texts(s, d), _recorded(s, d)),
    "texts_with_tokens": lambda s, d: _texts(s, d).select("name", RN.with_token(F.col("text"), F.lit("ZQ-4KM7TXP2")).alias("text")),
    "chart_parts": on_chart(lambda c: C.with_parts(c)),
    "chart_of_type": on_chart(lambda c: C.of_type(c, "income").select("code")),
    "chart_children": on_chart(lambda c: C.children(c, "assets").select("code")),
    "chart_descendants": on_chart(lambda c: C.descendants(c, "assets").select("code")),
    "chart_roots": on_chart(lambda c: C.roots(c).select("code", "closed")),
    "chart_open": on_chart(lambda c: C.open_accounts(c).groupBy("code").agg(F.count("*").alias("n"))),
    "chart_missing": lambda s, d: rounded(C.missing(_chart(s, d), ledger.postings(s, d))),
    "chart_child_counts": on_chart(C.child_counts),
    "chart_problems": on_chart(C.chart_problems),
    "posting_problems": ledger.on_postings(lambda p: C.posting_problems(p.withColumn("account", F.when(F.col("ordinal") % 1009 == 0, " ").otherwise(F.col("account"))).withColumn("amount_minor", F.when(F.col("ordinal") % 997 != 0, F.col("amount_minor"))))),
    "account_sides": ledger.on_postings(C.sides),
    "csv_round_trip": _csv_trip,
    "json_round_trip": _json_trip,
    "text_round_trip": _text_trip,
    "log_messages": _events_of("messages"),
    "log_items": _events_of("items"),
    "log_cumulative": _events_of("cumulative"),
    "log_steps": _events_of("steps"),
}

_B = f"WITH b AS ({BASE})"
_R = f"""{_B}, r AS (SELECT *, CASE WHEN u % 11 = 0 THEN 'E0' ELSE 'E' || (u % 12) END AS env, 't' || (u % 4) AS task, CASE WHEN u % 3 = 0 THEN 'm1' ELSE CASE u % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'other' ELSE 'agent' END END AS model,
  CASE u % 10 WHEN 0 THEN '3' WHEN 1 THEN '1' ELSE '2' END AS schema_version, CASE WHEN u % 4 = 0 THEN 'per_line_v1' ELSE 'per_message_v2' END AS accounting_version, CASE WHEN u % 6 = 0 THEN 'wur' ELSE 'ladder' END AS experiment, 'src/f' || lo || '.py' AS f1, 'src/f' || hi || '.py' AS f2 FROM b WHERE u % 13 <> 5)"""
_PROV = f"{_R}, p AS (SELECT 'schema_version' AS kind, schema_version AS value FROM r UNION ALL SELECT 'accounting_version', accounting_version FROM r UNION ALL SELECT 'experiment', experiment FROM r UNION ALL SELECT 'unreadable', '' FROM b WHERE u % 13 = 5), q AS (SELECT kind, value, count(*) AS n FROM p GROUP BY ALL)"
_G = f"""{_B}, g AS (SELECT 'u' || u AS run_id, unnest([
  {{'gate': 'join_coverage', 'value': (100 - u % 3) / 100.0, 'threshold': 0.99, 'passed': u % 3 < 2}}, {{'gate': 'pacing_one_tool_call_per_message', 'value': 1.0 + u % 2, 'threshold': 1.0, 'passed': u % 2 = 0}},
  {{'gate': 'deduped_tokens_equal_result_usage', 'value': CASE WHEN u % 5 <> 0 THEN abs(u % 4 - 1)::DOUBLE END, 'threshold': 0.0, 'passed': u % 5 <> 0 AND u % 4 = 1}}, {{'gate': 'channel_enum_closed', 'value': 0.0, 'threshold': 0.0, 'passed': true}},
  {{'gate': 'probe_parse_ok', 'value': CASE WHEN u % 6 > 0 THEN (u % 6 - (u % 6) % 2) / (u % 6) END, 'threshold': 0.9, 'passed': u % 6 = 0 OR (u % 6) % 2 = 0}}, {{'gate': 'probe_refused', 'value': 0.0, 'threshold': 0.0, 'passed': true}},
  {{'gate': 'fact_cards_loaded', 'value': (u % 3)::DOUBLE, 'threshold': 1.0, 'passed': u % 3 >= 1}}]) AS x FROM b), gates AS (SELECT run_id, x.gate AS gate, round(x.value, 6) AS value, x.threshold AS threshold, x.passed AS passed FROM g)"""
_CASE = """WITH c AS (SELECT 'f' || (doc_id % 40) AS fact_id, 'c' || doc_id AS case_id, CASE WHEN doc_id % 7 < 2 THEN 'near_miss' WHEN doc_id % 7 = 2 THEN 'prior_base' WHEN doc_id % 7 = 3 THEN 'prior_workspace' ELSE 'reference' END AS kind,
  coalesce(CASE WHEN doc_id % 7 < 4 THEN toxic = 1 AND doc_id % 2 = 0 ELSE quality = 1 OR doc_id % 40 < 30 END, false) AS fired, doc_id % 13 <> 0 AS eligible, doc_id % 2 = 0 AS allowed, doc_id % 101 = 0 AS broke FROM labels),
t AS (SELECT *, NOT broke AND CASE WHEN kind = 'reference' THEN fired AND eligible ELSE NOT fired AND (eligible OR allowed) END AS ok FROM c),
tt AS (SELECT *, CASE WHEN ok THEN NULL WHEN broke THEN 'error' WHEN kind = 'reference' THEN 'reference did not fire' WHEN fired THEN 'near miss fired' ELSE 'near miss had no site' END AS problem FROM t)"""
_P = f"WITH p AS ({frames.POSTINGS})"
_CH = f"""{_P}, listed AS (SELECT 'assets.receivable.n' || n_nationkey AS code, n_nationkey % 5 = 0 AS closed FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT DISTINCT 'income.' || lower(c_mktsegment) || '.' || st, false FROM customer, (VALUES ('f'), ('o')) s(st)),
ch AS (SELECT * FROM listed UNION ALL SELECT * FROM (VALUES ('assets', false), ('assets.receivable', false), ('', false), ('assets..x', false), ('assets.a b', false), ('misc.x', true), ('assets', true)) o(code, closed))"""
_TYPED = "CASE lower(split_part(code, '.', 1)) WHEN 'assets' THEN 'asset' WHEN 'income' THEN 'income' END"
_TOLD = "('0x' || substr(md5(concat_ws('|', {date}::VARCHAR, coalesce({ref}, ''), {said}, {tags} || CASE WHEN amount_minor < 0 THEN ' sale' ELSE '' END, account, amount_minor::VARCHAR, currency)), 1, 8))::BIGINT"
_SPOKEN = "{said} || CASE txn_id % 7 WHEN 0 THEN ', \"so\"' || chr(10) || 'to say' WHEN 1 THEN ', \"so\"' ELSE '' END"
_OF_TXN = dict(date="min(date) OVER t", ref="min(ref) OVER t", tags="min(lower(tag)) OVER t")
_SUMMED = "SELECT account, currency, count(*) AS n, sum(amount_minor)::BIGINT AS amount_minor{more}, sum(told)::BIGINT AS digest FROM x GROUP BY ALL"


def _trip_sql(more: str = ", count(DISTINCT txn_id) AS n_transactions", **columns: str) -> str:
    return f"{_P}, x AS (SELECT *, {_TOLD.format(**columns)} AS told FROM p WINDOW t AS (PARTITION BY txn_id)) {_SUMMED.format(more=more)}"


_L = f"WITH e AS ({logs.EVENTS})"
_LOGGED = "GROUP BY run_id, role"

_V = f"""{_R}, v AS (SELECT *, 'run-' || u AS run_id, CASE WHEN u % 8 = 0 THEN 'error' ELSE CASE u % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'partial' ELSE 'rejected' END END AS verdict, CASE WHEN u % 8 <> 0 THEN u % 3 / 2.0 END AS score FROM r)"""
_ENVS = f"""{_V}, bl AS (SELECT task, avg(s) AS m FROM v WHERE env = 'E0' AND s <> 0 GROUP BY 1), nm AS (SELECT env, avg(s / m) AS q FROM v JOIN bl USING (task) WHERE s <> 0 AND m <> 0 GROUP BY 1),
en AS (SELECT env, count(*) AS n, count(*) FILTER (verdict = 'accepted') AS accepted, round(count(*) FILTER (verdict = 'accepted') / count(*), 6) AS accept_rate, round(avg(s), 6) AS input_mean, list_sort(list(s))[count(*) // 2 + 1] AS input_median, round(avg(s - n), 6) AS effective_mean, round(avg(score), 6) AS score_mean, round(avg(CASE WHEN s > 0 THEN score / log2(1 + s) END), 6) AS efficiency_ratio_mean, round(avg(2.0 / d), 6) AS nav_efficiency_mean FROM v GROUP BY 1)"""
ORACLE_SQL = {
    "views_by_environment": f"{_ENVS} SELECT en.*, round(q, 6) AS norm_mean FROM en LEFT JOIN nm USING (env)",
    "views_by_task": f"{_V} SELECT task, count(*) AS total, count(*) FILTER (verdict = 'accepted') AS accepted, round(avg(score), 6) AS score_mean, round(avg(s), 6) AS input_mean FROM v GROUP BY 1",
    "pareto_front": f"{_ENVS} SELECT env, effective_mean, accept_rate FROM en a WHERE NOT EXISTS (SELECT 1 FROM en b WHERE b.effective_mean <= a.effective_mean AND b.accept_rate >= a.accept_rate AND (b.effective_mean < a.effective_mean OR b.accept_rate > a.accept_rate))",
    "job_totals": f"{_V}, j AS (SELECT *, 'j' || (length(run_id) % 3) AS job_id FROM v) SELECT job_id, grouping(job_id)::BIGINT AS level, count(*) AS n_runs, count(*) FILTER (verdict = 'accepted') AS accepted, round(count(*) FILTER (verdict = 'accepted') / count(*), 6) AS accept_rate, count(DISTINCT task) AS n_tasks, sum(s)::BIGINT AS tokens_input, sum(s - n)::BIGINT AS tokens_effective, sum(n)::BIGINT AS tokens_output FROM j GROUP BY ROLLUP (job_id)",
    "overlaid_tokens": f"{_B}, o AS (SELECT *, u % 3 <> 0 AND u % 7 <> 0 AS own, CASE WHEN u % 4 = 0 THEN s ELSE lo + hi END AS i, CASE WHEN u % 4 = 0 THEN lo ELSE hi END AS c, CASE WHEN u % 4 = 0 THEN 0 ELSE 5 END AS t FROM b) SELECT 'u' || u AS run_id, CASE WHEN own THEN i ELSE s END AS total_input, CASE WHEN own THEN t ELSE n END AS total_output, CASE WHEN own THEN c ELSE lo END AS cache_read, CASE WHEN own THEN 0 ELSE hi END AS cache_write, CASE WHEN own THEN i - c * 9 // 10 + t ELSE s + n END AS total_effective FROM o",
    "job_runs": f"{_R} SELECT run_dir, env, task, model, s AS input, f1 || '|a.md|' || f2 AS files, schema_version, accounting_version, experiment FROM r",
    "job_provenance": f"{_PROV} SELECT * FROM q",
    "job_mixing_problems": f"{_PROV} SELECT 'unknown schema' AS problem, '3' AS versions WHERE EXISTS (SELECT 1 FROM q WHERE kind = 'schema_version' AND value = '3') UNION ALL SELECT 'mixed accounting', string_agg(value, ',' ORDER BY value) FROM q WHERE kind = 'accounting_version' HAVING count(*) > 1",
    "run_views": f"""{_R}, v AS (SELECT *, CASE WHEN u % 8 <> 0 THEN u % 3 / 2.0 END AS score, u % 2 * hi > 0 AS ph, CASE WHEN u % 7 <> 0 THEN n * 10.0 END AS wall FROM r)
SELECT 'run-' || u AS run_id, task, env, u % 3 + 1 AS rep, CASE WHEN u % 8 = 0 THEN 'error' ELSE CASE u % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'partial' ELSE 'rejected' END END AS verdict, round(score, 6) AS score, s AS input, n AS output, s - n AS effective, ph AS has_phase, u % 9 <> 0 AND s > 0 AS has_curve, wall IS NOT NULL AS has_timing, s + n AS total_token_cost,
  round(CASE WHEN s > 0 THEN score / log2(1 + s) END, 6) AS efficiency_ratio, round(2.0 / d, 6) AS nav_efficiency, round((u % 3) / n, 6) AS memory_utilization_rate, round(CASE WHEN ph AND s > 0 THEN lo / s END, 6) AS opts, round(CASE WHEN ph AND s > 0 THEN hi / s END, 6) AS cac_ratio, round((u % 5) / (wall / 3600), 6) AS replanning_rate, CASE WHEN u % 8 = 0 THEN 0 ELSE 2 END::BIGINT AS n_criteria, CASE WHEN u % 8 = 0 THEN 0 WHEN u % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_met FROM v""",
    "file_access_by_arm": f"{_R}, a AS (SELECT env, unnest([f1, 'a.md', f2]) AS path FROM r), m AS (SELECT path, count(*) AS total FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), c AS (SELECT env, count(*) AS runs FROM r GROUP BY 1) SELECT path, env, round(count(*) / any_value(runs), 6) AS mean_accesses, any_value(total) AS total FROM a JOIN m USING (path) JOIN c USING (env) GROUP BY path, env",
    "arm_order": f"WITH t AS (SELECT DISTINCT condition_id FROM ({frames.TRACE})) SELECT condition_id, row_number() OVER (ORDER BY coalesce(nullif(list_position(['d0-push', 'd1-ptr', 'd1', 'd2', 'd3', 'd2-check', 'd2-table', 'd2-dist', 'ctrl', 'ctrl-nofile', 'ctrl-np', 'd1-np', 'd3-np'], condition_id), 0), 1000), condition_id) AS position FROM t",
    "environment_order": f"{_R} SELECT DISTINCT env, '{{\"other\":false,\"n\":' || substr(env, 2) || '}}' AS rank FROM r",
    "accounting_labels": f"{_R} SELECT CASE WHEN u % 4 = 0 THEN 'per_line_v1 (INFLATED, V7)' ELSE 'per_message_v2' END AS label, count(*) AS n FROM r GROUP BY 1",
    "identities": f"{_B} SELECT u, CASE u % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'inner' ELSE 'u' || u END AS run_id, CASE u % 5 WHEN 1 THEN 'j1' END AS job_id, CASE u % 5 WHEN 0 THEN 't9' WHEN 1 THEN 't2' WHEN 2 THEN 't5' END AS task_id, CASE u % 5 WHEN 0 THEN 'd1' WHEN 1 THEN 'E3' WHEN 2 THEN 'ctrl' END AS condition_id, CASE u % 5 WHEN 0 THEN '2' WHEN 1 THEN '4' END AS rep FROM b",
    "probe_plans": f"{_B} SELECT u, CASE u % 4 WHEN 0 THEN '7' WHEN 1 THEN u::VARCHAR END AS budget, CASE u % 4 WHEN 0 THEN '1' END AS lo, CASE u % 4 WHEN 0 THEN 's' END AS salt FROM b",
    "run_bundles": f"{_B} SELECT CASE WHEN u % 13 = 5 THEN 'u' || u ELSE 'run-' || u END AS run_id, u % 4 = 1 AS has_hygiene, false AS has_reconcile, u % 3 AS n_probes, 0::BIGINT AS n_facts FROM b",
    "probe_summary": f"""{_L}, x AS (SELECT run_id, unnest([message_id, 'x' || (k % 5)]) AS m FROM e WHERE k % 3 <> 0), y AS (SELECT run_id, array_to_string(list_sort(list(DISTINCT m) FILTER (m <> '')), '|') AS ids FROM x GROUP BY 1)
SELECT run_id, count(*) FILTER (event_type <> 'signup') AS sent, count(*) FILTER (event_type <> 'signup' AND k % 4 = 0) AS answered, count(*) FILTER (event_type = 'signup') AS resumes, coalesce(any_value(ids), '') AS message_ids, array_to_string(list_sort(list(DISTINCT 'id' || (k % 4))), '|') AS tool_use_ids FROM e LEFT JOIN y USING (run_id) GROUP BY run_id""",
    "token_accounting": f"""{_L}, f AS (SELECT run_id, message_id, arg_min(tokens_in + CASE WHEN k % 2 = 0 THEN cache_read ELSE 0 END + cache_write, seq) AS i, arg_min(tokens_out, seq) AS o FROM e WHERE role = 'assistant' AND message_id <> '' GROUP BY ALL), a AS (SELECT run_id, sum(i) AS di, sum(o) AS dout, count(*) AS m FROM f GROUP BY 1),
r AS (SELECT run_id, sum(tokens_in * 2 + cache_read) AS ri, sum(tokens_out) AS ro, arg_max(tokens_in * 2 + cache_read, seq) AS li, arg_max(tokens_out, seq) AS lo, arg_max(k / 100, seq) FILTER (k % 3 <> 0) AS cost, count(*) AS nr FROM e WHERE event_type = 'purchase' GROUP BY 1),
z AS (SELECT run_id, coalesce(di, 0)::BIGINT AS di, coalesce(dout, 0)::BIGINT AS dout, coalesce(m, 0) AS m, coalesce(ri, 0)::BIGINT AS ri, coalesce(ro, 0)::BIGINT AS ro, coalesce(li, 0)::BIGINT AS li, coalesce(lo, 0)::BIGINT AS lo, cost, coalesce(nr, 0) AS nr FROM a FULL JOIN r USING (run_id))
SELECT run_id, di AS deduped_input, dout AS deduped_output_stream, m AS distinct_message_ids, nr AS n_results, ri AS result_input_sum, ro AS result_output_sum, li AS result_input_last, lo AS result_output_last, round(cost, 6) AS cost_usd, di - ri AS dedupe_delta_input, dout - ro AS dedupe_delta_output, di = ri AS dedupe_equals_result_input, dout <> ro AS stream_output_unreliable, nr AS n_listed FROM z""",
    "token_problems": f"{_B} SELECT 'u' || u AS run_id, 'accounting_version' AS problem FROM b WHERE u % 3 = 0 UNION ALL SELECT 'u' || u, 'dedupe_delta_input' FROM b WHERE u % 4 <> 0 AND lo <> 0 UNION ALL SELECT 'u' || u, 'dedupe_delta_output' FROM b WHERE hi % 2 <> 0",
    "trace_summary": f"WITH t AS ({frames.TRACE}) SELECT task_id AS run_id, count(*) AS n_rows, count(*) FILTER (event_id % 31 = 0) AS ordering_violation, count(*) FILTER (echoed) AS confabulation, count(*) FILTER (unexplained_possession) AS unexplained_possession, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (analyzable) AS analyzable, count(*) FILTER (read) AS n_read, count(*) FILTER (NOT read AND event_id % 9 <> 0) AS n_not_read, count(*) FILTER (read IS NULL) AS n_unknown, count(*) FILTER (NOT read AND event_id % 9 = 0) AS n_read_error FROM t GROUP BY 1",
    "run_gates": f"{_G} SELECT * FROM gates",
    "runs_ok": f"{_G} SELECT run_id, bool_and(passed) AS ok, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed), '') AS failed FROM gates GROUP BY 1",
    "truth_table": f"{_CASE} SELECT fact_id, case_id, ok, problem FROM tt",
    "verified_packs": f"{_CASE}, f AS (SELECT fact_id, count(*) FILTER (kind = 'reference') AS a, count(*) FILTER (kind = 'near_miss') AS b, count(problem) AS w FROM tt GROUP BY 1) SELECT fact_id, a AS n_reference, b AS n_near_miss, w + (a < 3)::INT + (b < 2)::INT AS n_problems, w + (a < 3)::INT + (b < 2)::INT = 0 AS separates FROM f",
    "prior_checks": f"""{_CASE}, f AS (SELECT fact_id, count(*) AS n, count(*) FILTER (fired) AS k, count(*) FILTER (broke) AS e, count(*) FILTER (kind = 'near_miss') AS m, NOT bool_or(kind = 'prior_base' AND (fired OR broke)) AS g1, NOT bool_or(kind <> 'prior_base' AND (fired OR broke)) AS g1b FROM c WHERE kind <> 'reference' GROUP BY 1)
SELECT fact_id, n AS n_checked, k AS n_fires, e AS n_errors, g1 AS gate1_ok, g1b AS gate1b_ok, round(k / n, 6) AS control_fire_rate, CASE WHEN m < 2 THEN 'n_a' WHEN k = 0 THEN 'pass' WHEN k <= 1 THEN 'weak' ELSE 'n_a' END AS prior_check_status, CASE WHEN m < 2 THEN 'reject' WHEN k = 0 THEN 'admit' WHEN k <= 1 THEN 'admit_weak' ELSE 'reject' END AS disposition FROM f""",
    "json_objects": "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 < 3 THEN 'C' || turn END AS id, CASE WHEN (conv_id + turn) % 6 < 3 THEN conv_id::VARCHAR END AS n FROM conversations",
    "normal_criteria": "SELECT o_custkey AS pack, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'K' || o_orderkey ELSE 'C' || o_orderkey END AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'llm' WHEN o_orderkey % 2 = 0 THEN 'mechanical' ELSE 'llm' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'pytest' END AS command, CASE WHEN o_orderkey % 7 = 0 THEN 'pass' ELSE 'fail' END AS expect_on_base, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'K' || o_orderkey ELSE 'C' || o_orderkey END END AS description FROM orders",
    "frozen_hashes": "SELECT n_name || '_sha256' AS name, sha256('ask {nonce} of ' || n_name) AS sha256 FROM nation",
    "changed_texts": "SELECT n_name || '_sha256' AS name, CASE WHEN n_nationkey % 7 = 1 OR n_nationkey = 3 THEN 'not recorded' ELSE 'changed' END AS problem FROM nation WHERE n_nationkey % 7 = 1 OR n_nationkey = 3 OR n_nationkey % 5 = 0 UNION ALL SELECT 'old_sha256', 'gone'",
    "texts_with_tokens": "SELECT n_name AS name, 'ask ZQ-4KM7TXP2 of ' || n_name AS text FROM nation",
    "chart_parts": f"{_CH} SELECT code, split_part(code, '.', -1) AS name, 'USD' AS currency, closed, {_TYPED} AS type, CASE {_TYPED} WHEN 'asset' THEN 1 WHEN 'income' THEN -1 END::BIGINT AS normal_balance, (len(string_split(code, '.')) - 1)::BIGINT AS depth, split_part(code, '.', -1) AS leaf FROM ch",
    "chart_of_type": f"{_CH} SELECT code FROM ch WHERE code LIKE 'income%'",
    "chart_children": f"{_CH} SELECT code FROM ch WHERE code LIKE 'assets.%' AND NOT contains(substr(code, 8), '.')",
    "chart_descendants": f"{_CH} SELECT code FROM ch WHERE code LIKE 'assets.%'",
    "chart_roots": f"{_CH} SELECT code, closed FROM ch WHERE NOT contains(code, '.')",
    "chart_open": f"{_CH} SELECT code, count(*) AS n FROM ch WHERE NOT closed GROUP BY 1",
    "chart_missing": f"{_CH} SELECT DISTINCT account AS code FROM p WHERE account NOT IN (SELECT code FROM ch)",
    "chart_child_counts": f"{_CH}, s AS (SELECT string_split(code, '.') AS x FROM ch), a AS (SELECT x, unnest(range(1, len(x))) AS k FROM s) SELECT array_to_string(x[1:k], '.') AS code, count(*) FILTER (k = len(x) - 1) AS n_children, count(*) AS n_descendants FROM a GROUP BY 1",
    "chart_problems": "SELECT * FROM (VALUES ('', 'empty code'), ('assets..x', 'malformed code'), ('assets.a b', 'malformed code'), ('misc.x', 'unknown root'), ('assets', 'declared twice')) v(code, problem)",
    "posting_problems": f"{_P}, q AS (SELECT txn_id, ordinal, currency, CASE WHEN ordinal % 1009 = 0 THEN ' ' ELSE account END AS account, CASE WHEN ordinal % 997 <> 0 THEN amount_minor END AS m FROM p), w AS (SELECT txn_id, currency, min(ordinal) AS o FROM q GROUP BY ALL HAVING sum(m) <> 0) SELECT txn_id, ordinal, 'empty account' AS problem FROM q WHERE account = ' ' UNION ALL SELECT txn_id, ordinal, 'no amount' FROM q WHERE m IS NULL UNION ALL SELECT txn_id, min(o), 'unbalanced' FROM w GROUP BY 1",
    "account_sides": f"{_P} SELECT account, currency, count(*) FILTER (amount_minor > 0) AS n_debits, coalesce(sum(amount_minor) FILTER (amount_minor > 0), 0)::BIGINT AS debit_minor, count(*) FILTER (amount_minor < 0) AS n_credits, coalesce(-sum(amount_minor) FILTER (amount_minor < 0), 0)::BIGINT AS credit_minor FROM p GROUP BY ALL",
    "csv_round_trip": _trip_sql(more="", date="date", ref="ref", said=f"coalesce(nullif({_SPOKEN.format(said='description')}, ''), '(imported)')", tags="lower(tag)"),
    "json_round_trip": _trip_sql(**_OF_TXN, said=_SPOKEN.format(said="min(description) OVER t")),
    "text_round_trip": _trip_sql(**_OF_TXN, said="min(description) OVER t"),
    "log_messages": f"{_L}, d AS (SELECT *, message_id <> '' AND row_number() OVER (PARTITION BY run_id, message_id ORDER BY seq) > 1 AS dup FROM e) SELECT run_id, role, count(*) AS n, coalesce(sum(tokens_in + cache_read + cache_write) FILTER (NOT dup), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out) FILTER (NOT dup), 0)::BIGINT AS tokens_out, coalesce(sum(cache_read) FILTER (NOT dup), 0)::BIGINT AS cache_read, coalesce(sum(cache_write) FILTER (NOT dup), 0)::BIGINT AS cache_write, count(tool) AS n_tools, count(*) FILTER (tool = 'Read') AS n_reads FROM d {_LOGGED}",
    "log_items": f"{_L}, d AS (SELECT *, count(*) FILTER (event_type IN ('signup', 'purchase', 'click')) OVER (PARTITION BY run_id ORDER BY seq) AS ahead FROM e), x AS (SELECT *, event_type = 'view' AS v FROM d WHERE event_type IN ('signup', 'purchase', 'click') OR (event_type = 'view' AND ahead > 0)) SELECT run_id, 'assistant' AS role, count(*) AS n, coalesce(sum(tokens_in) FILTER (v), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out) FILTER (v), 0)::BIGINT AS tokens_out, coalesce(sum(cache_read) FILTER (v), 0)::BIGINT AS cache_read, 0::BIGINT AS cache_write, count(*) FILTER (event_type IN ('signup', 'purchase')) AS n_tools, 0::BIGINT AS n_reads FROM x GROUP BY run_id",
    "log_cumulative": f"""{_L}, g AS (SELECT *, greatest(0, tokens_in + cache_read - lag(tokens_in + cache_read, 1, 0) OVER w) AS dp, greatest(0, cache_read - lag(cache_read, 1, 0) OVER w) AS dc FROM e WHERE event_type NOT IN ('view', 'error') WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, 'assistant' AS role, count(*) AS n, sum(dp)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(dc)::BIGINT AS cache_read, 0::BIGINT AS cache_write, count(*) AS n_tools, count(*) AS n_reads FROM g GROUP BY 1 UNION ALL SELECT run_id, 'user', count(*), 0, 0, 0, 0, 0, 0 FROM e WHERE event_type = 'view' GROUP BY 1""",
    "log_steps": f"{_L} SELECT run_id, CASE WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END AS role, count(*) AS n, 0::BIGINT AS tokens_in, 0::BIGINT AS tokens_out, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write, 2 * count(*) FILTER (event_type <> 'view') AS n_tools, count(*) FILTER (event_type <> 'view') AS n_reads FROM e WHERE event_type <> 'error' GROUP BY ALL",
}
