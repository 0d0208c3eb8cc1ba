"""Queries of fact traces, slots, proofs, reports, files and sinks, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import shared
from tallyforge.operators import design as DS
from tallyforge.operators import detectors as D
from tallyforge.operators import grading as G
from tallyforge.operators import ledger as L
from tallyforge.operators import probes as P
from tallyforge.operators import regions as RG
from tallyforge.operators import tables as TB
from tallyforge.operators import telemetry as TM
from tallyforge.operators import trace as TR
from tallyforge.plans import frames, jobs, ledger, logs, more, render
from tallyforge.plans.jobs import _when
from tallyforge.plans.statistics import rounded
from tallyforge.sources import ledgers as S


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact a user: controlled factors, exposure by rare events, mentions by views."""
    e = F.expr
    b = jobs.base(spark, sf_dir)
    runs = b.select(
        e("concat('u', u)").alias("run_id"), F.lit("f").alias("fact_id"), e("CASE u % 7 WHEN 0 THEN 'd0-push' WHEN 1 THEN 'd1' WHEN 2 THEN 'd2' WHEN 3 THEN 'd3' ELSE 'ctrl' END").alias("condition_id"), e("u % 7 < 4").alias("factor_present"),
        e("CASE WHEN u % 3 = 0 THEN u % 2 = 0 END").alias("meta_available"), e("CASE WHEN u % 13 = 0 THEN 'manifest_canary' END").alias("meta_basis"), e("CASE WHEN u % 5 <> 0 THEN 'tok' END").alias("token"), e("CASE WHEN u % 17 = 0 THEN 'push' END").alias("factor_channel"),
        e("u % 4 = 1").alias("error_on_target"), e("u % 4 = 2").alias("cut_on_target"), e("u % 2 = 0").alias("run_completed"), e("1 + CAST(u % 19 = 0 AS int)").alias("max_tool_uses"), e("CASE WHEN u % 23 = 0 THEN 0.5D ELSE 1.0D END").alias("join_coverage"), e("CASE WHEN u % 11 = 0 THEN 0.5D ELSE 1.0D END").alias("parse_ok_rate"),
        e("u % 29 <> 1").alias("plant_ok"), e("u % 31 <> 1").alias("hygiene_ok"), e("CAST(u % 37 = 1 AS int)").alias("sidechain_barriers"), e("CAST(u % 9 = 1 AS int)").alias("superseded"),
    )
    rows = logs.flat(spark, sf_dir)
    exposure = rows.where("k % 41 = 0").select("run_id", F.lit("f").alias("fact_id"), "seq", F.lit(0).alias("region_idx"), e("CASE event_type WHEN 'click' THEN 'tool_read' WHEN 'purchase' THEN 'self_thinking' WHEN 'error' THEN 'self_text' ELSE 'harness_probe' END").alias("channel"), e("CASE WHEN k % 2 = 0 THEN 'exact' ELSE 'lower' END").alias("match_form"), e("event_type = 'click'").alias("inbound"), e("event_type IN ('click', 'purchase')").alias("counts_toward_read"), (F.col("seq") * 10).alias("bytes_before"))
    t = TR.fact_trace(runs, exposure, logs._mentions(rows))
    return t.select("run_id", "available", "exposure_basis", "read_status", "read", "read_inbound_only", "unexplained_possession", "first_exposure_seq", "exposure_channel", "first_exposure_bytes_before", "echoed", "ever_mention", "censoring_reason", "probe_integrity", "quarantine_reason", "exclusion_reason", "analyzable")


def _slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with three slots each."""
    slot = lambda k: F.struct(F.expr(f"concat('fact ', k % {k + 3})").alias("fact"), F.expr(f"CASE WHEN k % 4 = {k} THEN '' ELSE file_path END").alias("source"), F.expr(f"CASE (k + {k}) % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'critical_fact' WHEN 2 THEN 'filler' WHEN 3 THEN 'distrusted' ELSE 'generic_workspace' END").alias("slot_class"), F.expr(f"CASE WHEN k % 7 <> {k} THEN (k + {k}) % 5 = 1 END").alias("match_nonce"), F.expr(f"CASE WHEN k % 3 <> 0 THEN k % 11 = {k} END").alias("match_regex"), F.expr(f"CASE WHEN k % 6 <> 1 THEN (k + {k}) % 13 = 0 END").alias("wrong_value"))
    return logs.flat(spark, sf_dir).where("event_type = 'view'").select("run_id", F.col("seq").alias("probe_idx"), F.array(*(slot(k) for k in range(3))).alias("slots"))


def _flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.flattened(_slotted(spark, sf_dir))
    return f.select("run_id", "probe_idx", "slot0_fact", "slot1_source", "slot2_slot_class", "slot0_match_nonce", "slot2_match_regex", "n_critical_fact_slots", "n_empty_slots", "n_filler_slots", "mention_nonce", "mention_regex")


def _fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs.flat(spark, sf_dir)
    said = F.expr("CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN concat('I will use ', lower(coalesce(tool, 'nothing')), ' now') WHEN 2 THEN concat('open ', upper(file_path)) WHEN 3 THEN 'think' END")
    return e.groupBy(F.expr("k % 5").alias("shape"), P.fidelity(said, F.col("tool"), F.col("file_path")).alias("agree")).agg(F.count("*").alias("n"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs.flat(spark, sf_dir)
    claim = F.expr("CASE k % 4 WHEN 0 THEN ' ' WHEN 1 THEN concat('see ', file_path) WHEN 2 THEN 'the GREP tool' ELSE 'memory' END")
    got = P.source_verified(claim, F.array(F.lit("src/f1.py"), F.lit("memory/n.md")), F.array(F.lit("Grep")))
    return e.groupBy(F.expr("k % 4").alias("shape"), got.alias("verified")).agg(F.count("*").alias("n"))


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return G.proofs(v.select(F.expr("concat('c', doc_id % 200)").alias("criterion_id"), F.expr("IF(doc_id % 3 = 0, 'base', 'reference')").alias("tree"), _when("doc_id % 17 <> 0", "quality = 1").alias("met"), F.expr("IF(doc_id % 200 < 100, 'pass', 'fail')").alias("expect_on_base")))


def _cards_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = spark.createDataFrame([("f0", "t0"), ("f1", "t1"), ("f2", "t1"), ("f3", None)], "fact_id string, task_id string")
    return G.cards_for(cards, jobs.base(spark, sf_dir).select(F.expr("concat('u', u)").alias("run_id"), F.expr("concat('t', u % 6)").alias("task_id")))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell calls of runs; the gate has those of two runs in three, some twice."""
    e = logs.flat(spark, sf_dir).where("tool = 'Bash'").select("run_id", F.concat(F.lit("id"), F.col("seq") % 50).alias("tool_use_id"), "seq", "command")
    gate = e.where("cast(substring(run_id, 2) as bigint) % 3 <> 0")
    return D.run_commands(gate, e)


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs.flat(spark, sf_dir).where("tool is not null")
    planted = "a/b.py"
    shown = F.when(F.col("k") % 3 == 0, F.lit("/w/a/b.py")).otherwise(F.col("file_path"))
    return e.groupBy("tool", TR.targets_fact_file(F.col("tool"), shown, F.col("command"), planted).alias("targets"), TR.opened_fact_file(F.col("tool"), shown, F.col("command"), planted).alias("opened")).agg(F.count("*").alias("n"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    return TM.derived(jobs.base(spark, sf_dir).select(e("concat('u', u)").alias("run_id"), e("u % 3 / 2.0D").alias("score"), e("s").alias("total_input"), e("u % 4").alias("files_edited"), e("u % 5").alias("file_reads_total"), e("lo").alias("memory_reads"), e("1").alias("memory_writes"), e("n").alias("tool_calls_total"), e("lo").alias("phase_orientation_input"), e("u % 2 * hi").alias("phase_implementation_input"), e("0").alias("phase_verification_input"), e("hi").alias("context_acquisition"), e("u % 5").alias("replanning_events"), e("u % 7 * 60.0D").alias("wall_clock_seconds")))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    return jobs.base(spark, sf_dir).select(e("concat('u', u)").alias("run_id"), e("concat('t', u % 5)").alias("task_id"), e("concat('E', u % 3)").alias("condition_id"), e("CASE u % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'partial' END").alias("terminal_state"), e("s").alias("total_effective"), _when("u % 6 <> 0", "'v2'").alias("accounting_version"), e("concat('g', u % 2)").alias("grader_sha"), e("IF(u % 8 = 0, 'rejected', NULL)").alias("regraded_state"), e("n").alias("seen"))


def on_card(name: str):
    return lambda spark, sf_dir: rounded(TM.job_scorecard(_graded(spark, sf_dir), "E0")[name])


def _run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record, a verdict and a description of every run, some of them lacking or broken."""
    e = F.expr
    record = """concat('{"tokens":{"total_input":', s, ',"total_output":', n, ',"cost_usd":', d, '.25,"accounting_version":"per_message_v2","dedupe_delta_input":', hi - lo, '},"timing":{"wall_clock_seconds":', hi, '},"operations":{"tool_calls_total":', n, ',"tool_calls_task":', n - 1, ',"probes_sent":', d, ',"probes_answered":', d - 1, '},"navigation":{"files_edited":["a.py","b.py"]}}')"""
    judge = """concat('{"verdict":"accepted","score":0.5,"battery":{"passed":', d, ',"total":7},"criteria":[{"met":true,"criterion":"c', u, ' | x","source":"s","evidence":"e"},{"criterion":"lost","error":"no"}]}')"""
    return jobs.base(spark, sf_dir).select(e("concat('u', u)").alias("run_id"), e(record).alias("record"), e(f"CASE u % 3 WHEN 0 THEN {judge} WHEN 1 THEN '{{broken' END").alias("judge"), e("""concat('{"agent_id":"a', u, '","run_dir":"', run_dir, '"}')""").alias("meta"), e("CASE WHEN u % 2 = 0 THEN ' done ' END").alias("analysis"))


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.export_envelope(ledger.postings(spark, sf_dir), generated_at="2024-01-01T00:00:00Z", source_system="books")
    head = F.col("json").startswith('{"schema"')
    return rows.groupBy(head.alias("is_header")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.json_array_length(F.get_json_object("json", "$.postings")), F.lit(0))).alias("n_postings"))


def _chart_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.path(spark, "chart-csv")
    ledger.chart(spark, sf_dir).select(F.concat(F.lit(" "), "code").alias("code"), F.lit(None).cast("string").alias("name"), F.lit("eur").alias("currency"), F.when(F.col("closed"), "Yes").alias("closed")).write.csv(at, header=True)
    return S.read_chart(spark, at)


def _rates_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings a currency has for each of another's, as decimal texts written and read again, exactly."""
    at = shared.path(spark, "rates-csv")
    n = ledger.postings(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("n"))
    every = n.agg(F.collect_list(F.struct("currency", "n")).alias("all"))  # the currencies
    pairs = n.crossJoin(F.broadcast(every)).select("currency", "n", F.explode("all").alias("o")).where("currency <> o.currency")
    rate = (F.floor(F.col("n") * 10_000 / F.col("o.n")) / 10_000).cast("decimal(20,4)").cast("string")
    pairs.select(F.concat(F.lower("currency"), F.lit(" ")).alias("base"), F.col("o.currency").alias("quote"), rate.alias("rate")).write.csv(at, header=True)
    return S.read_rates(spark, at).select("base", "quote", F.col("num").cast("bigint").alias("num"), F.col("den").cast("bigint").alias("den"))


def _tables_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame written as Parquet and as CSV, and what each gives back."""
    at = shared.path(spark, "tables")
    t = frames.trace(spark, sf_dir).select("run_id", "task_id", "condition_id", "read", "used", "analyzable")
    TB.write_tables({"trace": t}, at, csv=True)
    text = TB.typed(spark.read.csv(f"{at}/trace.csv", header=True))
    both = TB.load_table(spark, at, "trace", t.schema).withColumn("kind", F.lit("parquet")).unionByName(text.withColumn("kind", F.lit("csv")))
    lost = TB.load_table(spark, at, "nothing", t.schema).withColumn("kind", F.lit("none"))
    return both.unionByName(lost).groupBy("kind", "condition_id").agg(F.count("*").alias("n"), F.count_if("read").alias("n_read"), F.count("used").alias("n_used_known"), F.count_if(F.col("analyzable").isNull()).alias("n_unknown"))


def _files(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder with a text file for each nation and one that holds a NUL."""
    at = shared.path(spark, name)
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.concat(F.col("n_name"), F.when(F.col("n_nationkey") == 3, F.lit("\x00")).otherwise(""), F.lit(" é")).alias("value")).write.partitionBy("n_name").text(f"{at}/w")
    return f"{at}/w"


def _workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = TB.workspace_files(spark, _files(spark, sf_dir, "workspace")).where(F.col("path").endswith(".txt"))
    return files.select(F.trim("text", F.lit("\n")).alias("text"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = TB.input_manifest(spark, f"{_files(spark, sf_dir, 'inputs')}/*/*.txt")
    return files.select("length", "sha256")


def _consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return DS.arms_consistent(o.select(F.concat(F.lit("t"), F.col("o_custkey") % 300).alias("task_id"), F.concat(F.lit("d"), F.col("o_orderkey") % 3).alias("dir"), F.when(F.col("o_custkey") % 300 < 200, "same").otherwise(F.col("o_orderstatus")).alias("sha256")))


def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line on disk for every turn: attachments, answers kept on disk, reminders, sidechains, and plain messages."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.expr("""CASE pmod(conv_id + turn, 7)
      WHEN 0 THEN concat('{"type":"attachment","attachment":{"type":"odd kind","body":{"a":"t', conv_id % 2, '","b":["say \\\\"x\\\\":",3,{"c":"é"}]}}}')
      WHEN 1 THEN concat('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"k', turn - 1, '"}]},"toolUseResult":{"stdout":"abc","file":{"content":"long","numLines":1,"totalLines":', 1 + conv_id % 2, '}}}')
      WHEN 2 THEN concat('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"none"}]},"toolUseResult":{"persistedOutputPath":"/p/', turn, '","file":{"x":"y"}}}')
      WHEN 3 THEN concat('{"type":"user","message":{"content":[{"type":"text","text":"a <system-reminder>r', turn % 2, '</system-reminder> b <system-reminder>x</system-reminder>"}]}}')
      WHEN 4 THEN '{"type":"assistant","isSidechain":true,"message":{"id":"m","content":"hm"},"toolUseResult":"plain"}'
      WHEN 5 THEN '{"type":"attachment","attachmentType":"queued"}'
      ELSE concat('{"type":"assistant","message":{"content":[{"type":"tool_use","id":"k', turn, '"}]}}') END""")
    return c.select(F.concat(F.lit("c"), "conv_id").alias("run_id"), (F.col("turn") + 1).alias("line_no"), line.alias("line"))


def _only_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = more._records(spark, sf_dir)
    return RG.transcript_regions(_transcript(spark, sf_dir), stream, RG.stream_regions(stream))


def _kept_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of tools in every shape that a message may have them."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    block = F.to_json(F.struct(F.lit("text").alias("type"), F.col("t").alias("text")))
    body = F.when(F.expr("turn % 5 = 0"), F.concat(F.lit("["), block, F.lit(',{"type":"image","data":"x"},{"a":1},"tail"]'))).when(F.expr("turn % 5 = 1"), F.concat(F.lit("["), block, F.lit(","), block, F.lit("]"))).when(F.expr("turn % 5 = 2"), block).when(F.expr("turn % 5 = 3"), F.lit('{"b":2}')).when(F.expr("turn % 5 = 4"), F.concat(F.lit("plain "), "t"))
    return c.select("conv_id", "turn", RG.result_text(body).alias("text"))


QUERIES = {
    "transcript_regions": lambda s, d: rounded(_only_on_disk(s, d)),
    "transcript_signals": lambda s, d: rounded(RG.transcript_signals(_transcript(s, d))),
    "result_texts": lambda s, d: rounded(_kept_text(s, d)),
    "fact_trace": lambda s, d: rounded(_trace(s, d)),
    "slots_flattened": lambda s, d: rounded(_flattened(s, d)),
    "mention_by_probe": lambda s, d: rounded(P.mention_by_probe(_slotted(s, d))),
    "slot_precision": lambda s, d: rounded(P.slot_precision(_slotted(s, d))),
    "announced_actions": lambda s, d: rounded(_fidelity(s, d)),
    "claimed_sources": lambda s, d: rounded(_sources(s, d)),
    "criteria_proofs": lambda s, d: rounded(_proofs(s, d)),
    "cards_of_runs": lambda s, d: rounded(_cards_for(s, d)),
    "run_commands": lambda s, d: rounded(_commands(s, d)),
    "fact_file_access": lambda s, d: rounded(_touched(s, d)),
    "run_derived": lambda s, d: rounded(_derived(s, d)),
    "acceptance_by_task": on_card("acceptance by task"),
    "cost_by_condition": on_card("cost by condition"),
    "accounting_versions": on_card("versions"),
    "graders_by_task": on_card("graders"),
    "regrade_drift": on_card("regrade drift"),
    "run_reports": lambda s, d: rounded(render.run_reports(_run_documents(s, d))),
    "export_envelope": lambda s, d: rounded(_envelope(s, d)),
    "chart_round_trip": lambda s, d: rounded(_chart_trip(s, d)),
    "rates_round_trip": lambda s, d: rounded(_rates_trip(s, d)),
    "tables_round_trip": lambda s, d: rounded(_tables_trip(s, d)),
    "workspace_files": lambda s, d: rounded(_workspace(s, d)),
    "input_manifest": lambda s, d: rounded(_inputs(s, d)),
    "arms_consistent": lambda s, d: rounded(_consistent(s, d)),
    "account_statement_tail": ledger.on_postings(lambda p: L.account_statement(p, "assets.receivable.n3", limit=25)),
    "transaction_log_tail": ledger.on_postings(lambda p: L.transaction_log(p, limit=40).select("txn_id", "date", "line_no", "ref")),
}

_E = f"WITH e AS ({logs.EVENTS}), b AS ({jobs.BASE})"


def _trace_sql() -> str:
    """The trace's precedence as one query over the mentions' own."""
    mentions = logs.ORACLE_SQL["mention_runs"].removeprefix(f"WITH e AS ({logs.EVENTS})").lstrip(", ")
    ctes, _, tail = mentions.partition("\nSELECT run_id, count(*) AS n_probes_observed")
    ctes = ctes.replace(", b AS (", ", mb AS (")
    tail = tail.replace("FROM o JOIN b USING", "FROM o JOIN mb USING")
    return f"""{_E}, {ctes}, m AS (SELECT run_id, count(*) AS n_probes_observed{tail}),
x AS (SELECT run_id, seq, CASE event_type WHEN 'click' THEN 'tool_read' WHEN 'purchase' THEN 'self_thinking' WHEN 'error' THEN 'self_text' ELSE 'harness_probe' END AS channel, k % 2 = 0 AS exact, event_type = 'click' AS inbound, event_type IN ('click', 'purchase') AS counted FROM e WHERE k % 41 = 0),
f AS (SELECT run_id, bool_or(inbound) AS hi, bool_or(channel = 'self_thinking') AS ht, bool_or(channel = 'self_text') AS echoed, min(seq) FILTER (inbound) AS iseq, min(seq) FILTER (channel = 'self_thinking') AS tseq, min(seq) FILTER (inbound AND exact) AS fe, min(seq) FILTER (counted) AS fc, arg_min(channel, seq) FILTER (counted) AS fch FROM x GROUP BY 1),
r AS (SELECT b.u, 'u' || b.u AS run_id, coalesce(CASE WHEN b.u % 3 = 0 THEN b.u % 2 = 0 END, b.u % 7 < 4) AS available, CASE WHEN b.u % 13 = 0 OR b.u % 7 = 0 OR b.u % 17 = 0 THEN 'manifest_canary' ELSE 'event_stream' END AS basis FROM b),
j AS (SELECT r.*, basis = 'manifest_canary' AS canary, coalesce(hi, false) AS hi, coalesce(ht, false) AS ht, coalesce(echoed, false) AS echoed, iseq, tseq, fe, fc, fch, coalesce(ever_mention, false) AS em, first_mention_seq AS fm, first_use_probe_index AS fu, lapse_probe_index AS lp FROM r LEFT JOIN f USING (run_id) LEFT JOIN m USING (run_id)),
s AS (SELECT *, CASE WHEN canary OR hi OR ht THEN 'read' WHEN NOT available THEN 'not_read' WHEN u % 4 = 1 THEN 'read_error' WHEN u % 4 = 2 THEN 'unknown' ELSE 'not_read' END AS st, ht AND NOT coalesce(iseq < tseq, false) AND NOT canary AS up FROM j),
t AS (SELECT *, CASE st WHEN 'read' THEN true WHEN 'not_read' THEN false END AS rd, CASE WHEN canary THEN NULL WHEN fe IS NOT NULL THEN fe WHEN st = 'read' THEN fc END AS fx, CASE WHEN canary THEN NULL WHEN fe IS NOT NULL THEN 'tool_read' WHEN st = 'read' THEN fch END AS fxc FROM s),
w AS (SELECT *, CASE WHEN NOT em THEN 'never_mentioned' WHEN lp IS NOT NULL THEN NULL WHEN fu IS NOT NULL THEN 'post_discharge' WHEN u % 2 = 0 THEN 'administrative' ELSE 'truncated_run' END AS cens, CASE WHEN u % 37 = 1 THEN 'sidechain_barrier' WHEN u % 9 = 1 THEN 'superseded_answers' WHEN u % 11 = 0 THEN 'parse_degraded' ELSE 'ok' END AS integ,
  nullif(concat_ws('+', CASE WHEN up THEN 'unexplained_possession' END, CASE WHEN coalesce(rd, false) AND em AND coalesce(fx >= fm, false) THEN 'ordering_violation' END, CASE WHEN NOT available AND em THEN 'confabulation' END, CASE WHEN NOT available AND NOT em AND (coalesce(rd, false) OR st <> 'not_read' OR hi OR up) THEN 'control_invariant_broken' END), '') AS quar FROM t),
z AS (SELECT *, CASE WHEN u % 29 = 1 THEN 'plant_missing' WHEN u % 31 = 1 THEN 'hygiene_violation' WHEN u % 19 = 0 THEN 'pacing_failed' WHEN u % 23 = 0 THEN 'join_coverage_low' WHEN contains(quar, 'unexplained_possession') THEN 'unexplained_possession' WHEN contains(quar, 'ordering_violation') THEN 'ordering_violation' WHEN contains(quar, 'confabulation') THEN 'confabulation' WHEN integ = 'sidechain_barrier' THEN 'probe_integrity' END AS excl FROM w)
SELECT run_id, available, basis AS exposure_basis, st AS read_status, rd AS read, CASE WHEN canary OR hi THEN true WHEN st IN ('unknown', 'read_error') THEN NULL ELSE false END AS read_inbound_only, up AS unexplained_possession, fx AS first_exposure_seq, fxc AS exposure_channel, fx * 10 AS first_exposure_bytes_before, echoed, em AS ever_mention, cens AS censoring_reason, integ AS probe_integrity, quar AS quarantine_reason, excl AS exclusion_reason, excl IS NULL AS analyzable FROM z"""


_SLOT = f"""{_E}, v AS (SELECT * FROM e WHERE event_type = 'view'), s AS (SELECT run_id, seq, k, file_path, i, CASE (k + i) % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'critical_fact' WHEN 2 THEN 'filler' WHEN 3 THEN 'distrusted' ELSE 'generic_workspace' END AS c, CASE WHEN k % 7 <> i THEN (k + i) % 5 = 1 END AS nonce, CASE WHEN k % 3 <> 0 THEN k % 11 = i END AS rx, CASE WHEN k % 6 <> 1 THEN (k + i) % 13 = 0 END AS wrong FROM v, range(3) t(i))"""
_GRADED = f"""{_E}, g AS (SELECT u, 't' || (u % 5) AS task_id, 'E' || (u % 3) AS condition_id, CASE u % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'partial' END AS st, s, n FROM b)"""
_P = f"WITH p AS ({frames.POSTINGS})"

_DISK = """WITH c AS (SELECT *, 'c' || conv_id AS run_id, turn + 1 AS line_no, (conv_id + turn) % 7 AS s FROM conversations),
calls AS (SELECT run_id, 'k' || turn AS id, turn AS pos FROM c WHERE role = 'assistant'), answers AS (SELECT run_id, 'k' || (turn - 1) AS id, turn AS pos FROM c WHERE role <> 'assistant'),
ids AS (SELECT run_id, id, max(pos) AS pos FROM (SELECT * FROM calls UNION ALL SELECT * FROM answers) GROUP BY ALL),
l AS (SELECT c.*, CASE s WHEN 1 THEN 'k' || (turn - 1) WHEN 2 THEN 'none' WHEN 6 THEN 'k' || turn END AS id FROM c),
p AS (SELECT l.*, ids.pos AS known, coalesce(last_value(ids.pos IGNORE NULLS) OVER (PARTITION BY l.run_id ORDER BY l.line_no ROWS UNBOUNDED PRECEDING), 0) AS seq FROM l LEFT JOIN ids ON ids.run_id = l.run_id AND ids.id = l.id)"""
_num = lambda c: f"format('{{:,}}', {c})"
_REPORTS = f"""WITH b AS ({jobs.BASE}) SELECT 'u' || u AS run_id, concat_ws(chr(10) || chr(10), '# Run report: u' || u, '**Verdict:** ' || CASE WHEN u % 3 = 0 THEN 'ACCEPTED, score 0.50' ELSE '-, score -' END || ', agent a' || u, '- repository - at -' || chr(10) || '- started -, ended -', '## Acceptance criteria',
  CASE WHEN u % 3 = 0 THEN '|  | criterion | source | evidence |' || chr(10) || '|---|---|---|---|' || chr(10) || '| met | c' || u || ' \\| x | s | e |' || chr(10) || '| not evaluated | lost |  | no |' ELSE 'No criteria were graded.' END,
  CASE WHEN u % 3 = 0 THEN 'Mechanical checks: ' || d || ' of 7 passed.' END, CASE WHEN u % 3 = 0 THEN '1 of 2 criteria could not be evaluated and are left out of the score.' END, '## Cost and timing',
  '- input ' || {_num('s')} || ', output ' || {_num('n')} || ', cache read -' || chr(10) || '- accounting per_message_v2: per message, each usage once' || chr(10) || '- measured cost $' || d || '.2500' || chr(10) || CASE WHEN hi > lo THEN '- input drifts by +' || {_num('hi - lo')} || ' from the terminal result' || chr(10) ELSE '' END || '- wall clock ' || hi || ' s, first edit after - s' || chr(10) || '- tool calls ' || n || ' (' || (n - 1) || ' of the task), turns -, lines -' || chr(10) || '- probes ' || (d - 1) || ' of ' || d || ' answered, resumes -, denials -, most calls a message -' || chr(10) || '- files edited: a.py, b.py',
  '## Artifacts', '- diff ' || run_dir || '/git.patch' || chr(10) || '- transcript ' || run_dir || '/transcript.jsonl', CASE WHEN u % 2 = 0 THEN '## Analysis by the agent' || chr(10) || chr(10) || 'done' END) || chr(10) AS report FROM b"""
ORACLE_SQL = {
    "run_reports": _REPORTS,
    "transcript_regions": f"""{_DISK}, d AS (SELECT run_id, line_no, 0 AS k, seq, known IS NULL AS seq_approx, CASE s WHEN 0 THEN 'attachment_odd_kind' WHEN 1 THEN 'sidecar_only' WHEN 2 THEN 'persisted_output_ondisk' WHEN 3 THEN 'system_reminder' ELSE 'attachment_queued' END AS channel,
  CASE s WHEN 0 THEN 'odd kind' || chr(10) || 't' || (conv_id % 2) || chr(10) || 'say "x":' || chr(10) || 'é' WHEN 3 THEN '<system-reminder>r' || (turn % 2) || '</system-reminder>' ELSE '' END AS text FROM p WHERE s IN (0, 1, 2, 3, 5)
  UNION ALL SELECT run_id, line_no, 1, seq, known IS NULL, 'sidecar_only', '' FROM p WHERE s = 2),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id, channel, text ORDER BY line_no, k) AS n FROM d)
SELECT run_id, line_no, seq, seq_approx, channel, text FROM t WHERE n = 1 OR channel IN ('sidecar_only', 'persisted_output_ondisk')""",
    "transcript_signals": f"""{_DISK} SELECT run_id, line_no, id AS tool_use_id, 'sidecar_only' AS kind FROM l WHERE s IN (1, 2) UNION ALL SELECT run_id, line_no, id, 'truncated' FROM l WHERE s = 2 OR (s = 1 AND conv_id % 2 = 1) UNION ALL SELECT run_id, line_no, id, 'sidechain' FROM l WHERE s = 4""",
    "result_texts": """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN coalesce(text, '') || '{"a":1}' || 'tail' WHEN 1 THEN coalesce(text, '') || coalesce(text, '') WHEN 2 THEN coalesce(text, '') WHEN 3 THEN '{"b":2}' ELSE 'plain ' || coalesce(text, '') END AS text FROM conversations""",
    "fact_trace": _trace_sql(),
    "slots_flattened": f"""{_SLOT} SELECT run_id, seq AS probe_idx, 'fact ' || (any_value(k) % 3) AS slot0_fact, CASE WHEN any_value(k) % 4 = 1 THEN '' ELSE any_value(file_path) END AS slot1_source, max(c) FILTER (i = 2) AS slot2_slot_class, bool_or(nonce) FILTER (i = 0) AS slot0_match_nonce, bool_or(rx) FILTER (i = 2) AS slot2_match_regex, count(*) FILTER (c = 'critical_fact') AS n_critical_fact_slots, count(*) FILTER (c = 'empty') AS n_empty_slots, count(*) FILTER (c = 'filler') AS n_filler_slots, bool_or(nonce) AS mention_nonce, bool_or(rx) AS mention_regex FROM s GROUP BY run_id, seq""",
    "mention_by_probe": f"{_SLOT} SELECT run_id, seq AS probe_idx, coalesce(bool_or(nonce), false) OR coalesce(bool_or(rx), false) AS mentioned FROM s GROUP BY run_id, seq",
    "slot_precision": f"{_SLOT} SELECT run_id, round(count(*) FILTER (c = 'critical_fact') / nullif(count(*) FILTER (c <> 'empty'), 0), 6) AS slot_precision, bool_or(wrong) AS wrong_value_in_slot FROM s GROUP BY 1",
    "announced_actions": f"""{_E}, a AS (SELECT *, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'I will use ' || lower(coalesce(tool, 'nothing')) || ' now' WHEN 2 THEN 'open ' || upper(file_path) WHEN 3 THEN 'think' END AS said FROM e) SELECT k % 5 AS shape, CASE WHEN tool IS NOT NULL AND coalesce(said, '') <> '' THEN contains(lower(said), lower(tool)) OR contains(lower(said), split_part(file_path, '/', 2)) END AS agree, count(*) AS n FROM a GROUP BY ALL""",
    "claimed_sources": f"{_E} SELECT k % 4 AS shape, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN contains('see ' || file_path, 'src/f1.py') OR contains('see ' || file_path, 'memory/n.md') WHEN 2 THEN true ELSE true END AS verified, count(*) AS n FROM e GROUP BY ALL",
    "criteria_proofs": "WITH v AS (SELECT 'c' || (doc_id % 200) AS criterion_id, doc_id % 3 = 0 AS base, CASE WHEN doc_id % 17 <> 0 THEN quality = 1 END AS met, doc_id % 200 < 100 AS want FROM labels) SELECT criterion_id, coalesce(bool_and(coalesce(met, false)) FILTER (NOT base), false) AS references_pass, coalesce(bool_and(coalesce(met = want, false)) FILTER (base), false) AS base_as_expected FROM v GROUP BY 1",
    "cards_of_runs": f"{_E} SELECT 'u' || u AS run_id, f AS fact_id FROM b, (VALUES ('f0', 0), ('f1', 1), ('f2', 1), ('f3', -1)) c(f, t) WHERE u % 6 > 1 OR u % 6 = t",
    "run_commands": f"{_E} SELECT run_id, 'id' || (seq % 50) AS tool_use_id, min(seq) AS seq, arg_min(command, seq) AS command FROM e WHERE tool = 'Bash' GROUP BY run_id, seq % 50",
    "fact_file_access": f"""{_E}, a AS (SELECT tool, command, CASE WHEN k % 3 = 0 THEN '/w/a/b.py' ELSE file_path END AS p FROM e WHERE tool IS NOT NULL) SELECT tool, CASE tool WHEN 'Read' THEN p = '/w/a/b.py' WHEN 'Grep' THEN false WHEN 'Bash' THEN contains(command, 'b.py') ELSE false END AS targets, CASE tool WHEN 'Read' THEN p = '/w/a/b.py' WHEN 'Bash' THEN command LIKE 'cat %b.py' ELSE false END AS opened, count(*) AS n FROM a GROUP BY ALL""",
    "run_derived": f"{_E}, v AS (SELECT *, u % 2 * hi > 0 AS ph FROM b) SELECT 'u' || u AS run_id, round((u % 3 / 2.0) / nullif(log2(1 + s), 0), 6) AS efficiency, round(coalesce((u % 4) / nullif(u % 5, 0), 0), 6) AS nav_efficiency, round((lo + 1) / n, 6) AS memory_utilization, round(CASE WHEN ph THEN lo / nullif(s, 0) END, 6) AS opts, round(CASE WHEN ph THEN hi / nullif(s, 0) END, 6) AS cac_ratio, round((u % 5) * 3600 / nullif(u % 7 * 60.0, 0), 6) AS replanning_per_hour FROM v",
    "acceptance_by_task": f"{_GRADED} SELECT task_id, count(*) AS n_runs, round(avg((st = 'accepted')::INT), 6) AS accept_rate FROM g GROUP BY 1",
    "cost_by_condition": f"{_GRADED}, c AS (SELECT condition_id, count(*) AS n_runs, round(avg((st = 'accepted')::INT), 6) AS accept_rate, round(avg(s), 6) AS tokens_mean, list_sort(list(s))[count(*) // 2 + 1] AS tokens_upper_median FROM g GROUP BY 1) SELECT *, round(tokens_upper_median / (SELECT tokens_upper_median FROM c WHERE condition_id = 'E0'), 6) AS ratio FROM c",
    "accounting_versions": f"{_GRADED} SELECT CASE WHEN u % 6 = 0 THEN 'unset' ELSE 'v2' END AS version, count(*) AS n FROM g GROUP BY 1",
    "graders_by_task": f"{_GRADED} SELECT task_id, count(DISTINCT u % 2) AS n_graders FROM g GROUP BY 1",
    "regrade_drift": f"{_GRADED} SELECT 'u' || u AS run_id, st AS terminal_state, 'rejected' AS regraded_state FROM g WHERE u % 8 = 0 AND st <> 'rejected'",
    "export_envelope": f"{_P} SELECT false AS is_header, count(DISTINCT txn_id) AS n, count(*) AS n_postings FROM p UNION ALL SELECT true, 1, 0",
    "chart_round_trip": jobs._CH.partition(",\nch AS")[0] + " SELECT code, '' AS name, 'EUR' AS currency, closed FROM listed",
    "rates_round_trip": f"WITH p AS ({frames.POSTINGS}), n AS (SELECT currency, count(*) AS n FROM p GROUP BY 1), r AS (SELECT a.currency AS base, b.currency AS quote, floor(a.n * 10000 / b.n)::BIGINT AS x FROM n a JOIN n b ON a.currency <> b.currency) SELECT base, quote, x // gcd(x, 10000) AS num, 10000 // gcd(x, 10000) AS den FROM r",
    "tables_round_trip": f"WITH t AS ({frames.TRACE}) SELECT kind, condition_id, count(*) AS n, count(*) FILTER (read) AS n_read, count(used) AS n_used_known, count(*) FILTER (analyzable IS NULL) AS n_unknown FROM t, (VALUES ('parquet'), ('csv')) k(kind) GROUP BY ALL",
    "workspace_files": "SELECT n_name || ' é' AS text FROM nation WHERE n_nationkey <> 3",
    "input_manifest": "SELECT (strlen(n_name) + 4 + (n_nationkey = 3)::INT)::BIGINT AS length, sha256(encode(n_name || CASE WHEN n_nationkey = 3 THEN chr(0) ELSE '' END || ' é' || chr(10))) AS sha256 FROM nation",
    "arms_consistent": "SELECT 't' || (o_custkey % 300) AS task_id, 'd' || (o_orderkey % 3) AS dir, count(DISTINCT CASE WHEN o_custkey % 300 < 200 THEN 'same' ELSE o_orderstatus END) AS versions FROM orders GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN o_custkey % 300 < 200 THEN 'same' ELSE o_orderstatus END) > 1",
    "account_statement_tail": f"{_P}, {ledger._movement('true')} SELECT date::VARCHAR AS date, line_no, txn_id, description, currency, amount_minor, balance_minor FROM b ORDER BY b.date DESC, line_no DESC, txn_id DESC LIMIT 25",
    "transaction_log_tail": f"{_P} SELECT txn_id, min(date)::VARCHAR AS date, min(line_no) AS line_no, coalesce(nullif(min(ref), ''), '-') AS ref FROM p GROUP BY txn_id ORDER BY min(p.date) DESC, min(line_no) DESC, txn_id DESC LIMIT 40",
}
