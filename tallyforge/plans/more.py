"""Queries of detectors, tables, designs and streams, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import shared
from tallyforge.functions import text as X
from tallyforge.operators import design as DS
from tallyforge.operators import detectors as D
from tallyforge.operators import grading as G
from tallyforge.operators import invariants as IV
from tallyforge.operators import ledger as L
from tallyforge.operators import regions as RG
from tallyforge.operators import store as SR
from tallyforge.operators import tables as TB
from tallyforge.plans import frames, ledger, logs
from tallyforge.plans.statistics import rounded
from tallyforge.streaming import probes as PR
from tallyforge.streaming import rates as ST


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of two files for every order, shaped by its key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("run_id"), F.col("o_orderkey").alias("k"))
    one = F.concat(F.lit("diff --git a/src/m"), F.col("k") % 9, F.lit(".py b/src/m"), F.col("k") % 9, F.lit(".py\n@@ -1,2 +3,3 @@\n keep\n+total = "), F.col("k") % 4, F.lit("\n-old\n+done\n"))
    two = F.when(F.col("k") % 3 == 0, F.concat(F.lit("diff --git a/docs/x.md b/docs/x.md\nnew file mode 100644\n@@ -0,0 +1,1 @@\n+note "), F.col("k") % 5, F.lit("\n"))).otherwise("")
    return o.select("run_id", F.concat(one, two).alias("diff"))


def _runs(spark, sf_dir):
    return _diffs(spark, sf_dir).select("run_id")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("run_id"), F.col("o_orderkey").alias("k"))
    command = F.when(F.col("k") % 4 == 0, "git add . && git commit -m 'a; b'").when(F.col("k") % 4 == 1, "pytest -q | tail -1; git commit -m x").when(F.col("k") % 4 == 2, 'echo "$(ls; pwd)" > out').otherwise("git commit -m y\npytest")
    return o.select("run_id", F.lit(0).alias("seq"), command.alias("command"))


def _predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("path_untouched", D.untouched(["docs/**"])), ("diff_confined", D.confined(["src/**"])), ("content_present", D.present(r"total = 2")), ("content_absent", D.absent("note", ["*.md"])), ("command_used", D.used(r"^pytest")), ("command_order", D.ordered(r"^pytest", r"^git commit"))]
    out = D.verdicts(_runs(spark, sf_dir), rules, files=D.changed_files(_diffs(spark, sf_dir)), segments=D.run_segments(_commands(spark, sf_dir)))
    return out.groupBy("predicate").agg(F.count_if("eligible").alias("n_eligible"), F.count_if("fired").alias("n_fired"))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"required": ["o_orderkey"], "properties": {"o_orderkey": {"type": "integer", "minimum": 0}, "o_orderstatus": {"type": "string", "enum": ["F", "O"]}, "o_orderpriority": {"type": "string", "pattern": "^[1-5]-"}}, "allOf": [{"if": {"properties": {"o_orderstatus": {"const": "F"}}}, "then": {"properties": {"o_totalprice": {"type": "number", "maximum": 400000}}}}]}
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return TB.violations(o, schema, most=1 << 30).groupBy("message").agg(F.count("*").alias("n"))


def _stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # one file: the stream reads its folder's events alone
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _hits(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("condition_id"), F.when(k % 11 != 0, F.col("value") > 40).alias("hit"), F.concat(F.lit("u"), "user_id").alias("run_id"), F.concat(F.lit("m"), k % 17).alias("message_id"), F.col("event_id").alias("seq"), ((F.col("event_type") == "purchase") & (k % 9 == 0)).alias("is_edit"), k.cast("bigint").alias("tokens_in"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return v.select(F.concat(F.lit("d"), F.col("doc_id") % 50).alias("run_id"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("criterion_id"), F.when(F.col("doc_id") % 7 != 0, F.col("quality") == 1).alias("met"))


def _fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return v.select(F.concat(F.lit("f"), F.col("doc_id") % 40).alias("fact_id"), (F.col("toxic") == 1).alias("fired"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw records: assistants speak and call tools, users answer them or write."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    block = lambda **k: F.struct(*(v.alias(n) for n, v in k.items()))
    call = F.to_json(block(type=F.lit("tool_use"), name=F.when(F.col("turn") % 4 == 1, "Read").otherwise("Bash"), id=F.concat(F.lit("k"), F.col("turn")), input=block(command=F.lit("ls"))))
    said = F.concat(F.lit("["), F.to_json(block(type=F.lit("text"), text=F.col("text"))), F.lit(","), call, F.lit("]"))
    answer = F.to_json(block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("k"), F.col("turn") - 1), content=F.col("text")))
    wrote = F.concat(F.lit("["), F.to_json(block(type=F.lit("text"), text=F.concat("text", F.lit("<system-reminder>x</system-reminder>")))), F.lit(","), answer, F.lit("]"))
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    line = F.concat(F.lit('{"type":"'), role, F.lit('","message":{"role":"'), role, F.lit('","content":'), F.when(role == "assistant", said).otherwise(wrote), F.lit("}}"))
    return c.select(F.concat(F.lit("c"), "conv_id").alias("run_id"), (F.col("turn") + 1).alias("line_no"), line.alias("line"))


_CONDITIONS = ("exit_code == 0 and len(stdout) > 2", "(lambda d: exit_code == 0 and d)(json.loads(stdout))", "open('x').read()", "reopen(x) and f.open(y)", "__import__('json').loads(stdout)", "getattr(a, 'b') or eval(c)", "stdout.count('ok') >= 1")
_CHECKS = ("grep -rn word .", "git diff | grep x", "pytest -q tests", "pytest --co -x", "echo 'a | b' || true", "ls | wc -l", "python -m pytest -qq", "pytest a -q")


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion for every order: conditions and commands of known kinds, each with each."""
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), F.pmod("o_orderkey", F.lit(len(xs))).cast("int") + 1)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "judged").otherwise("mechanical").alias("kind"), pick(_CHECKS).alias("command"), pick(_CONDITIONS).alias("pass_condition"))


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, two thirds of them with headings, boxes, tables or bare bullets after their text."""
    more = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "\n## head\n- [x] item  \n| a | b |\n|---|:-:|\n").otherwise("\n* \n-")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), "source", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))


PATIENCE = 86_400


def _asked(e: DataFrame) -> DataFrame:
    """Events as a log of probes; those of a run and day are sendings of one probe."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when((F.col("event_type") == "view") & (k % 2 == 0), "probe_in").when(F.col("event_type").isin("purchase", "signup"), "tool_use").otherwise("assistant")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.concat(F.lit("u"), "user_id").alias("run_id"), F.col("event_id").alias("seq"), ts.alias("ts"), kind.alias("kind"), F.when(kind == "probe_in", F.concat(F.lit("p"), F.date_format(ts, "yyyyMMdd"))).alias("probe_id"), (k % 5 < 2).alias("answers"), (k % 7 == 1).alias("refusing"), F.when(k % 3 > 0, k % 2 == 0).alias("parse_ok"))


def _asked_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, beside a heartbeat long after the table's last event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    beat = events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 30 days")).alias("ts"))
    rows = _asked(events)
    late = rows.where("false").unionByName(beat.select("ts", F.lit("heartbeat").alias("kind"), F.lit(0).cast("long").alias("seq")), allowMissingColumns=True)
    at = shared.path(spark, "heartbeat")
    late.write.parquet(at)
    return PR.stream_lifecycles(_asked(_stream_source(spark, sf_dir)).unionByName(spark.readStream.schema(rows.schema).parquet(at)), patience=PATIENCE)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events committed, then all, then all again in another order, which commits nothing: rows by version."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    table = SR.Table(spark, shared.path(spark, "stored"))
    writes = [table.write(df) for df in (events.where("event_id % 2 = 0"), events, events.repartition(3))]
    out = None
    for m in table.manifests():
        one = table.read(m["number"]).agg(F.lit(m["number"]).alias("number"), F.count("*").alias("n"), F.lit(len(writes)).alias("writes"))
        out = one if out is None else out.unionByName(one)
    return out


def _schedule(spark: SparkSession, sf_dir: str, without: str = "") -> DataFrame:
    """A design of every month's orders as tasks under every segment's condition; the lists of a design are at the driver."""
    tasks = [r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().orderBy("month").collect()]
    arms = [r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").where(F.col("c_mktsegment") != without).distinct().orderBy("c_mktsegment").collect()]
    return DS.schedule(spark, job="j", tasks=tasks, conditions=arms, reps=2)


QUERIES = {
    "lint_criteria": lambda s, d: rounded(G.lint_criteria(_criteria(s, d))),
    "majority": lambda s, d: rounded(G.majority(_votes(s, d))),
    "judged": lambda s, d: rounded(G.judged(G.majority(_votes(s, d)))),
    "admission": lambda s, d: rounded(G.admission(_fires(s, d))),
    "length_report": lambda s, d: rounded(G.length_report(_laid_out(s, d))),
    "length_balance": lambda s, d: rounded(G.length_balance(_laid_out(s, d), "source")),
    "content_hash": lambda s, d: rounded(G.content_hash(s.read.parquet(f"{d}/nation.parquet"), "n_regionkey", "n_nationkey", "n_name")),
    "content_hash_skewed": lambda s, d: rounded(G.content_hash(s.read.parquet(f"{d}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))), "user_id", "event_id", "event_type")),
    "scan_before_truncation": lambda s, d: rounded(IV.verdicts(logs.flat(s, d).withColumn("model_visible", F.col("event_type") != "error").withColumn("digested", F.col("k") % 97 == 0), "run_id", scanned_before_truncation=IV.scanned_before_truncation())),
    "stored_tables": lambda s, d: rounded(_stored(s, d)),
    "leaks": lambda s, d: rounded(G.leaks(logs.regions(s, d).select(F.concat("run_id", F.lit("/"), "seq").alias("name"), "text"), logs.cards(s))),
    "stream_regions": lambda s, d: rounded(RG.stream_regions(_records(s, d)).groupBy("channel").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))),
    "record_kinds": lambda s, d: rounded(_records(s, d).groupBy(RG.record_kind().alias("kind")).agg(F.count("*").alias("n"))),
    "accounts_used": lambda s, d: rounded(L.in_period(ledger.postings(s, d), ledger.YEAR).groupBy("currency").agg(F.countDistinct("account").alias("n_accounts"), F.min("date").alias("first"), F.max("date").alias("last"))),
    "diff_files": lambda s, d: rounded(D.changed_files(_diffs(s, d)).select("run_id", "path", "status", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))),
    "added_lines": lambda s, d: rounded(D.added_lines(D.changed_files(_diffs(s, d)))),
    "shell_segments": lambda s, d: rounded(D.run_segments(_commands(s, d)).groupBy("segment").agg(F.count("*").alias("n"))),
    "predicates": lambda s, d: rounded(_predicates(s, d)),
    "schema_violations": lambda s, d: rounded(_violations(s, d)),
    "enum_drift": lambda s, d: TB.enum_drift(s.createDataFrame([("view",), ("click",), ("gone",)], "event_type string"), s.read.parquet(f"{d}/events.parquet"), "event_type"),
    "manifest": lambda s, d: rounded(TB.manifest({"trace": frames.trace(s, d), "probes": frames.probes(s, d)})),
    "identity": lambda s, d: rounded(logs.flat(s, d).select("run_id", "seq", TB.identity(F.col("message_id"), F.col("tool"), F.col("run_id")).alias("id"))),
    "canonical_json": lambda s, d: rounded(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", TB.canonical_json(F.struct(F.col("n_regionkey").alias("z"), F.col("n_name").alias("a"))).alias("json"))),
    "path_globs": lambda s, d: rounded(logs.flat(s, d).groupBy(X.path_matches(F.col("file_path"), ["src/f1?.py", "memory/**"]).alias("hit")).agg(F.count("*").alias("n"))),
    "schedule": lambda s, d: rounded(_schedule(s, d)),
    "schedule_drift": lambda s, d: rounded(DS.schedule_drift(_schedule(s, d), _schedule(s, d, without="BUILDING"))),
    "probe_lifecycles": lambda s, d: rounded(PR.lifecycles(_asked(s.read.parquet(f"{d}/events.parquet")), patience=PATIENCE)),
    "stream_probe_lifecycles": lambda s, d: rounded(ST.drained(_asked_stream(s, d), mode="append")),
    "windowed_rates": lambda s, d: rounded(ST.windowed_rates(_hits(s.read.parquet(f"{d}/events.parquet")))),
    "stream_windowed_rates": lambda s, d: rounded(ST.drained(ST.windowed_rates(_hits(_stream_source(s, d))))),
    "sessions": lambda s, d: rounded(ST.sessions(_hits(s.read.parquet(f"{d}/events.parquet")))),
    "stream_usage_once": lambda s, d: rounded(ST.drained(ST.usage_once(_hits(_stream_source(s, d)), late="3650 days"), mode="append").groupBy("run_id").agg(F.count("*").alias("n"))),
    "stream_running_phases": lambda s, d: rounded(ST.drained(ST.running_phases(_hits(_stream_source(s, d)).select("run_id", "seq", "is_edit", "tokens_in")), mode="update", keys=("run_id",))),
}

_O = "WITH o AS (SELECT 'o' || o_orderkey AS run_id, o_orderkey AS k FROM orders)"
_H = "WITH h AS (SELECT ts, user_id, event_type AS condition_id, event_id AS seq, cast(json_extract_string(props, '$.k') AS int) AS k, CASE WHEN cast(json_extract_string(props, '$.k') AS int) % 11 <> 0 THEN value > 40 END AS hit FROM events)"
_WINDOWS = f"{_H} SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS window_start, condition_id, count(hit) AS n, count(*) FILTER (hit) AS k, count(*) - count(hit) AS n_unknown FROM h GROUP BY ALL"
_V = "WITH v AS (SELECT 'd' || (doc_id % 50) AS run_id, 'c' || (doc_id % 3) AS criterion_id, CASE WHEN doc_id % 7 <> 0 THEN quality = 1 END AS met FROM labels), m AS (SELECT run_id, criterion_id, CASE WHEN count(met) > 0 THEN count(*) FILTER (met) > count(met) / 2 END AS met, count(met) AS n_votes FROM v GROUP BY ALL)"
_q, _listed = logs._q, logs._listed
_LINT = f"""WITH c AS (SELECT o_orderkey AS id, {_listed(_CHECKS)}[(o_orderkey % {len(_CHECKS)} + 1)::INT] AS cmd, {_listed(_CONDITIONS)}[(o_orderkey % {len(_CONDITIONS)} + 1)::INT] AS cond FROM orders WHERE o_orderkey % 9 <> 0)
SELECT id, 'sandbox' AS kind, n AS name FROM c, (SELECT unnest({_listed(G.SANDBOX_ABSENT)}) AS n) WHERE regexp_matches(cond, '(^|[^\\w.])' || n || '\\b')
UNION ALL SELECT id, 'guard_inside_lambda', NULL FROM c WHERE regexp_matches(cond, {_q(G.GUARD_INSIDE_LAMBDA)}) UNION ALL SELECT id, 'short_circuit', NULL FROM c WHERE regexp_matches(cond, {_q(G.SHORT_CIRCUIT)})
UNION ALL SELECT id, 'tree_grep', NULL FROM c WHERE regexp_matches(cmd, {_q(G.TREE_GREP)}) AND NOT regexp_matches(cmd, {_q(G.DIFF_SCOPED)}) UNION ALL SELECT id, 'double_quiet', NULL FROM c WHERE regexp_matches(cmd, '\\bpytest\\b([^\\n]*[^\\n\\w-])?-q([^\\w-]|$)')
UNION ALL SELECT id, 'pipe', NULL FROM c WHERE contains(regexp_replace(regexp_replace(cmd, {_q(G.QUOTED)}, '', 'g'), '[|][|]+', '', 'g'), '|')"""
_MULTISET = "sha256(concat_ws('|', count(*)::VARCHAR, " + ", ".join(f"sum(('0x' || substr(sha256(l), {1 + 8 * k}, 8))::BIGINT)::VARCHAR" for k in range(8)) + "))"
_ASKED = f"""WITH j AS (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events),
e AS (SELECT 'u' || user_id AS run_id, event_id AS seq, ts::TIMESTAMP AS ts, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'probe_in' WHEN event_type IN ('purchase', 'signup') THEN 'tool_use' ELSE 'assistant' END AS kind, 'p' || strftime(ts::TIMESTAMP, '%Y%m%d') AS probe_id, k % 5 < 2 AS answers, k % 7 = 1 AS refusing, CASE WHEN k % 3 > 0 THEN k % 2 = 0 END AS parse_ok FROM j),
t AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (kind = 'probe_in') OVER w AS turn FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
u AS (SELECT run_id, turn, any_value(probe_id) FILTER (kind = 'probe_in') AS probe_id, min(rn) FILTER (kind = 'probe_in') AS s, min(rn) FILTER (kind = 'tool_use') AS tl, min(rn) FILTER (kind = 'assistant' AND answers) AS an FROM t WHERE turn > 0 GROUP BY ALL),
v AS (SELECT u.run_id, u.turn, u.probe_id, u.s, a.ts AS sent_ts, a.seq AS sent_seq, b.ts AS answer_ts, b.seq AS answer_seq, b.refusing AND NOT coalesce(b.parse_ok, false) AS refused FROM u JOIN t a ON a.run_id = u.run_id AND a.rn = u.s LEFT JOIN t b ON b.run_id = u.run_id AND b.rn = u.an AND (u.tl IS NULL OR u.an < u.tl)),
f AS (SELECT *, first_value(sent_ts) OVER w + INTERVAL {PATIENCE} SECOND AS until, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY run_id, probe_id ORDER BY s)),
g AS (SELECT run_id, probe_id, min(turn) AS turn, min_by(sent_seq, s) AS sent_seq, any_value(until) AS until, count(*) AS n_sent, min_by(answer_seq, s) FILTER (answer_ts <= until) AS answer_seq, min_by(refused, s) FILTER (answer_ts <= until) AS refused FROM f WHERE sent_ts <= until GROUP BY ALL)
SELECT g.run_id, g.probe_id, g.sent_seq, n_sent, g.answer_seq, CASE WHEN g.refused THEN 'refused' WHEN g.answer_seq IS NOT NULL THEN 'answered' WHEN o.sent_ts <= g.until THEN 'superseded' ELSE 'unanswered' END AS outcome FROM g LEFT JOIN v o ON o.run_id = g.run_id AND o.turn = g.turn + 1"""
_LENGTHS = r"""WITH d AS (SELECT doc_id::VARCHAR AS name, source, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '## head' || chr(10) || '- [x] item  ' || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) ELSE chr(10) || '* ' || chr(10) || '-' END AS t FROM documents),
m AS (SELECT *, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+'))::BIGINT AS w, len(regexp_extract_all(replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)[ \t]+$', '', 'g'), '(?m)^[|:\- \t]+$', '', 'g'), '(?m)^[ \t]*(?:#{1,6}[ \t]*)?(?:[-*+][ \t]+)?(?:\[[ xX]\][ \t]*)?', '', 'g'), '|', ' '), '[^ \t\n\x0B\f\r]+'))::BIGINT AS c FROM d)"""
ORACLE_SQL = {
    "probe_lifecycles": _ASKED,
    "stream_probe_lifecycles": _ASKED,
    "lint_criteria": _LINT,
    "majority": f"{_V} SELECT * FROM m",
    "judged": f"{_V}, j AS (SELECT run_id, count(*) AS t, count(met) AS g, count(*) FILTER (met) AS k FROM m GROUP BY 1) SELECT run_id, t AS criteria_total, g AS criteria_graded, t - g AS criteria_errored, round(k / nullif(g, 0), 6) AS score, CASE WHEN g = 0 THEN 'error' WHEN k = g AND t = g THEN 'accepted' WHEN k = 0 AND t = g THEN 'rejected' ELSE 'partial' END AS verdict FROM j",
    "admission": "WITH f AS (SELECT 'f' || (doc_id % 40) AS fact_id, count(toxic) AS n, count(*) FILTER (toxic = 1) AS k FROM labels GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z FROM f) SELECT fact_id, n, k, round(least(1, (k / n + z * z / (2.0 * n) + z * sqrt(greatest(k / n * (1 - k / n) / n + z * z / (4.0 * n * n), 0))) / (1 + z * z / n)), 6) AS upper, CASE WHEN n < 12 THEN 'unevaluable' WHEN k = 0 THEN 'pass' WHEN k = 1 THEN 'weak' ELSE 'fail' END AS status FROM z",
    "length_report": _LENGTHS + " SELECT name, strlen(t)::BIGINT AS n_bytes, length(t) AS n_chars, len(t) - len(replace(t, chr(10), '')) + CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 0 ELSE 1 END AS n_lines, w AS n_words, c AS n_content_words, sha256(t) AS sha256 FROM m",
    "length_balance": _LENGTHS + " SELECT source, min(w) AS words_min, max(w) AS words_max, round(CASE WHEN min(w) > 0 THEN max(w) / min(w) - 1 END, 6) AS word_spread, min(c) AS content_words_min, max(c) AS content_words_max, round(CASE WHEN min(c) > 0 THEN max(c) / min(c) - 1 END, 6) AS content_word_spread FROM m GROUP BY 1",
    "content_hash": f"SELECT key AS n_regionkey, {_MULTISET} AS sha256 FROM (SELECT n_regionkey::BIGINT AS key, n_nationkey || '|' || n_name AS l FROM nation) GROUP BY 1",
    "content_hash_skewed": f"SELECT key AS user_id, {_MULTISET} AS sha256 FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END::BIGINT AS key, event_id || '|' || event_type AS l FROM events) GROUP BY 1",
    "scan_before_truncation": f"WITH e AS ({logs.EVENTS}) SELECT run_id, 'scanned_before_truncation' AS invariant, count(*) AS rows, count(*) FILTER (event_type <> 'error' AND k % 97 = 0) AS broken, count(*) FILTER (event_type <> 'error' AND k % 97 = 0) = 0 AS holds FROM e GROUP BY 1",
    "stored_tables": "SELECT 1::BIGINT AS number, count(*) FILTER (event_id % 2 = 0) AS n, 3::BIGINT AS writes FROM events UNION ALL SELECT 2, count(*), 3 FROM events",
    "leaks": logs._REG + " SELECT run_id || '/' || seq AS name, fact_id FROM hits WHERE form IN ('exact', 'lower', 'nohyphen')",
    "stream_regions": """WITH c AS (SELECT *, coalesce(text, '') AS t FROM conversations), r AS (
SELECT 'self_text' AS channel, strlen(t) AS b FROM c WHERE role = 'assistant' UNION ALL SELECT 'tool_input', strlen('{"command":"ls"}') FROM c WHERE role = 'assistant'
UNION ALL SELECT 'harness_task_prompt', strlen(t) FROM c WHERE role <> 'assistant' AND trim(t) <> '' UNION ALL SELECT 'system_reminder', strlen('<system-reminder>x</system-reminder>') FROM c WHERE role <> 'assistant'
UNION ALL SELECT CASE WHEN p.turn IS NULL THEN 'unknown_visible' WHEN p.turn % 4 = 1 THEN 'tool_read' ELSE 'bash_stdout' END, strlen(c.t) FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'assistant' WHERE c.role <> 'assistant')
SELECT channel, count(*) AS n, sum(b)::BIGINT AS n_bytes FROM r GROUP BY 1""",
    "record_kinds": "SELECT CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
    "accounts_used": f"WITH p AS ({frames.POSTINGS}) SELECT currency, count(DISTINCT account) AS n_accounts, min(date)::VARCHAR AS first, max(date)::VARCHAR AS last FROM p WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1",
    "diff_files": f"{_O} SELECT run_id, 'src/m' || (k % 9) || '.py' AS path, 'modified' AS status, 2::BIGINT AS n_added, 1::BIGINT AS n_removed FROM o UNION ALL SELECT run_id, 'docs/x.md', 'added', 1, 0 FROM o WHERE k % 3 = 0",
    "added_lines": f"{_O} SELECT run_id, 'src/m' || (k % 9) || '.py' AS path, 4::BIGINT AS line_no, 'total = ' || (k % 4) AS text FROM o UNION ALL SELECT run_id, 'src/m' || (k % 9) || '.py', 5, 'done' FROM o UNION ALL SELECT run_id, 'docs/x.md', 1, 'note ' || (k % 5) FROM o WHERE k % 3 = 0",
    "shell_segments": f"""{_O}, s AS (SELECT unnest(CASE k % 4 WHEN 0 THEN ['git add .', 'git commit -m ''a; b'''] WHEN 1 THEN ['pytest -q', 'tail -1', 'git commit -m x'] WHEN 2 THEN ['echo "$(ls; pwd)" > out'] ELSE ['git commit -m y', 'pytest'] END) AS segment FROM o) SELECT segment, count(*) AS n FROM s GROUP BY 1""",
    "predicates": f"""{_O} SELECT 'path_untouched' AS predicate, count(*) AS n_eligible, count(*) FILTER (k % 3 <> 0) AS n_fired FROM o UNION ALL SELECT 'diff_confined', count(*), count(*) FILTER (k % 3 <> 0) FROM o UNION ALL SELECT 'content_present', count(*), count(*) FILTER (k % 4 = 2) FROM o
UNION ALL SELECT 'content_absent', count(*) FILTER (k % 3 = 0), 0 FROM o UNION ALL SELECT 'command_used', count(*), count(*) FILTER (k % 4 IN (1, 3)) FROM o UNION ALL SELECT 'command_order', count(*) FILTER (k % 4 <> 2), count(*) FILTER (k % 4 = 1) FROM o""",
    "schema_violations": "WITH m AS (SELECT concat_ws('; ', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: not one of the values' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'o_totalprice: maximum' END) AS message FROM orders) SELECT message, count(*) AS n FROM m WHERE message <> '' GROUP BY 1",
    "enum_drift": "SELECT 'gone' AS event_type, 'declared only' AS side UNION ALL SELECT DISTINCT event_type, 'used only' FROM events WHERE event_type NOT IN ('view', 'click')",
    "manifest": "SELECT 'trace' AS name, count(*) AS rows, 'unset,v0,v1,v2' AS versions, true AS mixed FROM events UNION ALL SELECT 'probes', count(*), 'unset', false FROM events",
    "identity": f"WITH e AS ({logs.EVENTS}) SELECT run_id, seq, coalesce(nullif(message_id, ''), tool, run_id) AS id FROM e",
    "canonical_json": "SELECT n_nationkey::BIGINT AS n_nationkey, '{\"a\":\"' || n_name || '\",\"z\":' || n_regionkey || '}' AS json FROM nation",
    "path_globs": f"WITH e AS ({logs.EVENTS}) SELECT regexp_matches(file_path, '^src/f1.\\.py$') OR file_path LIKE 'memory/%' AS hit, count(*) AS n FROM e GROUP BY 1",
    "windowed_rates": _WINDOWS,
    "stream_windowed_rates": _WINDOWS,
    "sessions": f"{_H}, g AS (SELECT *, (coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true))::INT AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, seq) AS sid FROM g) SELECT user_id, min(ts)::VARCHAR AS session_start, (max(ts) + INTERVAL 6 HOUR)::VARCHAR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid",
    "stream_usage_once": f"{_H} SELECT 'u' || user_id AS run_id, count(DISTINCT k % 17) AS n FROM h GROUP BY 1",
    "stream_running_phases": f"{_H}, e AS (SELECT user_id, min(seq) AS f, max(seq) AS l FROM h WHERE condition_id = 'purchase' AND k % 9 = 0 GROUP BY 1) SELECT 'u' || h.user_id AS run_id, coalesce(any_value(f), -1) AS first_edit, coalesce(any_value(l), -1) AS last_edit, count(*) AS n, count(*) FILTER (f IS NULL OR seq < f) AS n_before_edit, sum(k)::BIGINT AS tokens FROM h LEFT JOIN e USING (user_id) GROUP BY h.user_id",
}
