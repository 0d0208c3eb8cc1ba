"""The driver's tables seen as the engine's frames: events as runs and probes, orders and lines as a ledger.

Each frame is one projection in SQL that Spark and DuckDB both read; only the
JSON access differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = {"spark": "cast(get_json_object(props, '$.k') as int)", "duckdb": "cast(json_extract_string(props, '$.k') as int)"}

_TRACE = """
SELECT event_id, concat('r', event_id) AS run_id, concat('t', user_id) AS task_id, user_id,
  CASE event_type WHEN 'view' THEN 'ctrl' WHEN 'click' THEN 'd1' WHEN 'purchase' THEN 'd2' WHEN 'signup' THEN 'd3' ELSE 'd2-dist' END AS condition_id,
  CASE WHEN k % 23 = 0 THEN NULL ELSE k % 17 <> 0 END AS analyzable,
  CASE WHEN k % 29 = 0 THEN NULL ELSE k % 19 = 0 END AS quarantined,
  CASE WHEN k % 31 = 0 THEN 'weak' WHEN k % 37 = 0 THEN NULL ELSE 'ok' END AS prior_check_status,
  CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN 'manifest_canary' WHEN event_type = 'purchase' THEN 'manifest_canary' WHEN k % 43 = 0 THEN NULL ELSE 'event_stream' END AS exposure_basis,
  CASE WHEN k % 41 = 0 THEN NULL ELSE event_type <> 'view' END AS available,
  CASE WHEN k % 11 = 0 THEN NULL ELSE value > 30 + (event_id % 7) * 5 END AS read,
  CASE WHEN k % 11 = 0 THEN NULL ELSE value > 45 END AS read_inbound_only,
  CASE WHEN k % 7 = 3 THEN NULL ELSE value > 60 END AS opened,
  CASE WHEN k % 13 = 0 THEN NULL ELSE (k + event_id) % 3 = 0 END AS used,
  CASE WHEN k % 47 = 0 THEN NULL ELSE k % 5 <> 0 END AS eligible,
  CASE WHEN k % 9 = 4 THEN NULL ELSE (k + user_id) % 4 = 0 END AS success,
  CASE WHEN k % 10 = 7 THEN NULL ELSE k % 2 = 0 END AS ever_mention,
  CASE WHEN k % 53 = 0 THEN NULL ELSE k % 6 = 0 END AS echoed,
  CASE WHEN k % 12 = 5 THEN NULL ELSE k % 50 = 1 END AS unexplained_possession,
  CASE WHEN k % 8 = 0 THEN NULL ELSE k % 8 <> 1 END AS factor_probe,
  CASE WHEN k % 6 = 1 THEN NULL ELSE k % 6 = 2 END AS wrong_value_in_slot,
  CASE WHEN k % 6 = 1 THEN NULL ELSE cast(k % 4 AS double) / 4 END AS slot_precision,
  CASE WHEN event_type = 'error' THEN k % 3 ELSE NULL END AS factor_distractors,
  CASE WHEN k % 3 = 0 THEN k % 11 ELSE NULL END AS lapse,
  CASE WHEN k % 10 = 9 THEN NULL ELSE 2 + k % 13 END AS horizon,
  CASE WHEN k % 4 = 1 THEN 'truncated_run' ELSE NULL END AS censor_reason,
  k % 5 AS first_mention_probe_index,
  CASE WHEN k % 7 = 2 THEN k % 5 + event_id % 9 - 1 ELSE NULL END AS first_use_probe_index,
  CASE WHEN k % 71 = 0 THEN NULL ELSE concat('v', k % 3) END AS accounting_version
FROM (SELECT *, {k} AS k FROM {events}) AS e
"""

_PROBES = """
SELECT concat('r', user_id, '-', event_type) AS run_id, concat('t', user_id % 40) AS task_id,
  CASE event_type WHEN 'view' THEN 'ctrl' WHEN 'click' THEN 'd1' WHEN 'purchase' THEN 'd2' WHEN 'signup' THEN 'd3' ELSE 'd2-dist' END AS condition_id,
  CASE WHEN k % 9 = 0 THEN NULL ELSE k % 9 < 8 END AS parse_ok,
  CASE WHEN k % 9 < 6 THEN 'strict' WHEN k % 9 < 8 THEN 'lenient' ELSE 'failed' END AS parse_tier,
  CASE k % 10 WHEN 0 THEN 'superseded' WHEN 1 THEN 'unanswered' WHEN 2 THEN NULL ELSE 'answered' END AS outcome,
  CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 = 1 END AS retry_sent,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (k + event_id) % 5 < 3 END AS fidelity_agree,
  k % 3 AS n_critical_fact_slots, k % 2 AS n_task_restatement_slots, CASE WHEN k % 6 = 0 THEN NULL ELSE 1 END AS n_generic_workspace_slots,
  k % 4 AS n_filler_slots, 0 AS n_empty_slots, k % 5 AS n_distrusted_slots
FROM (SELECT *, {k} AS k FROM {events}) AS e
"""

_POSTINGS = """
SELECT l_orderkey * 16 + l_linenumber * 2 + side AS ordinal, l_orderkey AS txn_id, cast(l_shipdate AS date) AS date, l_orderkey * 8 + l_linenumber AS line_no,
  CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE concat('order ', l_orderkey) END AS description,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('REF', l_partkey % 5000) END AS ref,
  CASE WHEN side = 0 THEN concat('income.', lower(c_mktsegment), '.', lower(o_orderstatus)) ELSE concat('assets.receivable.n', c_nationkey) END AS account,
  CASE WHEN side = 0 THEN -1 ELSE 1 END * cast(round(l_extendedprice * 100) AS bigint) AS amount_minor,
  CASE n_regionkey WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' WHEN 3 THEN 'GBP' ELSE 'CHF' END AS currency,
  l_returnflag AS tag
FROM {lineitem} AS l JOIN {orders} AS o ON l_orderkey = o_orderkey JOIN {customer} AS c ON o_custkey = c_custkey JOIN {nation} AS n ON c_nationkey = n_nationkey
CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side) AS sides
"""


def _sql(template: str, dialect: str, at: str | None = None) -> str:
    names = ("events", "lineitem", "orders", "customer", "nation")
    return template.format(k=_K[dialect], **{t: f"parquet.`{at}/{t}.parquet`" if dialect == "spark" else t for t in names}).strip()


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_sql(_TRACE, "spark", sf_dir))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_sql(_PROBES, "spark", sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_sql(_POSTINGS, "spark", sf_dir))


#: The tables of ``_POSTINGS`` with what belongs to an order joined first, so that lines of orders are dealt once, by transaction.
_BY_ORDER = "FROM {lineitem} AS l JOIN (SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) AS o ON l_orderkey = o_orderkey"


def postings_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`postings`, dealt by transaction: grouping by it needs no further shuffle."""
    head, sides = _POSTINGS.partition("\nFROM")[0], _POSTINGS.partition("\nCROSS")[2]
    return spark.sql(_sql(f"{head}\n{_BY_ORDER}\nCROSS{sides}", "spark", sf_dir))


TRACE = _sql(_TRACE, "duckdb")
PROBES = _sql(_PROBES, "duckdb")
POSTINGS = _sql(_POSTINGS, "duckdb")
