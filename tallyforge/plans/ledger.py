"""Queries of the ledger and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.money import format_minor, half_even, parse_minor
from tallyforge.functions.periods import Period, period_label
from tallyforge.operators import ledger as L
from tallyforge.operators import validate as V
from tallyforge.plans import frames
from tallyforge.plans.statistics import rounded
from tallyforge.sources import ledgers as S

PERIOD = Period.parse("1997-Q2")
YEAR = Period.year(1997)
RATES = [("EUR", "USD", "1.0842"), ("GBP", "USD", "1.2713"), ("CHF", "USD", "1.1309"), ("USD", "JPY", "151.37"), ("EUR", "GBP", "0.8528"), ("EUR", "CHF", "0.9587"), ("GBP", "JPY", "192.44"), ("USD", "EUR", "0.9223")]
ACCOUNT = "assets.receivable"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(frames.postings(spark, sf_dir))


def postings_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same postings, dealt by transaction."""
    return _tagged(frames.postings_by_order(spark, sf_dir))


def _tagged(p: DataFrame) -> DataFrame:
    return p.withColumn("txn_tags", F.array(F.lower("tag"))).withColumn("post_tags", F.when(F.col("amount_minor") < 0, F.array(F.lit("sale")))).drop("tag")


def on_postings(f):
    return lambda spark, sf_dir: rounded(f(postings(spark, sf_dir)))


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivables of most nations, some of them closed, and the segments' income."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 7 <> 3").select(F.concat(F.lit("assets.receivable.n"), F.col("n_nationkey")).alias("code"), (F.col("n_nationkey") % 5 == 0).alias("closed"))
    income = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("s")).distinct().crossJoin(spark.createDataFrame([("f",), ("o",)], "st string")).select(F.concat(F.lit("income."), F.col("s"), F.lit("."), F.col("st")).alias("code"), F.lit(False).alias("closed"))
    return nations.unionByName(income)


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(postings(spark, sf_dir), chart(spark, sf_dir)).groupBy("code", "severity").agg(F.count("*").alias("n"))


def _rates(p: DataFrame) -> DataFrame:
    return S.rate_table(p.sparkSession, RATES)


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount texts of every spelling, parsed and shown again."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100, 0).cast("bigint").alias("m"))
    shown = format_minor(F.col("m"), F.lit("USD"), grouping=True)
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("$"), shown)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("-"), shown)).otherwise(F.concat(F.lit(" +"), shown))
    minor = parse_minor(text, F.lit("USD"))
    return rows.select("o_orderkey", minor.alias("minor"), format_minor(minor, F.lit("USD"), grouping=True).alias("shown"), half_even(F.col("m") * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1), F.lit(8)).alias("eighth"))



QUERIES = {
    "trial_balance": on_postings(L.trial_balance),
    "trial_balance_period": on_postings(lambda p: L.trial_balance(p, period=PERIOD, currency="eur")),
    "residual": on_postings(lambda p: L.residual(p, period=YEAR)),
    "balances_rolled_up": on_postings(lambda p: L.balances(p, leaves_only=False)),
    "balance_of_subtree": on_postings(lambda p: L.balance(p, ACCOUNT, currency="usd")),
    "default_currency": on_postings(lambda p: L.default_currency(p, ACCOUNT)),
    "transaction_sums": on_postings(L.transaction_sums),
    "account_statement": on_postings(lambda p: L.account_statement(p, "assets.receivable.n3", period=YEAR)),
    "account_statement_opening": on_postings(lambda p: L.account_statement(p, "assets.receivable.n3", period=PERIOD, opening=True)),
    "running_balances": on_postings(lambda p: L.running_balances(p).select("ordinal", "account", "currency", "balance_minor")),
    "income_statement": on_postings(lambda p: L.income_statement(p, period=YEAR)),
    "balance_sheet": on_postings(lambda p: L.balance_sheet(p, period=YEAR)),
    "balance_sheet_asof": on_postings(lambda p: L.balance_sheet(p, period=YEAR, cumulative=True)),
    "transaction_log": on_postings(lambda p: L.transaction_log(p, period=PERIOD)),
    "aging": on_postings(lambda p: L.aging(p, period=YEAR)),
    "stale_accounts": on_postings(lambda p: L.stale_accounts(p, window=1)),
    "cash_flow": on_postings(lambda p: L.cash_flow(p, "assets")),
    "with_tag": on_postings(lambda p: L.with_tag(p, "r").groupBy("account").agg(F.count("*").alias("n"))),
    "without_tag": on_postings(lambda p: L.with_tag(p, "r", present=False).groupBy("account").agg(F.count("*").alias("n"))),
    "accounts_parts": on_postings(lambda p: p.select("account").distinct().select("account", L.type_of(F.col("account")).alias("type"), F.array_join(L.parents_of(F.col("account")), "/").alias("parents"), L.depth_of(F.col("account")).alias("depth"), L.leaf_of(F.col("account")).alias("leaf"))),
    "converted_trial_balance": on_postings(lambda p: L.converted_trial_balance(p, _rates(p), "USD", bridge=True).select("account", "type", "from_currency", "currency", "balance_minor")),
    "converted_direct": on_postings(lambda p: L.converted(p, _rates(p), "USD", strict=False).groupBy("from_currency").agg(F.count("*").alias("n"), F.count("amount_minor").alias("n_converted"), F.sum("amount_minor").alias("amount_minor"))),
    "converted_bridge_jpy": on_postings(lambda p: L.converted(p, _rates(p), "JPY", bridge=True).groupBy("from_currency").agg(F.sum("amount_minor").alias("amount_minor"))),
    "missing_pairs": lambda spark, sf_dir: L.missing_pairs(S.rate_table(spark, RATES), postings(spark, sf_dir)),
    "validate_ledger": _validated,
    "duplicate_refs": on_postings(V.check_duplicate_refs),
    "chronological": on_postings(V.check_chronological),
    "money_texts": _money,
    "period_labels": on_postings(lambda p: p.select("date").distinct().select("date", period_label(F.col("date"), "year").alias("year"), period_label(F.col("date"), "quarter").alias("quarter"), period_label(F.col("date"), "month").alias("month"), PERIOD.next().contains(F.col("date")).alias("in_next"))),
    "report_registry": on_postings(lambda p: L.run_report("cash-flow", p, L.Options(account="assets", period=YEAR))),
    "csv_rows": on_postings(S.csv_rows),
    "transactions_json": on_postings(S.transactions_json),
    "ledger_text": on_postings(S.ledger_text),
}

_W = f"WITH p AS ({frames.POSTINGS})"
_TYPE = "CASE split_part(account, '.', 1) WHEN 'assets' THEN 'asset' WHEN 'income' THEN 'income' END"
_SIGN = "CASE split_part(account, '.', 1) WHEN 'assets' THEN 1 ELSE -1 END"
_Q2, _Y = "date BETWEEN DATE '1997-04-01' AND DATE '1997-06-30'", "date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
_R = ", r(base, quote, num, den) AS (VALUES ('EUR', 'USD', 5421, 5000), ('GBP', 'USD', 12713, 10000), ('CHF', 'USD', 11309, 10000), ('USD', 'JPY', 15137, 100))"
_LEGS = ", legs(currency, num, den) AS (VALUES ('USD', 1, 1), ('EUR', 9223, 10000), ('GBP', 10000, 12713), ('CHF', 10000, 11309), ('JPY', 15137, 100))"


def _half(n: str, d: str) -> str:
    r = f"((({n}) % ({d}) + ({d})) % ({d}))"
    q = f"((({n}) - {r}) // ({d}))"
    return f"({q} + CASE WHEN 2 * {r} > ({d}) OR (2 * {r} = ({d}) AND {q} % 2 <> 0) THEN 1 ELSE 0 END)::BIGINT"


def _movement(where: str) -> str:
    return f"m AS (SELECT txn_id, currency, min(date) AS date, min(line_no) AS line_no, min(description) AS description, sum(amount_minor)::BIGINT AS amount_minor FROM p WHERE account = 'assets.receivable.n3' AND {where} GROUP BY txn_id, currency), b AS (SELECT *, (sum(amount_minor) OVER (PARTITION BY currency ORDER BY date, line_no, txn_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance_minor FROM m)"



ORACLE_SQL = {
    "trial_balance": f"{_W} SELECT account, {_TYPE} AS type, currency, (sum(amount_minor) * {_SIGN})::BIGINT AS balance_minor FROM p GROUP BY account, currency",
    "trial_balance_period": f"{_W} SELECT account, {_TYPE} AS type, currency, (sum(amount_minor) * {_SIGN})::BIGINT AS balance_minor FROM p WHERE {_Q2} AND currency = 'EUR' GROUP BY account, currency",
    "residual": f"{_W} SELECT currency, sum(amount_minor)::BIGINT AS residual_minor FROM p WHERE {_Y} GROUP BY 1",
    "balances_rolled_up": f"{_W}, a AS (SELECT DISTINCT account FROM p), s AS (SELECT DISTINCT unnest([array_to_string(string_split(account, '.')[1:k], '.') FOR k IN range(1, len(string_split(account, '.')) + 1)]) AS account FROM a) SELECT s.account, currency, sum(amount_minor)::BIGINT AS amount_minor FROM s JOIN p ON p.account = s.account OR starts_with(p.account, s.account || '.') GROUP BY ALL",
    "balance_of_subtree": f"{_W} SELECT 'USD' AS currency, sum(amount_minor)::BIGINT AS amount_minor FROM p WHERE currency = 'USD' AND account LIKE 'assets.receivable%'",
    "default_currency": f"{_W}, c AS (SELECT currency, count(*) AS n FROM p WHERE account LIKE 'assets.receivable%' GROUP BY 1) SELECT currency FROM c ORDER BY n DESC, currency DESC LIMIT 1",
    "transaction_sums": f"{_W} SELECT txn_id, currency, sum(amount_minor)::BIGINT AS net_minor FROM p GROUP BY ALL",
    "account_statement": f"{_W}, {_movement(_Y)} SELECT date::VARCHAR AS date, line_no, txn_id, description, currency, amount_minor, balance_minor FROM b",
    "account_statement_opening": f"{_W}, {_movement('true')} SELECT date::VARCHAR AS date, line_no, txn_id, description, currency, amount_minor, balance_minor FROM b WHERE {_Q2}",
    "running_balances": f"{_W} SELECT ordinal, account, currency, (sum(amount_minor) OVER (PARTITION BY account, currency ORDER BY date, line_no, ordinal, amount_minor ROWS UNBOUNDED PRECEDING))::BIGINT AS balance_minor FROM p",
    "income_statement": f"{_W} SELECT 'income' AS section, currency, -sum(amount_minor)::BIGINT AS amount_minor FROM p WHERE account LIKE 'income.%' AND {_Y} GROUP BY currency UNION ALL SELECT 'net', currency, -sum(amount_minor)::BIGINT FROM p WHERE account LIKE 'income.%' AND {_Y} GROUP BY currency",
    "balance_sheet": f"{_W} SELECT 'asset' AS section, currency, sum(amount_minor)::BIGINT AS amount_minor FROM p WHERE account LIKE 'assets.%' AND {_Y} GROUP BY currency",
    "balance_sheet_asof": f"{_W} SELECT 'asset' AS section, currency, sum(amount_minor)::BIGINT AS amount_minor FROM p WHERE account LIKE 'assets.%' AND date <= DATE '1997-12-31' GROUP BY currency",
    "transaction_log": f"{_W} SELECT txn_id, min(date)::VARCHAR AS date, min(line_no) AS line_no, coalesce(nullif(min(ref), ''), '-') AS ref, min(description) AS description, array_to_string(list_sort(list_distinct(list_concat(list(lower(tag)), list(CASE WHEN amount_minor < 0 THEN 'sale' ELSE lower(tag) END)))), ',') AS tags, count(*) AS postings FROM p WHERE {_Q2} GROUP BY txn_id",
    "aging": f"{_W}, a AS (SELECT currency, amount_minor, DATE '1997-12-31' - date AS age FROM p WHERE account LIKE 'assets.receivable%' AND {_Y}) SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '0-60' WHEN age <= 90 THEN '0-90' ELSE '90+' END AS bucket, currency, sum(amount_minor)::BIGINT AS amount_minor FROM a GROUP BY ALL",
    "stale_accounts": f"{_W}, l AS (SELECT account, max(date) AS last_date FROM p GROUP BY 1), e AS (SELECT max(date) AS as_at FROM p) SELECT account, last_date::VARCHAR AS last_date, (as_at - last_date)::BIGINT AS days_idle FROM l, e WHERE as_at - last_date > 1",
    "cash_flow": f"{_W} SELECT strftime(date, '%Y-%m') AS month, currency, coalesce(sum(amount_minor) FILTER (amount_minor > 0), 0)::BIGINT AS inflow_minor, coalesce(-sum(amount_minor) FILTER (amount_minor < 0), 0)::BIGINT AS outflow_minor, sum(amount_minor)::BIGINT AS net_minor FROM p WHERE account LIKE 'assets.%' GROUP BY ALL",
    "with_tag": f"{_W} SELECT account, count(*) AS n FROM p WHERE txn_id IN (SELECT txn_id FROM p WHERE lower(tag) = 'r') GROUP BY 1",
    "without_tag": f"{_W} SELECT account, count(*) AS n FROM p WHERE txn_id NOT IN (SELECT txn_id FROM p WHERE lower(tag) = 'r') GROUP BY 1",
    "accounts_parts": f"{_W}, a AS (SELECT DISTINCT account, string_split(account, '.') AS s FROM p) SELECT account, {_TYPE} AS type, array_to_string([array_to_string(s[1:k], '.') FOR k IN range(1, len(s))], '/') AS parents, len(s) - 1 AS depth, s[-1] AS leaf FROM a",
    "converted_trial_balance": f"{_W}{_LEGS}, t AS (SELECT account, {_TYPE} AS type, currency, sum(amount_minor)::HUGEINT * {_SIGN} AS b FROM p GROUP BY account, currency) SELECT account, type, t.currency AS from_currency, 'USD' AS currency, {_half('b * den * CASE WHEN t.currency = $$JPY$$ THEN 100 ELSE 1 END', 'num')} AS balance_minor FROM t JOIN legs USING (currency)".replace("$$", "'"),
    "converted_direct": f"{_W}{_R}, c AS (SELECT p.currency, CASE WHEN p.currency = 'USD' THEN amount_minor WHEN num IS NOT NULL THEN {_half('amount_minor::HUGEINT * num', 'den')} END AS v FROM p LEFT JOIN r ON r.base = p.currency AND r.quote = 'USD') SELECT currency AS from_currency, count(*) AS n, count(v) AS n_converted, sum(v)::BIGINT AS amount_minor FROM c GROUP BY 1",
    "converted_bridge_jpy": f"{_W}{_LEGS}, c AS (SELECT p.currency, {_half('amount_minor::HUGEINT * den * 15137', 'num * 100::HUGEINT * CASE WHEN p.currency = $$JPY$$ THEN 1 ELSE 100 END')} AS v FROM p JOIN legs USING (currency)) SELECT currency AS from_currency, sum(v)::BIGINT AS amount_minor FROM c GROUP BY 1".replace("$$", "'"),
    "missing_pairs": f"{_W}, c AS (SELECT DISTINCT currency AS x FROM p) SELECT a.x AS base, b.x AS quote FROM c a JOIN c b ON a.x <> b.x WHERE a.x || b.x NOT IN ('EURUSD', 'GBPUSD', 'CHFUSD', 'USDJPY', 'EURGBP', 'EURCHF', 'GBPJPY', 'USDEUR')",
    "validate_ledger": f"""{_W}, chart AS (SELECT 'assets.receivable.n' || n_nationkey AS code, n_nationkey % 5 = 0 AS closed FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT DISTINCT 'income.' || lower(c_mktsegment) || '.' || st, false FROM customer, (VALUES ('f'), ('o')) s(st)),
t AS (SELECT txn_id, min(line_no) AS line_no, min(date) AS date, min(ref) AS ref, min(description) AS description FROM p GROUP BY 1),
net AS (SELECT txn_id, currency FROM p GROUP BY ALL HAVING sum(amount_minor) <> 0),
o AS (SELECT date, lag(date) OVER (ORDER BY line_no, txn_id) AS before FROM t),
dup AS (SELECT row_number() OVER (PARTITION BY ref ORDER BY date, line_no, txn_id) AS k FROM t WHERE coalesce(ref, '') <> ''),
par AS (SELECT DISTINCT unnest([array_to_string(string_split(code, '.')[1:k], '.') FOR k IN range(1, len(string_split(code, '.')))]) AS x FROM chart)
SELECT * FROM (SELECT 'unbalanced' AS code, 'error' AS severity, count(*) AS n FROM net UNION ALL SELECT 'unknown-account', 'error', count(DISTINCT account) FROM p WHERE account NOT IN (SELECT code FROM chart)
UNION ALL SELECT 'closed-account', 'error', count(*) FROM p JOIN chart ON code = account WHERE closed UNION ALL SELECT 'duplicate-ref', 'warning', count(*) FROM dup WHERE k > 1
UNION ALL SELECT 'mixed-currency-account', 'warning', count(*) FROM (SELECT account FROM p GROUP BY 1 HAVING count(DISTINCT currency) > 1) UNION ALL SELECT 'out-of-order', 'error', count(*) FROM o WHERE date < before
UNION ALL SELECT 'empty-description', 'warning', count(*) FROM t WHERE trim(coalesce(description, '')) = '' UNION ALL SELECT 'implied-parent', 'warning', count(*) FROM par WHERE x NOT IN (SELECT code FROM chart)) WHERE n > 0""",
    "duplicate_refs": f"{_W}, t AS (SELECT txn_id, min(line_no) AS line_no, min(date) AS date, min(ref) AS ref FROM p GROUP BY 1), k AS (SELECT *, row_number() OVER w AS k, first_value(line_no) OVER w AS f FROM t WHERE coalesce(ref, '') <> '' WINDOW w AS (PARTITION BY ref ORDER BY date, line_no, txn_id)) SELECT 'duplicate-ref' AS code, 'warning' AS severity, 'first at line ' || f AS message, line_no, ref FROM k WHERE k > 1",
    "chronological": f"{_W}, t AS (SELECT txn_id, min(line_no) AS line_no, min(date) AS date, min(ref) AS ref FROM p GROUP BY 1), o AS (SELECT *, lag(date) OVER (ORDER BY line_no, txn_id) AS before FROM t) SELECT 'out-of-order' AS code, 'error' AS severity, date || ' after ' || before AS message, line_no, ref FROM o WHERE date < before",
    "money_texts": f"WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS m FROM orders), s AS (SELECT *, CASE WHEN o_orderkey % 4 IN (0, 2) THEN -m ELSE m END AS minor FROM o) SELECT o_orderkey, minor, CASE WHEN minor < 0 THEN '-' ELSE '' END || format('{{:,}}', abs(minor) // 100) || '.' || lpad((abs(minor) % 100)::VARCHAR, 2, '0') AS shown, {_half('CASE WHEN o_orderkey % 2 = 0 THEN -m ELSE m END', '8')} AS eighth FROM s",
    "period_labels": f"{_W} SELECT DISTINCT date::VARCHAR AS date, year(date)::VARCHAR AS year, year(date) || '-Q' || quarter(date) AS quarter, strftime(date, '%Y-%m') AS month, date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30' AS in_next FROM p",
    "report_registry": f"{_W} SELECT strftime(date, '%Y-%m') AS month, currency, coalesce(sum(amount_minor) FILTER (amount_minor > 0), 0)::BIGINT AS inflow_minor, coalesce(-sum(amount_minor) FILTER (amount_minor < 0), 0)::BIGINT AS outflow_minor, sum(amount_minor)::BIGINT AS net_minor FROM p WHERE account LIKE 'assets.%' AND {_Y} GROUP BY ALL",
    "csv_rows": f"{_W} SELECT date::VARCHAR AS date, coalesce(ref, '') AS ref, description, lower(tag) || CASE WHEN amount_minor < 0 THEN ' sale' ELSE '' END AS tags, account, CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || CASE WHEN currency = 'JPY' THEN abs(amount_minor)::VARCHAR ELSE (abs(amount_minor) // 100) || '.' || lpad((abs(amount_minor) % 100)::VARCHAR, 2, '0') END AS amount, currency FROM p",
}

_AMOUNT = "CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || CASE WHEN currency = 'JPY' THEN abs(amount_minor)::VARCHAR ELSE (abs(amount_minor) // 100) || '.' || lpad((abs(amount_minor) % 100)::VARCHAR, 2, '0') END"
_LEG = f"""'{{"account":"' || account || '","amount":"' || {_AMOUNT} || '","minor":' || amount_minor || ',"currency":"' || currency || '","tags":[' || CASE WHEN amount_minor < 0 THEN '"sale"' ELSE '' END || ']}}'"""
ORACLE_SQL["transactions_json"] = f"""{_W} SELECT txn_id, min(date)::VARCHAR AS date, min(line_no) AS line_no, '{{"date":"' || min(date)::VARCHAR || '","description":"' || min(description) || '","line_no":' || min(line_no) || ',"postings":[' || string_agg({_LEG}, ',' ORDER BY ordinal, account, {_AMOUNT}) || ']' || coalesce(',"ref":"' || min(ref) || '"', '') || ',"tags":["' || min(lower(tag)) || '"]}}' AS json FROM p GROUP BY txn_id"""
_LINE = f"'    ' || rpad(account, 32, ' ') || lpad({_AMOUNT}, 14, ' ') || ' ' || currency || CASE WHEN amount_minor < 0 THEN '  #sale' ELSE '' END"
ORACLE_SQL["ledger_text"] = f"""{_W} SELECT min(date)::VARCHAR AS date, min(line_no) AS line_no, min(date)::VARCHAR || ' ' || min(description) || '  #' || min(lower(tag)) || coalesce('  ^' || min(ref), '') || chr(10) || string_agg({_LINE}, chr(10) ORDER BY ordinal, {_LINE}) AS text FROM p GROUP BY txn_id"""

