"""Double-entry ledger queries over flat postings.

Postings: txn_id, date, line_no, ordinal, ref, description, txn_tags, account,
amount_minor, currency, post_tags.  Amounts are integers in minor units; a sum
never crosses currencies.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import scale_minor
from tallyforge.functions.periods import Period
from tallyforge.operators.prefix import running_sum

#: The six roots, their types, and the side on which each type grows.
ROOT_TYPES = {"assets": "asset", "liabilities": "liability", "equity": "equity", "income": "income", "revenue": "income", "expenses": "expense"}
NORMAL_BALANCE = {"asset": 1, "expense": 1, "liability": -1, "equity": -1, "income": -1}
#: Ageing buckets, by their labels, up to so many days.
AGE_BUCKETS = (("0-30", 30), ("0-60", 60), ("0-90", 90), ("90+", None))


def root_of(account: Column) -> Column:
    return F.lower(F.split_part(account, F.lit("."), F.lit(1)))


def type_of(account: Column, *, strict: bool = True) -> Column:
    """The account's type by its first segment; an unknown root is an error, or null if not strict."""
    out = F.lit(None).cast("string")
    for root, kind in ROOT_TYPES.items():
        out = F.when(root_of(account) == root, kind).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown account root: "), account)).cast("string")) if strict else out


def normal_sign(kind: Column) -> Column:
    return F.when(kind.isin("asset", "expense"), 1).otherwise(-1)


def is_under(account: Column, root: str) -> Column:
    """The root itself or anything below it; a prefix that Parquet scans take as a filter."""
    return (account == root) | account.startswith(f"{root}.")


def parents_of(account: Column) -> Column:
    """Ancestors, shallowest first."""
    parts = F.split(account, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def depth_of(account: Column) -> Column:
    return F.size(F.split(account, r"\.")) - 1


def leaf_of(account: Column) -> Column:
    return F.element_at(F.split(account, r"\."), -1)


def in_period(postings: DataFrame, period: Period | None) -> DataFrame:
    return postings if period is None else postings.where(period.contains(F.col("date")))


def with_tag(postings: DataFrame, tag: str, *, present: bool = True) -> DataFrame:
    """Postings of transactions that have the tag on themselves or on any posting."""
    own = F.array_contains(F.coalesce("txn_tags", F.array().cast("array<string>")), tag) | F.array_contains(F.coalesce("post_tags", F.array().cast("array<string>")), tag)
    tagged = postings.where(own).select(F.col("txn_id").alias("_txn")).distinct()
    return postings.join(tagged, F.col("txn_id") == F.col("_txn"), "left_semi" if present else "left_anti")


def of_account(postings: DataFrame, account: str, *, include_children: bool = True) -> DataFrame:
    return postings.where(is_under(F.col("account"), account) if include_children else F.col("account") == account)


def balances(postings: DataFrame, *, leaves_only: bool = True) -> DataFrame:
    """(account, currency, amount_minor); without leaves_only, every ancestor has its subtree's sum.

    Postings are summed before they are spread to ancestors, so the spread rows
    are accounts, not postings.
    """
    own = postings.groupBy("account", "currency").agg(F.sum("amount_minor").alias("amount_minor"))
    if leaves_only:
        return own
    spread = own.select(F.explode(F.concat(parents_of(F.col("account")), F.array("account"))).alias("account"), "currency", "amount_minor")
    return spread.groupBy("account", "currency").agg(F.sum("amount_minor").alias("amount_minor"))


def balance(postings: DataFrame, account: str, *, include_children: bool = True, currency: str | None = None) -> DataFrame:
    """One row (currency, amount_minor); several currencies without a choice are an error, none is zero USD."""
    rows = of_account(postings, account, include_children=include_children)
    if currency:
        return rows.where(F.col("currency") == currency.upper()).agg(F.lit(currency.upper()).alias("currency"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("amount_minor"))
    out = rows.agg(F.min("currency").alias("currency"), F.max("currency").alias("other"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("amount_minor"))
    mixed = F.col("currency") != F.col("other")
    return out.select(F.when(mixed, F.raise_error(F.lit(f"{account} has several currencies")).cast("string")).otherwise(F.coalesce("currency", F.lit("USD"))).alias("currency"), "amount_minor")


def default_currency(postings: DataFrame, account: str, chart: DataFrame | None = None) -> DataFrame:
    """The chart's currency, else the commonest in the subtree (ties to the larger code), else the least in use, else USD."""
    counts = of_account(postings, account).groupBy("currency").agg(F.count("*").alias("n")).agg(F.max_by("currency", F.struct("n", "currency")).alias("mode"))
    out = counts.crossJoin(postings.agg(F.min("currency").alias("first")))
    given = chart.where(F.col("code") == account).agg(F.first("currency").alias("charted")) if chart is not None else None
    out = out.crossJoin(given) if given is not None else out.withColumn("charted", F.lit(None).cast("string"))
    return out.select(F.coalesce("charted", "mode", "first", F.lit("USD")).alias("currency"))


def transaction_sums(postings: DataFrame) -> DataFrame:
    """Net of every transaction by currency; balanced ones are zero."""
    return postings.groupBy("txn_id", "currency").agg(F.sum("amount_minor").alias("net_minor"))


def trial_balance(postings: DataFrame, *, period: Period | None = None, currency: str | None = None) -> DataFrame:
    """(account, type, currency, balance_minor) on each account's natural side."""
    rows = in_period(postings, period)
    if currency:
        rows = rows.where(F.col("currency") == currency.upper())
    kind = type_of(F.col("account"))
    return balances(rows).select("account", kind.alias("type"), "currency", (F.col("amount_minor") * normal_sign(kind)).alias("balance_minor"))


def residual(postings: DataFrame, *, period: Period | None = None) -> DataFrame:
    return in_period(postings, period).groupBy("currency").agg(F.sum("amount_minor").alias("residual_minor"))


def per_transaction(postings: DataFrame, account: str) -> DataFrame:
    """Movements of an account's subtree: one row a transaction and currency."""
    return of_account(postings, account).groupBy("txn_id", "currency").agg(F.min("date").alias("date"), F.min("line_no").alias("line_no"), F.min("description").alias("description"), F.sum("amount_minor").alias("amount_minor"))


def account_statement(postings: DataFrame, account: str, *, period: Period | None = None, currency: str | None = None, limit: int | None = None, opening: bool = False) -> DataFrame:
    """Movements with a running balance, which starts at what came before the period if ``opening``."""
    rows = per_transaction(postings if opening else in_period(postings, period), account)
    if currency:
        rows = rows.where(F.col("currency") == currency.upper())
    out = running_sum(rows, ["currency"], "date", ["line_no", "txn_id"], "amount_minor", "balance_minor")
    if opening:
        out = in_period(out, period)
    if limit:
        out = out.orderBy(F.desc("date"), F.desc("line_no"), F.desc("txn_id")).limit(limit)
    return out.select("date", "line_no", "txn_id", "description", "currency", "amount_minor", "balance_minor")


def running_balances(postings: DataFrame) -> DataFrame:
    """Every account's running balance by currency."""
    return running_sum(postings, ["account", "currency"], "date", ["line_no", "ordinal", "amount_minor"], "amount_minor", "balance_minor")


def totals_by_type(postings: DataFrame, kinds: tuple[str, ...], period: Period | None = None) -> DataFrame:
    kind = type_of(F.col("account"))
    by = balances(in_period(postings, period)).withColumn("section", kind).where(F.col("section").isin(*kinds))
    return by.groupBy("section", "currency").agg(F.sum("amount_minor").alias("raw_minor"))


def income_statement(postings: DataFrame, *, period: Period | None = None) -> DataFrame:
    """Income and expense by currency on their natural sides, and what is left of them as net."""
    t = totals_by_type(postings, ("income", "expense"), period)
    parts = t.select("section", "currency", (F.col("raw_minor") * normal_sign(F.col("section"))).alias("amount_minor"))
    return parts.unionByName(t.groupBy("currency").agg((-F.sum("raw_minor")).alias("amount_minor")).select(F.lit("net").alias("section"), "currency", "amount_minor"))


def balance_sheet(postings: DataFrame, *, period: Period | None = None, cumulative: bool = False) -> DataFrame:
    """Movements of assets, liabilities and equity inside the period; cumulative, all up to its end."""
    if cumulative and period is not None:
        postings, period = postings.where(F.col("date") <= F.lit(period.end)), None
    t = totals_by_type(postings, ("asset", "liability", "equity"), period)
    return t.select("section", "currency", (F.col("raw_minor") * normal_sign(F.col("section"))).alias("amount_minor"))


def transaction_log(postings: DataFrame, *, period: Period | None = None, limit: int | None = None) -> DataFrame:
    """One row a transaction, the last ``limit`` by date and line."""
    none = F.array().cast("array<string>")
    rows = in_period(postings, period).groupBy("txn_id").agg(F.min("date").alias("date"), F.min("line_no").alias("line_no"), F.coalesce(F.nullif(F.min("ref"), F.lit("")), F.lit("-")).alias("ref"), F.min("description").alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.coalesce("txn_tags", none), F.coalesce("post_tags", none)))))).alias("tags"), F.count("*").alias("postings"))
    rows = rows.withColumn("tags", F.coalesce(F.nullif(F.array_join("tags", ","), F.lit("")), F.lit("-")))
    return rows.orderBy(F.desc("date"), F.desc("line_no"), F.desc("txn_id")).limit(limit) if limit else rows


def as_at(postings: DataFrame, period: Period | None) -> DataFrame:
    """One row: the end of the period, else the last date."""
    return postings.agg(F.lit(period.end).alias("as_at")) if period else postings.agg(F.max("date").alias("as_at"))


def bucket_of(days: Column) -> Column:
    out = None
    for label, most in AGE_BUCKETS:
        if most is not None:
            out = F.when(days <= most, label) if out is None else out.when(days <= most, label)
        else:
            return out.otherwise(label)
    return out


def aging(postings: DataFrame, account: str = "assets.receivable", *, period: Period | None = None) -> DataFrame:
    """Net of the subtree by age bucket and currency. The buckets are disjoint, whatever their labels say."""
    rows = of_account(in_period(postings, period), account).groupBy("date", "currency").agg(F.sum("amount_minor").alias("amount_minor"))
    rows = rows.crossJoin(as_at(postings, period))  # one row
    return rows.groupBy(bucket_of(F.datediff("as_at", "date")).alias("bucket"), "currency").agg(F.sum("amount_minor").alias("amount_minor"))


def stale_accounts(postings: DataFrame, *, window: int = 180, period: Period | None = None) -> DataFrame:
    """Accounts without activity for more than ``window`` days."""
    last = in_period(postings, period).groupBy("account").agg(F.max("date").alias("last_date")).crossJoin(as_at(postings, period))
    return last.select("account", "last_date", F.datediff("as_at", "last_date").cast("long").alias("days_idle")).where(F.col("days_idle") > window)


def cash_flow(postings: DataFrame, account: str = "assets.cash", *, period: Period | None = None) -> DataFrame:
    """(month, currency, inflow, outflow, net) of the subtree."""
    a = F.col("amount_minor")
    rows = of_account(in_period(postings, period), account).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "currency")
    return rows.agg(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).alias("inflow_minor"), F.coalesce(-F.sum(F.when(a < 0, a)), F.lit(0)).alias("outflow_minor"), F.sum(a).alias("net_minor"))


def direct_rate(rows: DataFrame, rates: DataFrame, source: str, target: str) -> DataFrame:
    """``rows`` with num and den of the pair; the same currency is 1, a missing pair null. Rates are a small table of checked size."""
    r = rates.where(F.col("quote") == target).select(F.col("base").alias("_base"), F.col("num").alias("_num"), F.col("den").alias("_den"))
    out = rows.join(r, F.col(source) == F.col("_base"), "left")
    same = F.col(source) == target
    return out.withColumn("num", F.when(same, 1).otherwise(F.col("_num")).cast("decimal(38,0)")).withColumn("den", F.when(same, 1).otherwise(F.col("_den")).cast("decimal(38,0)")).drop("_base", "_num", "_den")


def usd_legs(rates: DataFrame) -> DataFrame:
    """(currency, num, den) of one USD in each currency: the quoted pair, else the inverse of the opposite."""
    quoted = rates.where(F.col("base") == "USD").select(F.col("quote").alias("currency"), "num", "den", F.lit(0).alias("rank"))
    inverse = rates.where(F.col("quote") == "USD").select(F.col("base").alias("currency"), F.col("den").alias("num"), F.col("num").alias("den"), F.lit(1).alias("rank"))
    legs = quoted.unionByName(inverse).groupBy("currency").agg(F.min_by(F.struct("num", "den"), "rank").alias("leg"))
    one = F.lit(1).cast("decimal(38,0)")
    usd = rates.agg(F.lit("USD").alias("currency"), F.max(one).alias("num"), F.max(one).alias("den")).select("currency", F.coalesce("num", one).alias("num"), F.coalesce("den", one).alias("den"))
    return legs.select("currency", "leg.num", "leg.den").where("currency <> 'USD'").unionByName(usd)


def bridge_rate(rows: DataFrame, rates: DataFrame, source: str, target: str) -> DataFrame:
    """``rows`` with num and den of the rate over USD."""
    legs = usd_legs(rates)
    a = legs.select(F.col("currency").alias("_a"), F.col("num").alias("_an"), F.col("den").alias("_ad"))
    b = legs.where(F.col("currency") == target).select(F.col("num").alias("_bn"), F.col("den").alias("_bd"))
    out = rows.join(a, F.col(source) == F.col("_a"), "left").join(b, F.lit(True), "left")  # one row on the right
    return out.withColumn("num", F.col("_bn") * F.col("_ad")).withColumn("den", F.col("_bd") * F.col("_an")).drop("_a", "_an", "_ad", "_bn", "_bd")


def converted(rows: DataFrame, rates: DataFrame, target: str, *, amount: str = "amount_minor", currency: str = "currency", bridge: bool = False, strict: bool = True) -> DataFrame:
    """``rows`` in one currency, each amount rounded once; a missing rate is an error, or null if not strict."""
    out = (bridge_rate if bridge else direct_rate)(rows, rates, currency, target)
    value = scale_minor(F.col(amount), F.col(currency), F.lit(target), F.col("num"), F.col("den"))
    missing = F.raise_error(F.concat(F.lit("no rate for "), F.col(currency))).cast("bigint") if strict else F.lit(None).cast("bigint")
    return out.withColumn(amount, F.when(F.col("num").isNull(), missing).otherwise(value)).withColumn("from_currency", F.col(currency)).withColumn(currency, F.lit(target)).drop("num", "den")


def converted_trial_balance(postings: DataFrame, rates: DataFrame, target: str, *, period: Period | None = None, bridge: bool = False) -> DataFrame:
    """The trial balance with every (account, currency) balance converted."""
    return converted(trial_balance(postings, period=period), rates, target, amount="balance_minor", bridge=bridge)


def missing_pairs(rates: DataFrame, postings: DataFrame) -> DataFrame:
    """Ordered pairs of the postings' currencies without a direct quote; as many as there are currencies, squared."""
    used = postings.agg(F.collect_set("currency").alias("c"))
    listed = used.select(F.explode("c").alias("base"), "c").select("base", F.explode("c").alias("quote")).where("base <> quote")
    return listed.join(rates.select("base", "quote"), ["base", "quote"], "left_anti")


def merged(*ledgers: DataFrame) -> DataFrame:
    """All postings of several ledgers."""
    out = ledgers[0]
    for other in ledgers[1:]:
        out = out.unionByName(other)
    return out


@dataclass
class Options:
    period: Period | None = None
    account: str | None = None
    currency: str | None = None
    limit: int | None = None
    window: int = 180
    extra: dict = field(default_factory=dict)


_REPORTS: dict[str, tuple] = {}


def register(name: str, fn, *, doc: str = "", origin: str = "builtin") -> None:
    """Add a report (postings, options) -> DataFrame; the last of a name wins."""
    _REPORTS[name] = (fn, doc or (fn.__doc__ or "").strip().split("\n")[0], origin)


def run_report(name: str, postings: DataFrame, options: Options | None = None) -> DataFrame:
    if name not in _REPORTS:
        raise KeyError(f"no report {name!r}; there are {', '.join(available())}")
    return _REPORTS[name][0](postings, options or Options())


def available() -> list[str]:
    return sorted(_REPORTS)


def describe() -> list[tuple[str, str, str]]:
    return [(n, d, o) for n, (_, d, o) in sorted(_REPORTS.items())]


def _statement(p: DataFrame, o: Options) -> DataFrame:
    if not o.account:
        raise ValueError("account-statement needs an account")
    return account_statement(p, o.account, period=o.period, currency=o.currency, limit=o.limit)


register("trial-balance", lambda p, o: trial_balance(p, period=o.period, currency=o.currency), doc="Balance of every account and currency")
register("account-statement", _statement, doc="Movements of an account with a running balance")
register("income-statement", lambda p, o: income_statement(p, period=o.period), doc="Income, expense and net")
register("balance-sheet", lambda p, o: balance_sheet(p, period=o.period), doc="Movements of assets, liabilities and equity in the period")
register("balance-sheet-asof", lambda p, o: balance_sheet(p, period=o.period, cumulative=True), doc="Assets, liabilities and equity up to the period's end")
register("transaction-log", lambda p, o: transaction_log(p, period=o.period, limit=o.limit), doc="One row a transaction")
register("aging", lambda p, o: aging(p, o.account or "assets.receivable", period=o.period), doc="Open amounts by age")
register("stale-accounts", lambda p, o: stale_accounts(p, window=o.window, period=o.period), doc="Accounts without recent activity")
register("cash-flow", lambda p, o: cash_flow(p, o.account or "assets.cash", period=o.period), doc="In and out by month")
