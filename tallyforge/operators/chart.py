"""A chart of accounts as a table (code, name, currency, closed): its tree, and what its rows and a ledger's must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ledger import is_under, leaf_of, normal_sign, parents_of, type_of


def with_parts(chart: DataFrame) -> DataFrame:
    """Accounts with type, normal balance, depth and leaf; a name that lacks is the leaf."""
    kind = type_of(F.col("code"), strict=False)
    return chart.select("code", F.coalesce(F.nullif("name", F.lit("")), leaf_of(F.col("code"))).alias("name"), F.upper("currency").alias("currency"), "closed", kind.alias("type"), F.when(kind.isNotNull(), normal_sign(kind)).alias("normal_balance"), (F.size(F.split("code", r"\.")) - 1).alias("depth"), leaf_of(F.col("code")).alias("leaf"))


def of_type(chart: DataFrame, kind: str) -> DataFrame:
    return chart.where(type_of(F.col("code"), strict=False) == kind)


def children(chart: DataFrame, code: str) -> DataFrame:
    """Accounts one step below."""
    return chart.where(F.col("code").startswith(f"{code}.") & ~F.contains(F.substring("code", len(code) + 2, 1 << 30), F.lit(".")))


def descendants(chart: DataFrame, code: str) -> DataFrame:
    return chart.where(is_under(F.col("code"), code) & (F.col("code") != code))


def roots(chart: DataFrame) -> DataFrame:
    return chart.where(~F.contains("code", F.lit(".")))


def open_accounts(chart: DataFrame) -> DataFrame:
    return chart.where(~F.coalesce("closed", F.lit(False)))


def missing(chart: DataFrame, codes: DataFrame, column: str = "account") -> DataFrame:
    """Distinct codes that the chart lacks."""
    return codes.select(F.col(column).alias("code")).distinct().join(chart.select("code"), "code", "left_anti")


def child_counts(chart: DataFrame) -> DataFrame:
    """(code, n_children, n_descendants) of every account that has any below it, listed or implied."""
    up = chart.select("code", F.explode(parents_of(F.col("code"))).alias("above"), F.size(F.split("code", r"\.")).alias("parts"))
    direct = F.size(F.split("above", r"\.")) == F.col("parts") - 1
    return up.groupBy(F.col("above").alias("code")).agg(F.count_if(direct).alias("n_children"), F.count("*").alias("n_descendants"))


def code_problem(code: Column) -> Column:
    """What is wrong with an account code, or null: empty, malformed, or of no known root."""
    trimmed = F.trim(F.coalesce(code, F.lit("")))
    part = r"[\p{L}\p{N}_-]+"
    return F.when(trimmed == "", "empty code").when(~trimmed.rlike(rf"^{part}(\.{part})*$"), "malformed code").when(type_of(trimmed, strict=False).isNull(), "unknown root")


def chart_problems(chart: DataFrame) -> DataFrame:
    """(code, problem) of accounts that a chart may not have; a code declared twice is one."""
    odd = chart.select("code", code_problem(F.col("code")).alias("problem")).where("problem is not null")
    twice = chart.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", F.lit("declared twice").alias("problem"))
    return odd.unionByName(twice)


def posting_problems(postings: DataFrame) -> DataFrame:
    """(txn_id, ordinal, problem) of postings and transactions that can't be built: no account, no amount, no description, no posting but one."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    found = F.array(F.when(empty("account"), F.lit("empty account")), F.when(F.col("amount_minor").isNull(), F.lit("no amount")), F.when(~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)), F.lit("no currency")))
    rows = postings.select("txn_id", "ordinal", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))
    nets = postings.groupBy("txn_id", "currency").agg(F.sum("amount_minor").alias("net"), F.min("ordinal").alias("ordinal")).where("net <> 0")
    return rows.unionByName(nets.groupBy("txn_id").agg(F.min("ordinal").alias("ordinal")).select("txn_id", "ordinal", F.lit("unbalanced").alias("problem")))


def sides(postings: DataFrame) -> DataFrame:
    """Debits and credits of each account and currency, as counts and sums."""
    debit, credit = F.col("amount_minor") > 0, F.col("amount_minor") < 0
    return postings.groupBy("account", "currency").agg(F.count_if(debit).alias("n_debits"), F.coalesce(F.sum(F.when(debit, F.col("amount_minor"))), F.lit(0)).alias("debit_minor"), F.count_if(credit).alias("n_credits"), F.coalesce(F.sum(F.when(credit, -F.col("amount_minor"))), F.lit(0)).alias("credit_minor"))
