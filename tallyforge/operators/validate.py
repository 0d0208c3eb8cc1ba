"""Ledger rules: each is a query for issues (code, severity, message, line_no, ref)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ledger import parents_of
from tallyforge.shared import fixed

ISSUE = ("code", "severity", "message", "line_no", "ref")


def _issues(rows: DataFrame, code: str, severity: str, message) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.col("line_no").cast("long").alias("line_no"), F.col("ref"))


class Book:
    """Postings with what the rules share: sums by transaction and uses of accounts, each made once.

    With ``keep`` the columns that rules read are written once, so that what leads to the postings runs once; sums and
    uses come from that narrow table.
    """

    def __init__(self, postings: DataFrame, *, keep: bool = False):
        self._keep = fixed if keep else lambda df, name: df
        self.postings = self._keep(postings.select("txn_id", "line_no", "ordinal", "date", "ref", "description", "account", "amount_minor", "currency"), "book")

    @cached_property
    def sums(self) -> DataFrame:
        """Those of transactions that aren't balanced."""
        return self.postings.groupBy("txn_id", "currency").agg(F.sum("amount_minor").alias("net"), F.min("line_no").alias("line_no"), F.min("ref").alias("ref")).where("net <> 0")

    @cached_property
    def transactions(self) -> DataFrame:
        return self._keep(self.postings.groupBy("txn_id").agg(*(F.min(c).alias(c) for c in ("line_no", "date", "ref", "description"))), "transactions")

    @cached_property
    def uses(self) -> DataFrame:
        at = F.min(F.struct("line_no", "ordinal", "ref")).alias("at")
        return self._keep(self.postings.groupBy("account", "currency").agg(at), "uses")


def book(postings: DataFrame | Book) -> Book:
    return postings if isinstance(postings, Book) else Book(postings)


def check_balanced(postings: DataFrame | Book, chart: DataFrame | None = None) -> DataFrame:
    return _issues(book(postings).sums, "unbalanced", "error", F.concat(F.col("currency"), F.lit(" is off by "), F.col("net").cast("string")))


def check_known_accounts(postings: DataFrame | Book, chart: DataFrame) -> DataFrame:
    used = book(postings).uses.groupBy("account").agg(F.min("at").alias("at"))
    rows = used.join(chart.select(F.col("code")), F.col("account") == F.col("code"), "left_anti").select("account", "at.line_no", "at.ref")
    return _issues(rows, "unknown-account", "error", F.col("account"))


def check_closed_accounts(postings: DataFrame | Book, chart: DataFrame) -> DataFrame:
    rows = book(postings).postings.join(chart.where("closed").select("code"), F.col("account") == F.col("code"))
    return _issues(rows, "closed-account", "error", F.col("account"))


def check_duplicate_refs(postings: DataFrame | Book, chart: DataFrame | None = None) -> DataFrame:
    """Every repeat of a reference against its first use; the firsts are a table of their own, joined back."""
    rows = book(postings).transactions.where("ref is not null and ref <> ''")
    first = rows.groupBy(F.col("ref").alias("of_ref")).agg(F.min(F.struct("date", "line_no", "txn_id")).alias("first"))
    rows = rows.join(first, F.col("ref") == F.col("of_ref")).where(F.struct("date", "line_no", "txn_id") != F.col("first"))
    return _issues(rows, "duplicate-ref", "warning", F.concat(F.lit("first at line "), F.col("first.line_no").cast("string")))


def check_single_currency(postings: DataFrame | Book, chart: DataFrame | None = None) -> DataFrame:
    rows = book(postings).uses.groupBy("account").agg(F.array_sort(F.collect_set("currency")).alias("currencies"), F.min("at.line_no").alias("line_no")).where(F.size("currencies") > 1).withColumn("ref", F.lit(None).cast("string"))
    return _issues(rows, "mixed-currency-account", "warning", F.concat(F.col("account"), F.lit(": "), F.array_join("currencies", ",")))


def check_chronological(postings: DataFrame | Book, chart: DataFrame | None = None, *, slice_lines: int = 100_000) -> DataFrame:
    """Transactions dated before the one above them in the file.

    Lines are dealt in slices; a slice also gets the last transaction of the one
    before that has any, so no window spans the file.
    """
    rows = book(postings).transactions.withColumn("slice", F.floor(F.col("line_no") / slice_lines))
    last = rows.groupBy("slice").agg(F.max_by("date", F.struct("line_no", "txn_id")).alias("last_date"))
    ahead = last.select(F.col("slice").alias("of_slice"), F.lag("last_date").over(Window.orderBy("slice")).alias("ahead"))  # a row a slice
    inside = F.lag("date").over(Window.partitionBy("slice").orderBy("line_no", "txn_id"))
    rows = rows.withColumn("inside", inside).join(ahead, F.col("slice") == F.col("of_slice")).withColumn("before", F.coalesce("inside", "ahead")).where("date < before")
    return _issues(rows, "out-of-order", "error", F.concat(F.col("date").cast("string"), F.lit(" after "), F.col("before").cast("string")))


def check_descriptions(postings: DataFrame | Book, chart: DataFrame | None = None) -> DataFrame:
    rows = book(postings).transactions.where("description is null or trim(description) = ''")
    return _issues(rows, "empty-description", "warning", F.lit("no description"))


def validate_chart(chart: DataFrame) -> DataFrame:
    """Parents that accounts imply and the chart doesn't list."""
    implied = chart.select(F.explode(parents_of(F.col("code"))).alias("parent")).distinct()
    rows = implied.join(chart.select("code"), F.col("parent") == F.col("code"), "left_anti").select("parent", F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("ref"))
    return _issues(rows, "implied-parent", "warning", F.col("parent"))


RULES = {"balanced": check_balanced, "chronological": check_chronological, "closed-accounts": check_closed_accounts, "descriptions": check_descriptions, "duplicate-refs": check_duplicate_refs, "known-accounts": check_known_accounts, "single-currency": check_single_currency}


def rule(name: str):
    """Register a rule (postings or their book, chart) -> issues."""

    def add(fn):
        RULES[name] = fn
        return fn

    return add


def rule_names() -> list[str]:
    return sorted(RULES)


def validate(postings: DataFrame, chart: DataFrame | None = None, rules: list[str] | None = None) -> DataFrame:
    """Issues of all rules, or the listed; those about a chart need one."""
    out, postings = None, Book(postings, keep=True)
    for name in rules or rule_names():
        if chart is None and name in ("known-accounts", "closed-accounts"):
            continue
        one = RULES[name](postings, chart)
        out = one if out is None else out.unionByName(one)
    if chart is not None and not rules:
        out = out.unionByName(validate_chart(chart))
    return out
