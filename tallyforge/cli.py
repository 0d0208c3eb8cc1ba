"""Command line of the ledger: validate, report, export, accounts, reports.

``python -m tallyforge.cli report trial-balance book.ledger --period 2024``.  Codes: 0 well, 1 issues
that are errors, 2 wrong usage, 3 something can't be read or reported.
"""

from __future__ import annotations

import argparse
import csv
import json
import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.periods import Period
from tallyforge.operators import chart as C
from tallyforge.operators import ledger as L
from tallyforge.operators import validate as V
from tallyforge.plans import render
from tallyforge.session import session
from tallyforge.sources import ledgers as S

WELL, ISSUES, USAGE, ERROR = 0, 1, 2, 3


class Unreadable(Exception):
    """A document that the grammar refuses."""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyforge", description="Double-entry ledgers")
    commands = top.add_subparsers(dest="command")

    def command(name: str, help_: str, *arguments: str, chart: bool = False, as_json: bool = False) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=help_)
        for argument in arguments:
            own.add_argument(argument)
        if chart:
            own.add_argument("--chart", help="chart of accounts, a CSV file")
        if as_json:
            own.add_argument("--json", action="store_true", help="print JSON")
        return own

    command("validate", "check a ledger", "ledger", chart=True, as_json=True).add_argument("--rule", action="append", default=[], help="only these rules")
    report = command("report", "run a report", "name", "ledger", chart=True, as_json=True)
    for option in ("--period", "--account", "--currency", "--rates"):
        report.add_argument(option)
    report.add_argument("--limit", type=int, default=0)
    export = command("export", "write a ledger in another format", "ledger", chart=True)
    export.add_argument("--format", default="json", choices=("json", "csv"))
    export.add_argument("--out", help="folder to write to; else everything is printed, in order")
    command("accounts", "list a chart", "chart").add_argument("--type", choices=sorted(set(L.ROOT_TYPES.values())))
    command("reports", "list the reports")
    return top


def _book(spark: SparkSession, path: str) -> DataFrame:
    """The postings of a document that the grammar accepts."""
    lines = S.numbered_lines(spark, path)
    wrong = S.ledger_errors(lines).orderBy("line_no", "message").limit(1).collect()
    if wrong:
        raise Unreadable(f"line {wrong[0]['line_no']}: {wrong[0]['message']}")
    return S.parse_ledger(lines)


def _shown(rows: DataFrame, as_json: bool, out: TextIO) -> None:
    if as_json:
        out.write(f'{{\n  "columns": {json.dumps(rows.columns)},\n  "rows": ')
        render.streamed_json(render.values(rows), out, 2)
        out.write("\n}\n")
    else:
        render.streamed_table(rows, out)


def _validate(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> int:
    chart = S.read_chart(spark, args.chart) if args.chart else None
    book = _book(spark, args.ledger)
    issues = V.validate(book, chart, args.rule or None).cache()
    counts = issues.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w")).first()
    ordered = issues.orderBy("line_no", "code", "message")
    if args.json:
        out.write(f'{{\n  "summary": {json.dumps({"errors": counts["e"], "warnings": counts["w"]})},\n  "issues": ')
        render.streamed_json((r.asDict() for r in ordered.toLocalIterator()), out, 2)
        out.write("\n}\n")
    else:
        for r in ordered.toLocalIterator():
            print(f"{r['severity']}: {r['code']}: {r['message']} (line {r['line_no']})", file=out)
        print(f"{book.select('txn_id').distinct().count()} transactions, {counts['e']} error(s), {counts['w']} warning(s)", file=out)
    return ISSUES if counts["e"] else WELL


def _report(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> int:
    book = _book(spark, args.ledger)
    if args.rates and not args.currency:
        raise ValueError("rates need a currency to convert to")
    if args.rates:
        book = L.converted(book, S.read_rates(spark, args.rates), args.currency.upper(), bridge=True)
    options = L.Options(period=Period.parse(args.period) if args.period else None, account=args.account, currency=args.currency, limit=args.limit or None)
    rows = L.run_report(args.name, book, options)
    _shown(rows.orderBy(*rows.columns), args.json, out)
    return WELL


def _export(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> int:
    book = _book(spark, args.ledger)
    if args.out:
        if args.format == "csv":
            S.write_postings_csv(book, args.out)
        else:
            S.transactions_json(book).select(F.col("json").alias("value")).write.text(args.out)
        print(f"wrote {args.out}", file=out)
        return WELL
    if args.format == "csv":
        rows = book.orderBy("date", "line_no", "ordinal")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(S.csv_rows(rows).columns)
        writer.writerows(S.csv_rows(rows).toLocalIterator())
    else:
        rows = S.transactions_json(book).orderBy("date", "line_no")
        render.streamed_json((json.loads(r["json"]) for r in rows.toLocalIterator()), out)
        out.write("\n")
    return WELL


def _accounts(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> int:
    chart = S.read_chart(spark, args.chart)
    wrong = C.chart_problems(chart).orderBy("code").limit(1).collect()
    if wrong:
        raise Unreadable(f"{wrong[0]['problem']}: {wrong[0]['code']!r}")
    rows = C.with_parts(C.of_type(chart, args.type) if args.type else chart).orderBy("code")
    _shown(rows.select(F.col("code").alias("account"), "type", "currency", F.when(F.col("closed"), "closed").otherwise("open").alias("state")), False, out)
    return WELL


def _reports(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> int:
    print("\n".join(L.available()), file=out)
    return WELL


_COMMANDS = {"validate": _validate, "report": _report, "export": _export, "accounts": _accounts, "reports": _reports}


def main(argv: Sequence[str] | None = None, out: TextIO | None = None, spark: SparkSession | None = None) -> int:
    out, own = out or sys.stdout, parser()
    try:
        args = own.parse_args(argv)
    except SystemExit as end:
        return USAGE if end.code else WELL
    if not args.command:
        own.print_help(out)
        return USAGE
    try:
        return _COMMANDS[args.command](spark or session("ledger"), args, out)
    except (Unreadable, ValueError, KeyError, PySparkException) as problem:
        print(f"error: {str(problem).splitlines()[0]}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
