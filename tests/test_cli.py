"""The ledger's command line: what it prints and the codes it ends with."""

import io
import json
from datetime import date

import pytest

from tallyforge import cli

BOOK = """2024-01-02 Opening  #opening  ^A-1
    assets.cash.till        1000.00 USD
    equity.start
2024-02-01 Rent
    expenses.rent            300.00 USD  #monthly
    assets.cash.till        -300.00 USD
"""
CHART = "code,name,currency,closed\nassets.cash.till,Till,usd,\nequity.start,,USD,no\nexpenses.rent,Rent,USD,yes\n"


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    (folder / "book.ledger").write_text(BOOK)
    (folder / "bad.ledger").write_text("2024-01-01 One\n    assets.a 1.00 USD\n")
    (folder / "chart.csv").write_text(CHART)
    (folder / "odd.csv").write_text("code,name,currency,closed\nmisc.x,,USD,\n")
    return folder


@pytest.fixture
def run(spark, at):
    def call(*argv):
        out = io.StringIO()
        return cli.main([str(at / a) if a.endswith((".ledger", ".csv")) else a for a in argv], out, spark), out.getvalue()

    return call


def test_validate(run):
    assert run("validate", "book.ledger") == (0, "2 transactions, 0 error(s), 0 warning(s)\n")
    code, text = run("validate", "book.ledger", "--chart", "chart.csv", "--json")
    found = json.loads(text)
    assert code == 1 and found["summary"]["errors"] == 1 and {i["code"] for i in found["issues"]} >= {"closed-account"}
    assert run("validate", "book.ledger", "--rule", "balanced")[0] == 0


def test_report(run):
    code, text = run("report", "trial-balance", "book.ledger", "--json")
    rows = {r[0]: r[-1] for r in json.loads(text)["rows"]}
    assert code == 0 and rows == {"assets.cash.till": 70000, "equity.start": 100000, "expenses.rent": 30000}
    assert "300" in run("report", "income-statement", "book.ledger", "--period", "2024-02")[1]
    assert "trial-balance" in run("reports")[1].split()


def test_export_and_accounts(run, at, tmp_path):
    assert len(json.loads(run("export", "book.ledger")[1])) == 2
    assert run("export", "book.ledger", "--format", "csv")[1].startswith("date,ref,description,tags,account,amount,currency\n")
    assert run("export", "book.ledger", "--format", "csv", "--out", str(tmp_path / "out"))[0] == 0 and any((tmp_path / "out").iterdir())
    code, text = run("accounts", "chart.csv")
    assert code == 0 and [line.split()[-1] for line in text.strip().split("\n")[2:]] == ["open", "open", "closed"]
    assert "equity" not in run("accounts", "chart.csv", "--type", "expense")[1]


@pytest.mark.parametrize("argv, code", [((), 2), (("nothing",), 2), (("report", "none", "book.ledger"), 3), (("validate", "bad.ledger"), 3), (("validate", "lost.ledger"), 3), (("accounts", "odd.csv"), 3), (("report", "account-statement", "book.ledger"), 3), (("report", "trial-balance", "book.ledger", "--period", "x"), 3)])
def test_codes(run, argv, code, capsys):
    assert run(*argv)[0] == code


@pytest.fixture(scope="module")
def large(at):
    """1,500 transactions, each a day before the one above it."""
    book = "".join(f"{date.fromordinal(738_900 - k)} Sale {k:04d}  ^R{k}\n    assets.cash.till  {k + 1}.00 USD\n    income.sales     -{k + 1}.00 USD\n" for k in range(1500))
    (at / "large.ledger").write_text(book)
    return "large.ledger"


def test_everything_comes_out(run, large, at, spark, tmp_path):
    """Nothing is cut: exports, reports and issues are whole and in order."""
    items = json.loads(run("export", large)[1])
    assert len(items) == 1500 and [i["date"] for i in items] == sorted(i["date"] for i in items)
    lines = run("export", large, "--format", "csv")[1].splitlines()
    assert len(lines) == 3001 and [x[:10] for x in lines[1:]] == sorted(x[:10] for x in lines[1:])
    code, text = run("validate", large, "--chart", "chart.csv", "--json")
    found = json.loads(text)
    assert code == 1 and len(found["issues"]) == sum(found["summary"].values()) > 1490
    assert [i["line_no"] for i in found["issues"]] == sorted(i["line_no"] for i in found["issues"])
    assert len(run("validate", large, "--chart", "chart.csv")[1].splitlines()) == len(found["issues"]) + 1
    rows = json.loads(run("report", "transaction-log", large, "--json")[1])["rows"]
    assert len(rows) >= 1500 and len(run("report", "transaction-log", large)[1].splitlines()) == len(rows) + 2


def test_exports_read_back(run, large, spark, tmp_path):
    from tallyforge.sources import ledgers as S

    for format_, read in (("json", S.read_transactions_json), ("csv", S.read_postings_csv)):
        out = str(tmp_path / format_)
        assert run("export", large, "--format", format_, "--out", out)[0] == 0
        back = read(spark, out)
        assert back.count() == 3000 and back.agg({"amount_minor": "sum"}).first()[0] == 0
        assert back.where("ref = 'R1499'").count() == 2 and back.select("txn_id").distinct().count() == 1500
    (tmp_path / "printed.json").write_text(run("export", large)[1])
    assert S.read_transactions_json(spark, str(tmp_path / "printed.json")).count() == 3000
