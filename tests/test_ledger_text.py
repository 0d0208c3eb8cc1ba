"""The ledger's text format, its goldens by hand, and its CSV and JSON forms."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.money import rational
from tallyforge.functions.periods import Period, iter_periods
from tallyforge.operators import ledger as L
from tallyforge.operators import validate as V
from tallyforge.sources import ledgers as S

TEXT = """; a small book
2023-01-02 Opening  #opening  ^A-1
    assets.cash.till        1000.00 USD
    assets.cash.bank         500.00 EUR
    equity.start           -1000.00 USD
    equity.start            -500.00 EUR

2023-01-10 Rent  #monthly
    expenses.rent            300.00 USD   // due
    assets.cash.till
2023-02-05 Sale  ^A-2
    assets.receivable.x      250.50 USD  #late
    income.goods            -250.50 USD
2023-03-01 Paid  ^A-2
    assets.cash.till         250.50 USD
    assets.receivable.x
2023-02-20 Tram tickets
    expenses.travel           (12.00) EUR
    assets.cash.bank           12.00 EUR
"""


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("book") / "a.ledger"
    path.write_text(TEXT)
    return S.read_ledger(spark, str(path)).cache()


def test_parse(book):
    got = {(r["account"], r["amount_minor"], r["currency"]) for r in book.collect()}
    assert book.count() == 12
    assert ("assets.cash.till", -30000, "USD") in got  # elided
    assert ("assets.receivable.x", -25050, "USD") in got
    assert ("expenses.travel", -1200, "EUR") in got
    rent = book.where("description = 'Rent'").first()
    assert rent["txn_tags"] == ["monthly"] and rent["date"] == datetime.date(2023, 1, 10)
    assert book.where("account = 'assets.receivable.x' and amount_minor > 0").first()["post_tags"] == ["late"]


def test_reports(book):
    assert {r["residual_minor"] for r in L.residual(book).collect()} == {0}
    tb = {(r["account"], r["currency"]): r["balance_minor"] for r in L.trial_balance(book).collect()}
    assert tb["assets.cash.till", "USD"] == 95050 and tb["equity.start", "USD"] == 100000 and tb["income.goods", "USD"] == 25050
    net = {(r["section"], r["currency"]): r["amount_minor"] for r in L.income_statement(book).collect()}
    assert net["net", "USD"] == 25050 - 30000 and net["net", "EUR"] == 1200
    st = L.account_statement(book, "assets.cash", currency="USD", period=Period.parse("2023-03"), opening=True).collect()
    assert [(r["amount_minor"], r["balance_minor"]) for r in st] == [(25050, 95050)]
    plain = L.account_statement(book, "assets.cash", currency="USD", period=Period.parse("2023-03")).collect()
    assert plain[0]["balance_minor"] == 25050
    assert len(L.account_statement(book, "assets.cash", limit=2).collect()) == 2
    flow = {(r["month"], r["currency"]): (r["inflow_minor"], r["outflow_minor"]) for r in L.cash_flow(book).collect()}
    assert flow["2023-01", "USD"] == (100000, 30000)
    ages = {r["bucket"]: r["amount_minor"] for r in L.aging(book, period=Period.parse("2023-01-01..2023-02-28")).collect()}
    assert ages == {"0-30": 25050}
    assert L.run_report("trial-balance", book).count() == len(tb)
    with pytest.raises(KeyError):
        L.run_report("nothing", book)
    with pytest.raises(ValueError):
        L.run_report("account-statement", book)


def test_rules(spark, book):
    chart = spark.createDataFrame([("assets.cash.till", False), ("assets.cash.bank", True), ("equity.start", False), ("expenses.rent", False)], "code string, closed boolean")
    found = {(r["code"], r["message"]) for r in V.validate(book, chart).collect()}
    codes = {c for c, _ in found}
    assert {"unknown-account", "closed-account", "duplicate-ref", "mixed-currency-account", "out-of-order", "implied-parent"} <= codes
    assert "unbalanced" not in codes
    assert V.check_chronological(book, slice_lines=5).count() == 1


def test_mixed_currency_is_an_error(book):
    with pytest.raises(Exception, match="several currencies"):
        L.balance(book, "assets.cash").collect()
    assert L.balance(book, "nothing.here").first()["amount_minor"] == 0


def test_grammar_errors(spark, tmp_path):
    path = tmp_path / "bad.ledger"
    path.write_text("    early 1.00 USD\n2023-01-01\n    a.b 1.00 USD\n    c.d 2.00 USD\n2023-01-02 Two\n    x.y\n    z.w\n2023-01-03 None\n2023-13-40 When\n    a.b 1.x USD\n    c.d\nnonsense\n")
    got = {r["message"] for r in S.ledger_errors(S.numbered_lines(spark, str(path))).collect()}
    assert {"posting before a header", "empty description", "two elided amounts", "no postings", "no such date", "neither header nor posting", "unbalanced", "bad amount"} <= got


def test_round_trips(spark, book, tmp_path):
    S.write_postings_csv(book.orderBy("line_no", "ordinal").coalesce(1), str(tmp_path / "csv"))
    back = S.read_postings_csv(spark, str(tmp_path / "csv"))
    key = lambda df: sorted((r["account"], r["amount_minor"], r["currency"], str(r["date"])) for r in df.collect())
    assert key(back) == key(book)
    assert back.select("txn_id").distinct().count() == 5
    items = [json.loads(r["json"]) for r in S.transactions_json(book).collect()]
    (tmp_path / "t.json").write_text(json.dumps({"transactions": items}))
    assert key(S.read_transactions_json(spark, str(tmp_path / "t.json"))) == key(book)
    text = "\n\n".join(r["text"] for r in S.ledger_text(book).orderBy("line_no").collect())
    (tmp_path / "again.ledger").write_text(text)
    assert key(S.read_ledger(spark, str(tmp_path / "again.ledger"))) == key(book)


def test_conversion(spark):
    rates = S.rate_table(spark, [("EUR", "USD", "1.10"), ("EUR", "USD", "1.5"), ("USD", "JPY", "150"), ("GBP", "USD", "1.25")])
    p = spark.createDataFrame([(101, "EUR"), (1, "EUR"), (-1, "EUR"), (3, "EUR"), (7, "USD")], "amount_minor long, currency string")
    got = [r["amount_minor"] for r in L.converted(p, rates, "USD").collect()]
    assert sorted(got) == sorted([152, 2, -2, 4, 7])  # halves go to even; the last rate of a pair holds
    jpy = L.converted(spark.createDataFrame([(100, "GBP")], "amount_minor long, currency string"), rates, "JPY", bridge=True).first()
    assert jpy["amount_minor"] == 188  # 1 GBP = 1.25 USD = 187.5 JPY
    with pytest.raises(Exception, match="no rate"):
        L.converted(spark.createDataFrame([(1, "CHF")], "amount_minor long, currency string"), rates, "USD").collect()
    with pytest.raises(TypeError):
        rational(1.1)
    with pytest.raises(ValueError):
        rational("-1")


def test_periods():
    q = Period.parse("2024-Q4")
    assert (q.start, q.end, q.days()) == (datetime.date(2024, 10, 1), datetime.date(2024, 12, 31), 92)
    assert q.next().label == "2025-Q1" and q.previous().label == "2024-Q3" and len(q.months()) == 3
    assert Period.parse("2024-02").end.day == 29
    assert [p.label for p in iter_periods(Period.month(2023, 11), 3)] == ["2023-11", "2023-12", "2024-01"]
    r = Period.parse("2024-01-10..2024-01-19")
    assert r.next().start == datetime.date(2024, 1, 20) and r.days() == 10
    for bad in ("2024-Q5", "x", "2024-02-02..2024-01-01"):
        with pytest.raises(ValueError):
            Period.parse(bad)


def test_chart(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code,name,currency,closed\na.b,X,,yes\na.c,Y,eur,0\n")
    got = {r["code"]: (r["currency"], r["closed"]) for r in S.read_chart(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"a.b": ("USD", True), "a.c": ("EUR", False)}
    (tmp_path / "d.csv").write_text("code,name,currency,closed\na.b,X,,\na.b,Y,,\n")
    with pytest.raises(Exception, match="twice"):
        S.read_chart(spark, str(tmp_path / "d.csv")).collect()
    (tmp_path / "r.csv").write_text("base,quote,rate\neur,usd,3/2\n")
    assert [(r["base"], int(r["num"]), int(r["den"])) for r in S.read_rates(spark, str(tmp_path / "r.csv")).collect()] == [("EUR", 3, 2)]


def test_payroll_year(spark):
    p = S.payroll_ledger(spark)
    assert p.select("txn_id").distinct().count() == 24 and L.residual(p).first()["residual_minor"] == 0
    got = {r["account"]: r["balance_minor"] for r in L.trial_balance(p).collect()}
    assert got == {"expenses.rent": 12 * 320_000, "expenses.salaries": 9 * 1_760_000 + 3 * 1_840_000, "assets.cash.checking": -(12 * 320_000 + 9 * 1_760_000 + 3 * 1_840_000)}
    assert L.with_tag(p, "closing").first()["description"] == "December payroll"
    usd = L.converted(p, S.rate_table(spark, list(S.EXTENDED_RATES)), "EUR")
    assert usd.where("amount_minor = 256000").count() == 12


def test_scorecard(spark):
    from tallyforge.operators import telemetry as T

    rows = [("r1", "b", "E0", "accepted", 10, "v2", "g", None, 1), ("r2", "a", "E1", "rejected", 30, None, "g", "accepted", 2), ("r3", "a", "E1", "accepted", 20, "v2", "h", "accepted", 3), ("r4", "b", "E0", None, 40, "v2", "g", None, 4)]
    runs = spark.createDataFrame(rows, "run_id string, task_id string, condition_id string, terminal_state string, total_effective long, accounting_version string, grader_sha string, regraded_state string, seen int")
    got = T.job_scorecard(runs, "E0")
    assert [r["task_id"] for r in got["acceptance by task"].collect()] == ["b", "a"]
    assert {r["condition_id"]: (r["tokens_upper_median"], r["ratio"]) for r in got["cost by condition"].collect()} == {"E0": (40, 1.0), "E1": (30, 0.75)}
    assert got["regrade drift"].first()["run_id"] == "r2" and got["versions"].count() == 2
    assert {r["task_id"]: r["n_graders"] for r in got["graders"].collect()} == {"a": 2, "b": 1}


def test_json_documents(spark, tmp_path):
    """Lines with and without the export's head, arrays, objects; what isn't a ledger's JSON is an error."""
    item = {"date": "2024-01-02", "description": "x", "line_no": 1, "ref": "r", "tags": ["t"], "postings": [{"account": "a.b", "minor": 5, "currency": "USD", "tags": []}, {"account": "c.d", "minor": -5, "currency": "USD", "tags": ["u"]}]}
    one = json.dumps(item)
    good = {"lines": f"{one}\n\n{one}\n", "head": f'{{"schema":"1","generated_at":"x"}}\n{one}\n{one}\n', "array": f"[{one},\n{one}]", "wide": json.dumps([item, item], indent=2), "object": json.dumps({"transactions": [item, item]}, indent=1), "short": json.dumps({"transactions": [item, item]})}
    for name, text in good.items():
        (tmp_path / f"{name}.json").write_text(text)
        back = S.read_transactions_json(spark, str(tmp_path / f"{name}.json")).collect()
        assert len(back) == 4 and len({r["txn_id"] for r in back}) == 2 and {(r["account"], r["amount_minor"], tuple(r["txn_tags"])) for r in back} == {("a.b", 5, ("t",)), ("c.d", -5, ("t",))}, name
    for name, text in {"cut": one[:-9], "other": '{"a": 1}', "tail": f"{one}\nnot json\n", "none": "nothing"}.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception):
            S.read_transactions_json(spark, str(tmp_path / f"{name}.json")).collect()


def test_csv_in_splits(spark, tmp_path):
    """One file of many splits: fields over several lines, quotes and transactions that lie across the edges of splits."""
    import csv

    rows = [(f"2024-01-{1 + k // 300:02d}", f"r{k // 3}", f'say "{k // 3}",\n\nand\nmore' if k // 3 % 5 == 0 else f"d {k // 3}", "b;a", "assets.x" if k % 3 else "equity.y", f"{k}.50", " usd ", "extra") for k in range(3000)]
    with open(tmp_path / "one.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["Date", "ref", "Description", "tags", "account", "amount", "currency", "more"])
        out.writerows(rows)
    key = "spark.sql.files.maxPartitionBytes"
    before, split = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(key, "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        back = S.read_postings_csv(spark, str(tmp_path / "one.csv"))
        assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in back.select("ordinal", F.col("date").cast("string"), "ref", "description", "account", "amount_minor", "currency", F.array_join("post_tags", " ")).collect())
        assert [r[1:] for r in got] == [(d, r, s, a, k * 100 + 50, "USD", "b a") for k, (d, r, s, _, a, _, _, _) in enumerate(rows)]
        assert back.groupBy("txn_id").count().groupBy("count").count().collect()[0][:] == (3, 1000)
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", split)


def test_round_trips_keep_every_column(spark, book, tmp_path):
    key = lambda df: sorted((str(r["date"]), r["ref"] or "", r["description"], r["account"], r["amount_minor"], r["currency"], tuple(sorted({*(r["txn_tags"] or []), *(r["post_tags"] or [])}))) for r in df.collect())
    S.write_postings_csv(book, str(tmp_path / "csv"))
    assert key(S.read_postings_csv(spark, str(tmp_path / "csv"))) == key(book)
    S.transactions_json(book).select("json").write.text(str(tmp_path / "json"))
    assert key(S.read_transactions_json(spark, str(tmp_path / "json"))) == key(book)


def test_csv_records_deal_no_lines(spark, tmp_path):
    """Records that span splits are whole and numbered along the file, and no line is sorted into place."""
    from tallyforge.sources import ledgers

    want = ["a,b"] + [f'{k},"x{k}\n\n,""y""{"z" * (k % 50)}\nend"' if k % 3 == 0 else f"{k},plain" for k in range(400)]
    (tmp_path / "t.csv").write_text("\n".join(want).replace("\n1,plain", "\n\n  \n1,plain") + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "100")
        records = ledgers.csv_records(spark, str(tmp_path / "t.csv"))
        got = records.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [r["text"] for r in sorted(got, key=lambda r: r["record"])] == want and sorted(r["record"] for r in got) == list(range(1, 402))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "line_no" not in plan and "collect_list" in plan


@pytest.mark.parametrize("name", ["text_round_trip", "json_round_trip"])
def test_round_trips_write_compressed(spark, tmp_path, monkeypatch, name):
    """What a round trip writes and reads again is compressed, as it is many times its input."""
    from tallyforge import registry, shared

    monkeypatch.setattr(shared, "path", lambda _spark, kind: f"file://{tmp_path}/{kind}")
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    kind = {"text_round_trip": "ledger-text", "json_round_trip": "transactions-json"}[name]
    files = [p.name for p in (tmp_path / kind).glob("part-*")]
    assert files and all(p.endswith(".gz") for p in files)


def test_json_lines_are_not_read_whole(spark, tmp_path):
    """Only files that are one document are read as one row, whatever lies beside them and however they are called."""
    item = {"date": "2024-01-02", "description": "x", "line_no": 1, "ref": "r", "tags": ["t"], "postings": [{"account": "a.b", "minor": 5, "currency": "USD", "tags": []}]}
    one = json.dumps(item)
    (tmp_path / "lines.json").write_text(f"\n{one}\n\n{one}\n{one}\n")
    (tmp_path / "more.json").write_text(f'{{"schema":"1"}}\n{one}\n')
    (tmp_path / "a b[1].json").write_text(json.dumps([item, item], indent=1))
    back = S.read_transactions_json(spark, str(tmp_path))
    assert len(back.collect()) == 6 and back.select("txn_id").distinct().count() == 6
    leaves = back._jdf.queryExecution().executedPlan().collectLeaves()
    assert sorted(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size())) == [1, 2]


def test_postings_by_order_deal_lines_once(spark):
    """The rows of the ledger's postings; grouping them by transaction needs no shuffle of its own."""
    from tallyforge.plans import ledger

    a, b = (f(spark, "/root/testdata/sf0.001") for f in (ledger.postings, ledger.postings_by_order))
    assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
        plans = [S.transactions_json(p)._jdf.queryExecution().executedPlan().toString() for p in (a, b)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lines = [sum("Exchange hashpartitioning" in x for x in p.split("\n")) for p in plans]
    assert "Exchange hashpartitioning(txn_id" in plans[0] and "Exchange hashpartitioning(txn_id" not in plans[1] and lines[1] < lines[0]


def test_ledgers_in_splits_deal_no_whole_transaction(spark, tmp_path, monkeypatch):
    """Whatever splits, files and sizes of blocks, postings are those of the windows over numbered lines; lines of whole transactions are dealt nowhere."""
    odd = "    early.one 1.00 USD\n\nnonsense\n" + TEXT + "2023-05-01;no words\n    a.b (1,250.50) usd #x\n\tc.d\n\n// gone\n    e.f 1.x USD\n2023-05-02 Two ^r\n    a.b\n    c.d\n2023-05-03 none\n2023-13-40 When #t\n    a.b 5 JPY\n    x.y 3 EUR\n    c.d ; rest\n"
    more = "".join(f"2024-01-{k % 28 + 1:02d} buy {k}\n    assets.a  {k}.00 USD\n{'' if k % 3 else chr(10) * 3}    income.b\n" for k in range(1, 200))
    (tmp_path / "a.ledger").write_text(odd + more + odd)
    (tmp_path / "b.ledger").write_text(more)
    (tmp_path / "c.ledger").write_text(odd)
    (tmp_path / "none.ledger").write_text("")
    import gzip

    with gzip.open(tmp_path / "d.ledger.gz", "wt") as f:
        f.write(more + odd)
    rows = lambda df: sorted(map(repr, df.select(*S.POSTING).collect()))
    want = rows(S.parse_ledger(S.numbered_lines(spark, str(tmp_path))))
    assert len(want) > 1200
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, batch, most in (("128m", "7", 3), ("2k", "50", 5), ("500", "10000", 4096)):
            monkeypatch.setattr(S, "BLOCK_LINES", most)
            for k, v in zip(kept, (size, size, batch)):
                spark.conf.set(k, v)
            assert rows(S.read_ledger(spark, str(tmp_path))) == want, (size, batch, most)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # one split: the windows get the last transaction alone, which the next split could have continued
    dealt, windows = [], S._parsed
    monkeypatch.setattr(S, "BLOCK_LINES", 4096)
    monkeypatch.setattr(S, "_parsed", lambda rows: (dealt.append(rows.count()), windows(rows))[1])
    assert S.read_ledger(spark, str(tmp_path / "b.ledger")).count() == 398 and dealt == [3]
