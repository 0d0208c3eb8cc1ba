"""Queries hold all rows of their tables: against SQL or plain Python without any filter."""

import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import grading as G
from tallyforge.plans import frames, ledger, logs, more
from tests.compare import rows

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "nation customer orders lineitem events documents conversations".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    c.execute(f"create view p as {frames.POSTINGS}")
    return c


def test_csv_rows(spark, con):
    want = con.execute(ledger.ORACLE_SQL["csv_rows"]).fetch_df()
    assert len(want) == con.execute("select count(*) from p").fetchone()[0]
    assert rows(ledger.QUERIES["csv_rows"](spark, DIR).toPandas()) == rows(want)


def test_transactions_json(spark, con):
    got = ledger.QUERIES["transactions_json"](spark, DIR).collect()
    assert len(got) == len({r["txn_id"] for r in got})
    legs = {r["txn_id"]: sorted((x["account"], x["minor"], x["currency"]) for x in json.loads(r["json"])["postings"]) for r in got}
    want: dict = {}
    for txn, *leg in con.execute("select txn_id, account, amount_minor, currency from p order by all").fetchall():
        want.setdefault(txn, []).append(tuple(leg))
    assert legs == want


def test_ledger_text(spark, con):
    got = Counter((r["date"], r["line_no"], len(r["text"].split("\n")) - 1) for r in ledger.QUERIES["ledger_text"](spark, DIR).collect())
    assert got == Counter(con.execute("select min(date)::varchar, min(line_no), count(*) from p group by txn_id").fetchall())


def test_transaction_sums(spark, con):
    want = con.execute(ledger.ORACLE_SQL["transaction_sums"]).fetch_df()
    assert len(want) == con.execute("select count(distinct (txn_id, currency)) from p").fetchone()[0]
    assert rows(ledger.QUERIES["transaction_sums"](spark, DIR).toPandas()) == rows(want)


def test_answers(spark, tmp_path):
    """What comes after the fortieth character of a turn counts; a turn's own fence or id comes first."""
    far = "a word " * 20
    own = '{"probe_id":"WURP-0123abcd-009","facts":[],"next_action":""}'
    turns = [(1, 4, "assistant", far + own), (2, 7, "assistant", far + "WURP-0123abcd-008"), (3, 6, "assistant", far + "```json\n{}\n```"), (4, 1, "assistant", far), (5, 4, "assistant", None), (6, 4, "user", own), (7, 4, "assistant", far + own)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["parse_ok"], r["parse_tier"], r["probe_id"]) for r in logs.QUERIES["answers"](spark, str(tmp_path)).collect()}
    # shapes: conv_id + turn modulo 5: fenced, fenced or bare after it, no reply
    reply = "WURP-0123abcd-001"
    assert got == {1: (True, "strict", reply), 2: (False, "failed", "WURP-0123abcd-008"), 3: (False, "failed", None), 4: (True, "strict", reply), 5: (False, "failed", None), 7: (True, "lenient", "WURP-0123abcd-009")}


def _events(path, spark, kinds):
    """events of one user: (type, k) in order."""
    spark.createDataFrame([(i, 1, kind, float(i), json.dumps({"k": k})) for i, (kind, k) in enumerate(kinds)], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).write.parquet(f"{path}/events.parquet")


def test_mention_runs(spark, tmp_path):
    """Thirty views, the first twelve and the last not mentioned."""
    _events(tmp_path, spark, [("view", 3)] * 12 + [("view", 1)] * 17 + [("view", 3)])
    got = logs.QUERIES["mention_runs"](spark, str(tmp_path)).first()
    assert (got["n_probes_observed"], got["ever_mention"], got["first_mention_probe"], got["last_mention_probe"], got["mention_run_length"], got["lapse_probe_index"], got["at_risk_horizon"]) == (30, True, 12, 28, 17, 17, 17)


@pytest.mark.parametrize(("made", "kept"), [(30, 30), (230, 200)])
def test_read_sequence(spark, tmp_path, made, kept):
    """All reads of a run up to the operator's own 200."""
    _events(tmp_path, spark, [("click", k) for k in range(made)])
    files = logs.QUERIES["read_sequence"](spark, str(tmp_path)).first()["files"].split("|")
    assert files == ["memory/n.md" if k % 10 == 0 else f"src/f{k % 12}.py" for k in range(kept)]


def test_length_balance(spark, tmp_path):
    """Upper-case and other scripts have words; null and empty texts have none; every source stays."""
    docs = [("a", "one two three four"), ("a", "ONE"), ("b", "один два"), ("b", "один"), ("c", "one"), ("c", ""), ("d", None), ("e", "one two"), ("e", "1 2 3")]
    got = {r["source"]: r["word_spread"] for r in G.length_balance(spark.createDataFrame(docs, "source string, text string"), "source").collect()}
    assert got == {"a": 3.0, "b": 1.0, "c": None, "d": None, "e": 0.5}


def test_content_words(spark):
    """Layouts of the same words count the same; the raw lengths differ, within the looser tolerance or not."""
    texts = {"prose": "Rates are due on Monday and paid on Friday by all", "list": "## Rates are due\n\n- on Monday\n* [x] and paid on\n+ Friday by all  ", "table": "| Rates | are due |\n|---|:-:|\n| on Monday | and paid |\n|||\n | on Friday by | all |\n-\n", "none": None, "bare": "#\n- \n[ ] x"}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r["name"]: r for r in G.length_report(df).collect()}
    assert {n: got[n]["n_content_words"] for n in got} == {"prose": 11, "list": 11, "table": 11, "none": 0, "bare": 1}
    assert [got[n]["n_lines"] for n in ("prose", "list", "table", "none", "bare")] == [1, 5, 6, 0, 3]
    one = G.length_balance(df.where("name in ('prose', 'list', 'table')").withColumn("fact", F.lit("f")), "fact")
    r = one.first()
    assert (r["content_words_min"], r["content_words_max"], r["content_word_spread"]) == (11, 11, 0.0) and r["words_max"] > r["words_min"] == 11
    assert G.length_balanced(one, raw=2.0).count() == 1
    with pytest.raises(Exception, match="lengths differ"):
        G.length_balanced(one, raw=0.1).collect()
