"""Transcripts of four dialects, telemetry over them, and the lexers."""

import gzip
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions import tools as T
from tallyforge.operators import detectors as D
from tallyforge.operators import probes as P
from tallyforge.operators import tables as TB
from tallyforge.operators import telemetry as TM
from tallyforge.operators import trace as TR
from tallyforge.sources import transcripts as TS


def lines(spark, *objs):
    return spark.createDataFrame([("r1", k + 1, o if isinstance(o, str) else json.dumps(o)) for k, o in enumerate(objs)], "run_id string, line_no long, line string")


def use(name, id_, **fields):
    return {"type": "tool_use", "name": name, "id": id_, "input": fields}


MESSAGES = (
    {"type": "system", "subtype": "init"},
    {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "go"}},
    {"type": "assistant", "timestamp": "2024-01-01T00:00:05Z", "message": {"id": "m1", "role": "assistant", "content": [{"type": "text", "text": "hi"}, use("Read", "t1", file_path="/w/a.py"), use("Bash", "t2", command="git log")], "usage": {"input_tokens": 10, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 1, "output_tokens": 3}}},
    {"type": "assistant", "timestamp": "2024-01-01T00:00:06Z", "message": {"id": "m1", "role": "assistant", "content": [use("Edit", "t3", file_path="/w/a.py")], "usage": {"input_tokens": 10, "output_tokens": 3}}},
    {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "body"}]}]}, "toolUseResult": {"file": {"numLines": 2, "totalLines": 9}}},
    {"type": "assistant", "timestamp": "2024-01-01T00:00:20.500Z", "message": {"id": "m2", "role": "assistant", "content": [], "usage": {"input_tokens": 20, "output_tokens": 4}}},
    {"type": "result", "usage": {"input_tokens": 30, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 1, "output_tokens": 7}, "total_cost_usd": 0.5, "num_turns": 2, "permission_denials": [1]},
)


def test_messages(spark):
    raw = lines(spark, *MESSAGES)
    e = TS.messages(raw)
    rows = e.orderBy("seq").collect()
    assert [r["role"] for r in rows] == ["user", "assistant", "assistant", "user", "assistant"]
    assert [r["tokens_in"] for r in rows] == [0, 16, 0, 0, 20]
    assert [t["name"] for t in rows[1]["tools"]] == ["Read", "Bash"] and rows[1]["tools"][0]["input"]["file_path"] == "/w/a.py"
    assert TS.messages(raw, include_aux=True).count() == 6
    res = TS.terminal_result(raw).first()
    assert (res["total_input"], res["total_output"], res["permission_denials"], res["cost_usd"]) == (36, 7, 1, 0.5)
    out = TS.tool_results(raw).first()
    assert out["truncated"] and out["text"] == "body" and out["tool_use_id"] == "t1"
    tok = TM.run_tokens(e, TS.terminal_result(raw)).first()
    assert tok["total_input"] == 36 and tok["dedupe_delta_input"] == 0 and tok["total_effective"] == 36 - 4 + 7
    assert (tok["phase_orientation_input"], tok["phase_implementation_input"], tok["phase_verification_input"]) == (16, 0, 20)
    log = TM.event_log(e)
    got = [(r["tool"], r["tool_class"], r["tokens_in"], r["cumulative_input_tokens"]) for r in log.orderBy("seq", "k").collect()]
    assert got[1:4] == [("Read", "nav", 16, 16), ("Bash", "git_op", 0, 16), ("Edit", "edit", 0, 16)]
    nav = TM.run_navigation(log, "/w").first()
    assert nav["file_reads_total"] == 1 and nav["files_edited"] == 1 and nav["nav_entropy"] == 0
    ops = TM.run_operations(e, log).first()
    assert (ops["turns_total"], ops["max_tool_uses_per_message"], ops["tool_calls_total"], ops["message_count"]) == (2, 3, 3, 5)
    assert TM.run_timing(e).first()["wall_clock_seconds"] == 20.5
    assert TM.run_record(e).first()["tokens"]["total_output"] == 7


def test_read_jsonl(spark, tmp_path):
    body = '{"type":"user","message":{"content":"x"}}\nnot json\n\n[1]\n{"type":"assistant","message":{"id":"a"}}\n'
    (tmp_path / "a.jsonl").write_text(body)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(body)
    got = TS.read_jsonl(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz"))
    assert sorted(r["line_no"] for r in got.collect()) == [1, 1, 5, 5]
    # a file that lacks is its compressed sibling, and the other way; neither is no rows
    sibling = TS.read_jsonl(spark, str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl.gz"), str(tmp_path / "none.jsonl"))
    assert sorted(r["line_no"] for r in sibling.collect()) == [1, 1, 5, 5]
    assert TS.read_jsonl(spark, str(tmp_path / "none.jsonl")).collect() == []


def test_splits(spark, tmp_path):
    """Line numbers and transactions of a file that many tasks read."""
    from tallyforge.sources import ledgers as S
    from tallyforge.sources import lines as SL

    (tmp_path / "long.txt").write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(1, 5001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = spark.read.text(str(tmp_path / "long.txt"))
        assert raw.rdd.getNumPartitions() > 5
        got = SL.numbered_lines(spark, str(tmp_path / "long.txt")).collect()
        assert sorted((r["line_no"], r["line"].split()[1]) for r in got) == [(k, str(k)) for k in range(1, 5001)]
        (tmp_path / "book.txt").write_text("".join(f"2024-01-{k % 28 + 1:02d} buy {k}\n    assets.a  {k}.00 USD\n    income.b\n" for k in range(1, 1501)))
        book = S.read_ledger(spark, str(tmp_path / "book.txt"))
        assert book.groupBy("txn_id").agg(F.sum("amount_minor").alias("net"), F.count("*").alias("n")).where("net <> 0 or n <> 2").count() == 0
        rows = {r["ordinal"]: (r["line_no"], r["description"], r["amount_minor"]) for r in book.collect()}
        assert len(rows) == 3000 and rows[3 * 777 - 1] == (3 * 777 - 2, "buy 777", 77700) and rows[3 * 777] == (3 * 777 - 2, "buy 777", -77700)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert SL.read_json(spark, str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    (tmp_path / "odd.json").write_text("{no")
    (tmp_path / "fine.json").write_text('{"b": 2}')
    assert SL.read_json(spark, str(tmp_path / "odd.json"), []) == [] and SL.read_json(spark, str(tmp_path / "fine.json")) == {"b": 2}


def test_items(spark):
    raw = lines(spark, {"type": "turn.completed", "usage": {"input_tokens": 9}}, {"type": "thread.started", "thread_id": "x"}, {"type": "item.started"}, {"type": "item.completed", "item": {"id": "i1", "type": "command_execution", "command": "bash -lc 'cat src/a.py'", "exit_code": 0}}, {"type": "item.completed", "item": {"id": "i2", "type": "file_change", "changes": [{"path": "a.py"}, {"path": ""}, {"path": "b.py"}]}}, {"type": "item.completed", "item": {"id": "i3", "type": "agent_message", "text": "done"}}, {"type": "turn.completed", "usage": {"input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 7}})
    rows = TS.items(raw).orderBy("seq").collect()
    assert [r["text"] for r in rows] == ["__session_start__", "", "", "", "done", "__usage__"]
    assert rows[1]["tools"][0]["input"] == {"command": "bash -lc 'cat src/a.py'", "cmd_class": "nav", "read_file": "src/a.py"}
    assert [r["tools"][0]["input"]["file_path"] for r in rows[2:4]] == ["a.py", "b.py"]
    assert (rows[5]["tokens_in"], rows[5]["cache_read"], rows[5]["tokens_out"]) == (100, 40, 7)
    tok = TM.run_tokens(TS.items(raw)).first()
    assert (tok["phase_orientation_input"], tok["phase_verification_input"]) == (100, 0)


def test_cumulative(spark):
    first = {"id": "g1", "type": "gemini", "timestamp": "t", "content": "a", "tokens": {"input": 10, "cached": 2, "output": 1}}
    raw = lines(spark, {"sessionId": "h"}, {"id": "u1", "type": "user", "content": "q"}, first, {"$set": {"messages": [{"id": "g1", "type": "gemini", "toolCalls": [{"name": "read_many_files", "args": {"paths": ["x", "y"]}, "id": "c"}, {"name": "write_file", "args": {"file_path": "z"}}, {"name": "odd"}]}, {"id": "g2", "type": "gemini", "tokens": {"input": 25, "cached": 1, "output": 2}}]}})
    rows = TS.cumulative(raw).orderBy("seq").collect()
    assert [(r["role"], r["tokens_in"], r["cache_read"], r["tokens_out"]) for r in rows] == [("user", 0, 0, 0), ("assistant", 12, 2, 1), ("assistant", 14, 0, 2)]
    assert [(t["name"], t["input"].get("file_path"), t["input"].get("cmd_class")) for t in rows[1]["tools"]] == [("Read", "x", None), ("Read", "y", None), ("Write", "z", None), ("Bash", None, "meta")]
    assert rows[1]["text"] == "a"


def test_steps(spark):
    call = lambda name, **a: {"name": name, "args": a}
    raw = lines(spark, {"type": "USER_INPUT", "content": "q", "created_at": "t"}, {"type": "PLANNER_RESPONSE", "content": "p", "tool_calls": [call("view_file", AbsolutePath="/a"), call("run_command", CommandLine="grep x src/y.py"), call("find_by_name", SearchDirectory="/d", Pattern="q"), call("KnowledgeWriteToFile", Path="n.md"), call("BrowserClick", Url="u"), call("manage_task")]}, {"type": "CHECKPOINT"})
    rows = TS.steps(raw).orderBy("seq").collect()
    assert len(rows) == 2
    assert [(t["name"], t["input"].get("cmd_class"), t["input"].get("file_path") or t["input"].get("read_file")) for t in rows[1]["tools"]] == [("Read", None, "/a"), ("Bash", "search", "src/y.py"), ("Bash", "search", "/d"), ("Edit", None, "memory/n.md"), ("WebFetch", None, None), ("Bash", "meta", None)]


def test_blob_tokens(spark, tmp_path):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(i, o):
        inner = b"\x10" + varint(i) + b"\x18" + varint(o)
        return b"\x0a" + varint(len(inner)) + inner

    db = sqlite3.connect(tmp_path / "g.db")
    db.execute("create table gen_metadata (idx integer, data blob)")
    db.executemany("insert into gen_metadata values (?, ?)", [(0, message(1000, 5)), (1, message(3000, 7)), (2, b"\xff")])
    db.commit()
    got = TS.blob_tokens(spark, str(tmp_path / "g.db")).first()
    assert (got["total_input"], got["total_output"], got["peak_input"], got["calls"]) == (4000, 12, 3000, 2)


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:01.5Z",), ("2024-01-01T02:00:02+02:00",), ("2024-01-01",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(F.unix_micros(T.parse_ts(F.col("t")))).collect()]
    assert got[1] - got[0] == 1_500_000 and got[2] - got[0] == 2_000_000 and got[3:] == [None] * 3


@pytest.mark.parametrize(
    "command, want",
    [
        ("a && b || c; d | e", ["a", "b", "c", "d", "e"]),
        ("echo 'x; y' \"p && q\"", ["echo 'x; y' \"p && q\""]),
        ("x=$(a; b) && c", ["x=$(a; b)", "c"]),
        ("run & wait\nmore 2>&1", ["run", "wait", "more 2>&1"]),
        ("a \\; b", ["a \\; b"]),
        ("", []),
        (None, []),
    ],
)
def test_shell_segments(command, want):
    assert D.shell_segments(command) == want


def test_diff():
    files = D.diff_files("diff --git a/x b/y\nrename from x\nrename to y\n@@ -1 +5,2 @@\n a\n+b\n-c\n+++d\ndiff --git a/z b/z\ndeleted file mode 1\n@@ -1 +0,0 @@\n-q\ndiff --git a/p b/p\nBinary files differ\n")
    assert [(f["path"], f["status"], f["old_path"], f["binary"]) for f in files] == [("y", "renamed", "x", False), ("z", "deleted", None, False), ("p", "modified", None, True)]
    assert files[0]["added"] == [{"line_no": 6, "text": "b"}, {"line_no": 7, "text": "++d"}]
    assert D.diff_files(None) == [] and D.strip_comments("a = '#' # c\nb", "py") == "a = '#'    \nb"


def test_parse_ladder():
    good = {"probe_id": "WURP-0a1b2c3d-004", "facts": [{"fact": "f", "source": "s", "affects_next_action": True}] * 3, "next_action": "n"}
    strict = P.parse(f"text\n```json\n{json.dumps(good)}\n```", "WURP-0a1b2c3d-005")
    assert strict["parse_tier"] == "strict" and strict["errors"] == ["probe_id differs"]
    short = P.parse('so {"facts": [{"fact": "x", "affects_next_action": "yes"},], "nextAction": "go"} and {')
    assert short["parse_tier"] == "lenient" and len(short["slots"]) == 3 and short["slots"][0]["affects_next_action"] is True and short["next_action"] == "go"
    assert P.parse("nothing here")["parse_tier"] == "failed" and P.parse(None)["parse_ok"] is False
    assert P.balanced_objects('a {"b": "}"} {c {d}} {') == ['{"b": "}"}', "{c {d}}"]


def test_tokens_and_globs():
    import re

    token = X.mint("f1", "0f1e")
    assert token == X.mint("f1", "0f1e") != X.mint("f2", "0f1e") and X.mint("f1", "0f2e") != token != X.mint("f1", "0f1e", salt="s")
    assert X.mint("f1", "0f1e", avoid=(token.lower().replace("-", " "),)) != token
    many = [X.mint(f"f{k}", "0f1e") for k in range(500)]
    assert len(set(many)) == 500 and all(re.fullmatch(r"ZQ-[A-HJ-NP-Z2-9]{8}", t) and not re.search(r"(.)\1\1", t[3:]) and re.search("[2-9]", t[3:]) and re.search("[A-Z]", t[3:]) for t in many)
    # the first attempt of a fact, digit by digit
    number = int.from_bytes(hashlib.blake2s(b"wur-v1|0f1e|f1|0", digest_size=16, person=b"wurnonce").digest(), "big")
    digits = [number >> 5 * k & 31 for k in range(8)][::-1]
    assert token == "ZQ-" + "".join(X.ALPHABET[d] for d in digits)
    for wrong in (("", "0f1e", {}), ("f", "", {}), ("f", "0f1e", {"prefix": "O1"}), ("f", "0f1e", {"size": 5})):
        with pytest.raises(ValueError):
            X.mint(*wrong[:2], **wrong[2])

    for pattern, path, hit in (("*.py", "a/b.py", True), ("src/**/x.py", "src/x.py", True), ("src/*.py", "src/a/b.py", False), ("a?[!b].c", "aXc.c", True), ("a?[!b].c", "aXb.c", False)):
        assert bool(re.search(X.glob_regex(pattern), path)) is hit


def test_trace(spark):
    runs = spark.createDataFrame(
        [("a", "f", "d2", True, None, None, "tok", None, False, False, True, 1, 1.0, 1.0), ("b", "f", "ctrl", False, None, None, "", None, False, False, True, 1, 1.0, 1.0), ("c", "f", "d2", True, None, None, "tok", None, True, False, True, 1, 1.0, 1.0), ("d", "f", "d0-push", True, None, None, "tok", None, False, False, True, 3, 1.0, 1.0), ("e", "f", "d2", True, None, None, "tok", None, False, True, False, 1, 0.5, 0.5)],
        "run_id string, fact_id string, condition_id string, factor_present boolean, meta_available boolean, meta_basis string, token string, factor_channel string, error_on_target boolean, cut_on_target boolean, run_completed boolean, max_tool_uses int, join_coverage double, parse_ok_rate double",
    )
    runs = runs.withColumn("plant_ok", F.lit(True)).withColumn("hygiene_ok", F.lit(True)).withColumn("sidechain_barriers", F.lit(0)).withColumn("superseded", F.lit(0))
    exposure = spark.createDataFrame([("a", "f", 5, 0, "tool_read", "exact", True, True, 100), ("b", "f", 3, 0, "self_thinking", "lower", False, True, 10)], "run_id string, fact_id string, seq long, region_idx long, channel string, match_form string, inbound boolean, counts_toward_read boolean, bytes_before long")
    mentions = TR.mention_runs(spark.createDataFrame([("a", k, 10 * k, True, k in (1, 2), None) for k in range(5)], "run_id string, probe_idx int, sent_seq long, observed boolean, mentioned boolean, first_used_seq long"))
    got = {r["run_id"]: r for r in TR.fact_trace(runs, exposure, mentions).collect()}
    assert got["a"]["read_status"] == "read" and got["a"]["first_exposure_seq"] == 5 and got["a"]["lapse_probe_index"] == 2 and got["a"]["mention_run_length"] == 2 and got["a"]["analyzable"]
    assert got["b"]["unexplained_possession"] and "control_invariant_broken" in got["b"]["quarantine_reason"] and got["b"]["exclusion_reason"] == "unexplained_possession"
    assert got["c"]["read_status"] == "read_error" and got["c"]["read"] is None
    assert got["d"]["exposure_basis"] == "manifest_canary" and got["d"]["read"] and got["d"]["exclusion_reason"] == "pacing_failed"
    assert got["e"]["read_status"] == "unknown" and got["e"]["exclusion_reason"] == "join_coverage_low" and got["e"]["probe_integrity"] == "parse_degraded"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("r", None, True), ("s", 3, None)], "run_id string, rep long, read boolean")
    TB.write_tables({"fact_trace": df, "empty": df.where("false")}, str(tmp_path), csv=True)
    assert TB.same_rows(TB.load_table(spark, str(tmp_path), "fact_trace", df.schema), df)
    assert TB.load_table(spark, str(tmp_path), "missing", df.schema).count() == 0 and TB.load_table(spark, str(tmp_path), "empty", df.schema).columns == df.columns
    text = spark.read.csv(str(tmp_path / "fact_trace.csv"), header=True)
    assert TB.same_rows(TB.typed(text), df)
    with pytest.raises(ValueError):
        TB.rules_of({"contains": []})
    with pytest.raises(Exception, match="versions"):
        TB.guarded(spark.createDataFrame([("1",), ("2",)], "v string"), "v", ("1", "2")).collect()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_text("hello")
    (tmp_path / "w" / "b.bin").write_bytes(b"a\x00b")
    assert [r["text"] for r in TB.workspace_files(spark, str(tmp_path / "w")).collect()] == ["hello"]
    assert TB.input_manifest(spark, str(tmp_path / "w")).count() == 2


def test_schedule(spark):
    """The seeded draws, by the standard generator: blocks first, then the arms of each block by its own name."""
    import random

    from tallyforge.operators import design as DS

    tasks, arms = ["t1", "t2", "t3"], ["ctrl", "d1", "d2"]
    draw = lambda *parts: random.Random(int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:16], 16))
    blocks = [(t, r) for t in tasks for r in (1, 2)]
    draw("wur-v1", "blocks", "j", "5").shuffle(blocks)
    want = []
    for task, rep in blocks:
        own = list(arms)
        draw("wur-v1", "within", "j", "5", task, str(rep)).shuffle(own)
        want += [(task, a, rep) for a in own]
    got = DS.schedule(spark, job="j", tasks=tasks, conditions=arms, reps=2, seed=5).orderBy("run_order_index").collect()
    assert [(r["task_id"], r["condition_id"], r["rep"]) for r in got] == want
    assert sorted(r["cell_index"] for r in got) == list(range(18)) and [r["block_index"] for r in got] == [k // 3 for k in range(18)]
    assert next(r["cell_index"] for r in got if (r["task_id"], r["condition_id"], r["rep"]) == ("t2", "d1", 2)) == 9
    # another task leaves a block's own order alone
    more = DS.schedule(spark, job="j", tasks=[*tasks, "t4"], conditions=arms, reps=2, seed=5).where("task_id = 't2' and rep = 1").orderBy("within_block_index").collect()
    assert [r["condition_id"] for r in more] == [a for t, a, r in want if (t, r) == ("t2", 1)]
    with pytest.raises(ValueError):
        DS.schedule(spark, job="j", tasks=["a", "a"], conditions=arms)
    same = DS.design_sha256(job="j", tasks=tasks, conditions=arms, reps=2, seed=5)
    assert same == DS.design_sha256(job="j", tasks=tasks[::-1], conditions=arms[::-1], reps=2, seed=5) != DS.design_sha256(job="j", tasks=tasks, conditions=arms, reps=3, seed=5)
    text = '{"block_key":["task_id","rep"],"conditions":["ctrl","d1","d2"],"design_version":"wur-schedule-v1","experiment":"wur","job_id":"j","matrix_seed":5,"reps":2,"salt":"wur-v1","tasks":["t1","t2","t3"]}'
    assert same == hashlib.sha256(text.encode()).hexdigest()
    frame = DS.schedule(spark, job="j", tasks=tasks, conditions=arms, reps=2, seed=5)
    assert DS.order_sha256(frame.repartition(3)) == hashlib.sha256(json.dumps([list(w) for w in want], separators=(",", ":")).encode()).hexdigest()
