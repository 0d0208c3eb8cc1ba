"""Regions, grading, registry and rendering."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import grading as G
from tallyforge.operators import regions as RG
from tallyforge.plans import render


def lines(spark, *objs):
    return spark.createDataFrame([("r", k + 1, json.dumps(o)) for k, o in enumerate(objs)], "run_id string, line_no long, line string")


def say(role, *content, **more):
    return {"type": role, "message": {"role": role, "content": list(content)}, **more}


def test_stream_regions(spark):
    result = lambda id_, body, **m: {"type": "tool_result", "tool_use_id": id_, "content": body, **m}
    use = lambda name, id_, **i: {"type": "tool_use", "name": name, "id": id_, "input": i}
    raw = lines(
        spark,
        {"type": "system", "subtype": "init", "tools": ["Read"], "model": "m"},
        say("user", {"type": "text", "text": "do it <system-reminder>psst</system-reminder> now"}),
        say("assistant", {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, use("Read", "a", file_path="x"), use("Bash", "b", command="ls"), use("Grep", "c", output_mode="count"), use("Odd", "d"), use("Write", "e"), use("Read", "f")),
        say("user", result("a", "file text"), result("b", "12345<persisted-output>p</persisted-output>67890"), result("c", [{"type": "text", "text": "l1"}, {"type": "text", "text": "l2"}]), result("d", "?"), result("e", "denied", is_error=True), result("f", "File content (300 KB) exceeds maximum allowed size (256 KB)", is_error=True)),
        say("assistant", {"type": "text", "text": "WURP-0123abcd-001 {}"}, {"type": "image"}),
        {"type": "user", "message": {"role": "user", "content": "WURP-0123abcd-002 please"}},
        {"type": "result"},
    )
    rows = RG.stream_regions(raw).orderBy("region_idx").collect()
    got = [(r["channel"], r["text"]) for r in rows]
    assert got[0][0] == "system_init_listing"
    assert got[1:4] == [("harness_task_prompt", "do it "), ("system_reminder", "<system-reminder>psst</system-reminder>"), ("harness_task_prompt", " now")]
    assert got[4:6] == [("self_thinking", "hm"), ("self_text", "ok")]
    assert [c for c, _ in got[6:12]] == ["tool_input"] * 6
    assert got[12:] == [("tool_read", "file text"), ("bash_stdout", "12345"), ("bash_unattributed", "<persisted-output>p</persisted-output>"), ("bash_stdout", "67890"), ("tool_glob_filenames", "l1l2"), ("unknown_visible", "?"), ("tool_write_echo", "denied"), ("probe_answer", "WURP-0123abcd-001 {}"), ("unknown_visible", '{"type":"image"}'), ("harness_probe", "WURP-0123abcd-002 please")]
    by = {r["channel"]: r for r in rows}
    assert not by["tool_write_echo"]["inbound"] and by["tool_read"]["inbound"] and by["tool_read"]["tool"] == "Read"
    assert [r["tool_use_id"] for r in RG.read_errors(raw).collect()] == ["f"]
    assert RG.unknown_visible(RG.stream_regions(raw)).first()["n"] == 2
    assert [r["kind"] for r in raw.select(RG.record_kind().alias("kind")).collect()] == ["system_init", "user", "assistant", "user", "assistant", "user", "result"]
    twice = RG.stream_regions(raw).unionByName(RG.stream_regions(raw))
    assert RG.once_by_text(twice).count() == RG.once_by_text(RG.stream_regions(raw)).count()


def test_shell_cap(spark):
    df = spark.createDataFrame([("abcdef<persisted-output>P</persisted-output>ghij",), ("",), ("abc",)], "t string")
    none = F.lit(None).cast("string")
    got = [[(r["channel"], r["text"]) for r in row["x"]] for row in df.select(RG.shell_regions(F.col("t"), none, none, cap=8).alias("x")).collect()]
    assert got == [[("bash_stdout", "abcdef"), ("bash_unattributed", "<persisted-output>P</persisted-output>"), ("bash_stdout", "gh"), ("bash_unattributed", "ij")], [("bash_stdout", "")], [("bash_stdout", "abc")]]


def test_grades(spark):
    votes = spark.createDataFrame([("r", "c1", True), ("r", "c1", False), ("r", "c1", True), ("r", "c2", None), ("r", "c3", True), ("r", "c3", False), ("s", "c1", True), ("t", "c1", False), ("u", "c1", None), ("v", "c1", True)], "run_id string, criterion_id string, met boolean")
    met = {(r["run_id"], r["criterion_id"]): r["met"] for r in G.majority(votes).collect()}
    assert met["r", "c1"] is True and met["r", "c2"] is None and met["r", "c3"] is False
    codes = spark.createDataFrame([("v", 124)], "run_id string, exit_code int")
    got = {r["run_id"]: (r["verdict"], r["score"]) for r in G.judged(G.majority(votes), codes).collect()}
    assert got == {"r": ("partial", 0.5), "s": ("accepted", 1.0), "t": ("rejected", 0.0), "u": ("error", None), "v": ("timeout", 1.0)}
    proof = spark.createDataFrame([("c", "reference", True, "fail"), ("c", "base", False, "fail"), ("d", "reference", None, "fail"), ("d", "base", True, "fail")], "criterion_id string, tree string, met boolean, expect_on_base string")
    assert {r["criterion_id"]: (r["references_pass"], r["base_as_expected"]) for r in G.proofs(proof).collect()} == {"c": (True, True), "d": (False, False)}
    fires = spark.createDataFrame([(f, k < n) for f, n, m in (("a", 0, 12), ("b", 1, 12), ("c", 2, 12), ("d", 0, 3)) for k in range(m)], "fact_id string, fired boolean")
    assert {r["fact_id"]: r["status"] for r in G.admission(fires).collect()} == {"a": "pass", "b": "weak", "c": "fail", "d": "unevaluable"}


def test_lints(spark):
    rows = [("a", "mechanical", "grep -rn word .", "exit_code == 0 and x"), ("b", "mechanical", "pytest -q | tail", "(lambda d: exit_code == 0)(json.loads(stdout))"), ("c", "mechanical", "git diff | cat", "open('x')"), ("d", "llm", "grep -r", "open"), ("e", "mechanical", "echo 'a | b' || true", "stdout.open")]
    df = spark.createDataFrame(rows, "id string, kind string, command string, pass_condition string")
    got = {(r["id"], r["kind"]) for r in G.lint_criteria(df).collect()}
    assert got == {("a", "tree_grep"), ("a", "short_circuit"), ("b", "double_quiet"), ("b", "pipe"), ("b", "guard_inside_lambda"), ("c", "pipe"), ("c", "sandbox")}
    assert ("a", "short_circuit") not in {(r["id"], r["kind"]) for r in G.lint_criteria(df, two_sided=True).collect()}


def test_registry(spark):
    cards = G.read_registry(spark, '{"facts": {"f1": {"task_id": "t1", "nonce": "QX-AB12", "regexes": ["x y"]}}}', "- fact_id: f2\n  task_id: t1\n  token: ab\n- id: f 3\n  token: QX-ZZ99\n  pattern: the\n")
    assert {r["fact_id"]: r["token"] for r in cards.collect()} == {"f1": "QX-AB12", "f2": "ab", "f 3": "QX-ZZ99"}
    with pytest.raises(ValueError, match="twice"):
        G.read_registry(spark, '[{"fact_id": "a"}]', '[{"fact_id": "a"}]')
    assert {(r["fact_id"], r["problem"]) for r in G.lint_registry(cards).collect()} == {("f1", "several facts of one task"), ("f2", "token"), ("f 3", "id"), ("f 3", "pattern matches common words")}
    texts = spark.createDataFrame([("a", "see qx_ab12!"), ("b", "clean"), ("c", None)], "name string, text string")
    assert [(r["name"], r["fact_id"]) for r in G.leaks(texts, cards.where("token <> 'ab'")).collect()] == [("a", "f1")]
    runs = spark.createDataFrame([("r1", "t1"), ("r2", "t9")], "run_id string, task_id string")
    assert sorted((r["run_id"], r["fact_id"]) for r in G.cards_for(cards, runs).collect()) == [("r1", "f1"), ("r1", "f2"), ("r2", "f 3"), ("r2", "f1"), ("r2", "f2")]
    assert G.length_report(texts).where("name = 'a'").first()["n_words"] == 2
    same = lambda rows: {r["k"]: r["sha256"] for r in G.content_hash(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    assert same([("a", 1), ("a", 2)]) == same([("a", 2), ("a", 1)]) != same([("a", 1)])


def test_job_spec():
    got = G.job_spec({"tasks": ["t", {"task_id": "u"}], "conditions": ["x", "ctrl"]})
    assert got["baseline"] == "ctrl" and got["reps"] == 1 and [t["task_id"] for t in got["tasks"]] == ["t", "u"]
    assert G.job_spec({"tasks": ["t"], "envs": ["E3", "E1"]})["baseline"] == "E3"
    with pytest.raises(ValueError, match="no tasks; no conditions; reps"):
        G.job_spec({"reps": 0})
    with pytest.raises(ValueError, match="baseline"):
        G.job_spec({"tasks": ["t"], "conditions": ["x"], "baseline_condition": "y"})


def test_run_folders(spark):
    files = spark.createDataFrame([("/j/a/stream.jsonl.gz",), ("/j/a/probe_events.jsonl",), ("/j/b/notes.txt",), ("/j/.c/judge.json",), ("/j/d/judge.json",)], "path string")
    assert {r["run_dir"]: (r["markers"], r["has_probe_channel"]) for r in G.run_folders(files).collect()} == {"/j/a": (["stream.jsonl"], True), "/j/d": (["judge.json"], False)}


def test_render(spark):
    assert render.table(["name", "n"], [["a", "10"], ["bcd", "-2"], ["x"]]) == "name   n\n----  --\na     10\nbcd   -2\nx"
    df = spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z long")
    assert render.markdown(df) == "| x | y | z |\n|---|---|---|\n| a\\|b | 0.500 |  |"
    assert render.truncated("abcdef", 5) == "ab..." and render.bullets(["a"]) == "- a" and "## t" in render.scorecard("c", {"t": df}) and "0.500" in render.text_table(df)
