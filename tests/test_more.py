"""Schema keywords, loose flags, designs, clustered slopes, registries, predicates' parameters, and what must raise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import mixed
from tallyforge.operators import chart as C
from tallyforge.operators import design as DS
from tallyforge.operators import detectors as D
from tallyforge.operators import grading as G
from tallyforge.operators import runs as RN
from tallyforge.operators import tables as TB


def test_schema_keywords(spark):
    schema = {"$defs": {"name": {"type": "string", "minLength": 2}}, "required": ["a"], "properties": {"a": {"$ref": "#/$defs/name"}, "b": {"oneOf": [{"minimum": 5}, {"maximum": 7}]}, "c": {"not": {"const": "x"}}}}
    df = spark.createDataFrame([("ok", 1, "y"), ("o", 1, "y"), ("ok", 6, "y"), ("ok", 1, "x"), (None, 9, None)], "a string, b long, c string")
    got = sorted(r["message"] for r in TB.violations(df, schema).collect())
    assert got == ["a: minLength", "a: null", "b: not one of the alternatives", "c: what it may not be"]
    with pytest.raises(ValueError, match="reference"):
        TB.rules_of({"properties": {"a": {"$ref": "other.json"}}})
    with pytest.raises(ValueError, match="reference"):
        TB.rules_of({"$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}, "properties": {"a": {"$ref": "#/$defs/n"}}})


def test_flags(spark):
    df = spark.createDataFrame([("Yes",), (" n ",), ("1",), ("2",), (None,)], "t string")
    assert [r[0] for r in df.select(TB.loose_flag(F.col("t"))).collect()] == [True, False, True, None, None]
    assert df.select(TB.flag_or_null(df, "none").alias("x")).where("x is not null").count() == 0


def test_designs(spark):
    assert DS.run_id_for("j", "t1", "d1", "a", 3) == "j-t1-d1-a-r003" and DS.family_alpha(0.09, 9) == pytest.approx(0.01)
    table = DS.type_one(spark, p0s=(0.2,), gammas=(0.0, 2.0), sims=400, permutations=20).collect()
    assert len(table) == 2 and all(0 <= r["paired_t"] <= 0.12 for r in table) and table[1]["cmh"] > table[0]["cmh"] - 0.05
    import hashlib
    import random

    rng, at, want = random.Random(int(hashlib.sha256(b"wur-v1|t1|2").hexdigest()[:16], 16)), 0, []
    while at < 20:
        at += rng.randint(1, 3)
        want.append(at)
    assert DS.cadence("t1", 2, 20) == want


def test_exchangeable(spark):
    """The estimating equations against a plain version on rows, matrix by matrix."""
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", float(x), bool(rng.random() < 1 / (1 + np.exp(-(-0.5 + 0.6 * x + b))))) for t, b in enumerate(rng.normal(0, 0.8, 14)) for x in (0, 1, 2) for _ in range(6)]
    got = mixed.exchangeable_logistic(spark.createDataFrame(rows, "task_id string, x double, y boolean"), "y", "x")
    task, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    beta = np.zeros(2)
    for _ in range(80):
        design = np.stack([np.ones(len(x)), x], axis=1)
        p = 1 / (1 + np.exp(-design @ beta))
        r = (y - p) / np.sqrt(p * (1 - p))
        phi, num, pairs = (r**2).sum() / (len(y) - 2), 0.0, 0
        for t in set(task):
            own = r[task == t]
            num += (own.sum() ** 2 - (own**2).sum()) / 2
            pairs += len(own) * (len(own) - 1) / 2
        alpha = num / (phi * (pairs - 2))
        info, score, meat = np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
        for t in set(task):
            at = task == t
            d = design[at] * (p * (1 - p))[at][:, None]
            a = np.diag(np.sqrt((p * (1 - p))[at]))
            corr = np.full((at.sum(), at.sum()), alpha) + (1 - alpha) * np.eye(at.sum())
            inv = np.linalg.inv(a @ corr @ a)
            own = d.T @ inv @ (y - p)[at]
            info, score, meat = info + d.T @ inv @ d, score + own, meat + np.outer(own, own)
        beta = beta + np.linalg.solve(info, score)
    bread = np.linalg.inv(info)
    assert got["coef"] == pytest.approx(beta[1], abs=1e-5) and got["alpha"] == pytest.approx(alpha, abs=1e-5) and got["se"] == pytest.approx(np.sqrt((bread @ meat @ bread)[1, 1]), rel=1e-4)
    assert 0 < got["p_value"] < 0.05 and got["n_groups"] == 14
    flat = spark.createDataFrame([("a", 1.0, True)] * 5, "task_id string, x double, y boolean")
    assert mixed.exchangeable_logistic(flat, "y", "x")["error"] == "degenerate"


def test_registry_views(spark):
    cards = spark.createDataFrame([("f1", "t1", "ZQ-4KM7TXP2", ["ZQ-AAAA2222", ""]), ("f2", "t2", None, None)], "fact_id string, task_id string, token string, distractors array<string>")
    assert {(r["label"], r["token"]) for r in G.searched_tokens(cards).collect()} == {("f1", "ZQ-4KM7TXP2"), ("f1::distractor::0", "ZQ-AAAA2222")}
    tasks = spark.createDataFrame([("t1",), ("t9",)], "task_id string")
    assert {(r["task_id"], r["fact_id"]) for r in G.fact_of_task(cards, tasks, strict=False).collect()} == {("t1", "f1"), ("t9", None)}
    with pytest.raises(Exception, match="no fact of task t9"):
        G.fact_of_task(cards, tasks).collect()
    texts = spark.createDataFrame([("a", "clean"), ("b", "zq 4km7 txp2")], "name string, text string")
    assert G.absent_from(texts.where("name = 'a'"), cards).count() == 1
    with pytest.raises(Exception, match="a token is in b"):
        G.absent_from(texts, cards).collect()
    stages = spark.createDataFrame([(None, 0, 2, None, None), (0, 0, 2, None, None), (0, 1, 2, None, None), (0, 0, 1, None, None), (0, 0, 2, 1, 12), (0, 0, 2, 0, 5), (0, 0, 2, 2, 12), (0, 0, 2, 0, 12)], "a int, b int, near int, c int, n int")
    got = [r[0] for r in stages.select(G.prior_status(*(F.col(c) for c in ("a", "b", "near", "c", "n")))).collect()]
    assert got == ["n_a", "pass", "fail", "fail", "weak", "fail", "fail", "pass"]


def test_predicates(spark):
    assert set(D.PARAMETERS) == set(D.PREDICATES) and D.parameter_problems("path_untouched", {"paths": ["a/**"]}) == []
    assert D.parameter_problems("none", {}) == ["no predicate none"]
    assert D.parameter_problems("content_present", {"pattern": "(", "paths": "a", "x": 1}) == ["x: unknown", "pattern: not a pattern", "paths: not a list of texts"]
    assert D.parameter_problems("command_order", {"before": ""}) == ["after: missing", "before: not a text"]
    assert D.manifest(spark).count() == len(D.PREDICATES)


def test_predicates_in_one_pass(spark):
    """All rules of a run's tables at once are as each alone; nothing is joined, so no table of runs is broadcast."""
    diff = "diff --git a/src/m.py b/src/m.py\n@@ -1,1 +1,2 @@\n+total = 2\n"
    diffs = spark.createDataFrame([("a", diff), ("a", diff.replace("src/m.py", "docs/x.md")), ("b", diff.replace("2", "3")), ("c", None), (None, diff), ("z", diff)], "run_id string, diff string")
    commands = spark.createDataFrame([("a", 1, "pytest -q"), ("a", 2, "git commit -m x"), ("b", 1, "git commit -m x; pytest"), (None, 1, "pytest")], "run_id string, seq int, command string")
    runs = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "run_id string")
    files, segs = D.changed_files(diffs), D.run_segments(commands)
    every = D.verdicts(runs, [("path_untouched", D.untouched(["docs/**"])), ("diff_confined", D.confined(["src/**"])), ("content_present", D.present("total = 2")), ("content_absent", D.absent("total = 2", ["*.md"])), ("command_used", D.used("^pytest")), ("command_order", D.ordered("^pytest", "^git commit"))], files=files, segments=segs)
    lines = D.added_lines(files)
    alone = [D.path_untouched(runs, files, ["docs/**"]), D.diff_confined(runs, files, ["src/**"]), D.content_present(runs, lines, "total = 2"), D.content_absent(runs, lines, "total = 2", ["*.md"]), D.command_used(runs, segs, "^pytest"), D.command_order(runs, segs, "^pytest", "^git commit")]
    key = lambda dfs: sorted(map(str, (tuple(r) for df in dfs for r in df.collect())))
    assert key([every]) == key(alone) and every.count() == 30
    fired = {(r["run_id"], r["predicate"]) for r in every.collect() if r["fired"]}
    assert fired == {("a", "content_present"), ("a", "command_used"), ("a", "command_order"), ("b", "path_untouched"), ("b", "diff_confined"), ("b", "command_used")}
    able = {(r["run_id"], r["predicate"]) for r in every.collect() if r["eligible"]}
    assert able == fired | {("a", "path_untouched"), ("a", "diff_confined"), ("a", "content_absent"), ("b", "content_present"), ("b", "command_order")}
    assert "Join" not in every._jdf.queryExecution().optimizedPlan().toString()


def test_refusals_of_operators(spark):
    with pytest.raises(Exception, match="no token is minted"):
        spark.range(1).select(RN.with_token(F.lit("say {nonce}"), F.lit(None).cast("string"))).collect()
    regions = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", True, True)], "t string, model_visible boolean, digested boolean")
    assert RN.undigested(regions.where("t <> 'c'")).count() == 2
    with pytest.raises(Exception, match="digested before"):
        RN.undigested(regions).collect()
    empty = spark.createDataFrame([], "code string, name string, currency string, closed boolean")
    assert C.with_parts(empty).collect() == [] and C.chart_problems(empty).collect() == []


def test_large_registry(spark, monkeypatch):
    """Many tokens looked up by grams are found as each by its own expressions."""
    import random

    from tallyforge.functions import text as X
    from tallyforge.operators import exposure as XP

    rng = random.Random(3)
    tokens = [X.mint(f"f{k}", "0f1e") for k in range(60)]
    spelled = lambda t: rng.choice([t, t.lower(), t.replace("-", "_"), t[:5] + " " + t[5:], t[:-1], t + t, t.replace("-", "").lower()])
    rows = [(f"r{k % 7}", k, k, rng.choice(["tool_read", "self_text", "sidecar_only"]), rng.choice([None, "", "é " * 5]) if k % 9 == 0 else " ".join(rng.choice(["word", "é", spelled(rng.choice(tokens))]) for _ in range(rng.randint(1, 12)))) for k in range(300)]
    regions = spark.createDataFrame(rows, "run_id string, seq long, region_idx long, channel string, text string")
    cards = spark.createDataFrame([(f"f{k}", t, r"wo.d" if k == 3 else None) for k, t in enumerate(tokens)] + [("short", "QX-1", None)], "fact_id string, token string, pattern string")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    one = key(XP.scan(regions, cards))
    monkeypatch.setattr(XP, "BLOCK", 10)
    assert key(XP.scan(regions, cards)) == one and len({r[5] for r in one}) == 4 and len(one) > 300


def test_plans_of_large_registries(spark):
    """A plan doesn't grow with its tokens: a hundred thousand take as many nodes and characters as a thousand, nearly."""
    from tallyforge.operators import exposure as XP

    plans, texts = [], spark.createDataFrame([("a", "x tok-77-q y"), ("b", "TOK 99 999 Q"), ("c", None), ("d", "tok-1")], "name string, text string")
    for n in (1000, 100_000):
        cards = spark.range(n).selectExpr("concat('f', id) as fact_id", "concat('tok-', id, '-q') as token", "cast(null as string) as pattern")
        found = G.leaks(texts, cards)
        regions = texts.selectExpr("name as run_id", "0L as seq", "0L as region_idx", "'tool_read' as channel", "text")
        plans.append([len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (found, XP.scan(regions, cards))])
        want = {("a", "f77"), ("b", "f99999")} if n > 1000 else {("a", "f77")}
        assert {tuple(r) for r in found.collect()} == want
        assert {(r["run_id"], r["fact_id"]) for r in XP.scan(regions, cards).collect()} == want
    assert all(abs(a - b) < 200 for a, b in zip(*plans))


def test_discovered_runs(spark, tmp_path):
    for path in ("a/runs/r1/stream.jsonl", "a/runs/r1/deep/judge.json", "a/runs/.hid/judge.json", "a/runs/r2/notes.txt", "b/r3/run_meta.json", "b/r3/probe_events.jsonl", "b/r4/sub/judge.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    got = {r["run_dir"].rsplit("/", 1)[-1]: (r["markers"], r["has_probe_channel"], r["root"]) for r in G.discovered_runs(spark, f"{tmp_path}/a/runs", f"{tmp_path}/b/", f"{tmp_path}/a/runs", f"{tmp_path}/lost").collect()}
    assert got == {"r1": (["stream.jsonl"], False, 0), "r3": (["run_meta.json"], True, 1)}
    assert G.discovered_runs(spark, f"{tmp_path}/lost").count() == 0


def test_run_report():
    from tallyforge.plans import render

    record = {"tokens": {"total_input": 12345, "dedupe_delta_input": -3}, "timing": {"wall_clock_seconds": 5}, "operations": {"tool_calls_total": 7, "probes_sent": 2, "probes_answered": 1}, "navigation": {"files_edited": ["a.py", "b.py"]}, "run": {"run_id": "r1"}}
    judge = {"verdict": "partial", "score": 0.5, "criteria": [{"met": True, "criterion": "a|b", "evidence": "x\ny"}, {"met": None, "error": "broke"}]}
    text = render.run_report(record, judge)
    assert text.startswith("# Run report: r1\n\n**Verdict:** PARTIAL, score 0.50, agent -\n") and "| met | a\\|b |  | x y |" in text and "| not evaluated |  |  | broke |" in text
    assert "1 of 2 criteria could not" in text and "input 12,345, output -" in text and "input drifts by -3" in text and "probes 1 of 2 answered, resumes -" in text and "files edited: a.py, b.py" in text
    assert "No criteria were graded." in render.run_report({}) and "wall clock - s" in render.run_report({})


def test_planted_effects(spark):
    """Estimators find what the generator planted: the lift of use, the read rates, and the hazard of lapses."""
    from tallyforge.operators import paired, rates, survival

    tables = DS.synthetic_tables(spark, tasks=60, reps=40, arms=("ctrl", "d1", "d2"), lift={"d1": 0.3}, tau=0.3)
    trace = tables["fact_trace"].cache()
    lift = {r["arm"]: r["mean_diff"] for r in paired.paired_difference(paired.task_pairs(trace, "used", "ctrl")).collect()}
    assert lift["d1"] == pytest.approx(0.3, abs=0.04) and lift["d2"] == pytest.approx(0, abs=0.03)
    read = {r["condition_id"]: r["rate"] for r in rates.rate_by_condition(trace, "read").collect()}
    assert read["ctrl"] == 0 and read["d1"] == pytest.approx(0.7, abs=0.03)
    table = survival.life_table(survival.retention_dataset(trace.withColumn("first_use_probe_index", F.lit(None).cast("long")))).where("duration between 1 and 4").collect()
    assert np.mean([r["events"] / r["at_risk"] for r in table]) == pytest.approx(0.25, abs=0.03)
    probes = tables["probes"].groupBy("run_id").agg(F.count_if("mentioned").alias("n"), F.count("*").alias("of"))
    odd = trace.join(probes, "run_id").where("n <> coalesce(lapse, horizon, 0) or of <> 10")
    assert odd.count() == 0 and DS.synthetic_tables(spark)["fact_trace"].count() == 240


def test_money_of_two_currencies(spark):
    from tallyforge.functions import money as M

    df = spark.createDataFrame([((100, "USD"), (30, "USD"))], "a struct<minor:bigint,currency:string>, b struct<minor:bigint,currency:string>")
    got = df.select(M.added(F.col("a"), F.col("b")).alias("s"), M.added(F.col("a"), F.col("b"), -1).alias("d")).first()
    assert (got["s"]["minor"], got["d"]["minor"], got["s"]["currency"]) == (130, 70, "USD")
    mixed = spark.createDataFrame([((1, "USD"), (1, "EUR"))], df.schema)
    with pytest.raises(Exception, match="currencies differ"):
        mixed.select(M.added(F.col("a"), F.col("b"))).collect()


def test_registry_problems(spark):
    fine = {"fact_id": "f1", "task_id": "t1", "statement": "Stamp {nonce} in front", "clauses": [{"label": "how", "text": "in front"}], "paraphrase_regexes": ["stamp zq-\\w+"], "detector": {"name": "content_present", "params": {"pattern": "ZQ"}}, "nonce": "ZQ-4KM7TXP2", "distractors": [{"statement": "or {token}", "token": "ZQ-AAAA2222"}], "control": {"statement": "x"}}
    assert G.registry_problems(spark, [fine]).count() == 0 and G.registry_problems(spark, []).count() == 0
    odd = {"fact_id": "f 2", "task_id": "t1", "statement": "none", "clauses": [{"label": "a", "text": ""}, {"label": "a", "text": "b"}], "paraphrase_regexes": ["(", "x*", "test"], "nonce": "QX-1", "distractors": [{"statement": " ", "token": "q"}]}
    got = {(r["fact_id"], r["severity"], r["problem"]) for r in G.registry_problems(spark, [fine, odd, {**fine, "task_id": "t3", "detector": {"name": "command_used", "params": {}}, "nonce": "ZQ-BBBB2222", "paraphrase_regexes": ["other words"]}]).collect()}
    errors = {p for f, s, p in got if f == "f 2" and s == "error"}
    assert errors == {"fact id", "several facts of one task", "no place for the token", "clause label twice", "empty clause", "pattern can't be read", "pattern matches nothing", "pattern matches plain text", "no detector", "token's form", "empty distractor", "distractor token's form", "distractor without a place for its token"}
    assert ("f1", "error", "fact id twice") in got and ("f1", "error", "several facts of one task") in got and ("f1", "warning", "detector: pattern: missing") in got and ("f1", "warning", "no pattern matches the statement") in got and ("f 2", "warning", "no control") in got
