"""Distribution tails against tables, and properties of the statistics on planted data."""

import math

import numpy as np
import pytest

from tallyforge.operators import mixed
from tallyforge.functions import dist
from tallyforge.operators import design as D
from tallyforge.operators import paired as P
from tallyforge.operators import rates as R
from tallyforge.operators import survival as S


@pytest.mark.parametrize("p, dof, want", [(0.975, 1, 12.7062), (0.975, 5, 2.5706), (0.975, 11, 2.2010), (0.95, 30, 1.6973), (0.995, 120, 2.6174)])
def test_t_table(p, dof, want):
    assert dist.t_quantile(p, dof) == pytest.approx(want, abs=1e-4)
    assert dist.t_sf(dist.t_quantile(p, dof), dof) == pytest.approx(1 - p, abs=1e-10)
    assert dist.t_quantile(1 - p, dof) == pytest.approx(-dist.t_quantile(p, dof))


@pytest.mark.parametrize("x, dof, want", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (9.487729, 4, 0.05), (0.0, 3, 1.0), (25.188180, 10, 0.005)])
def test_chi2_table(x, dof, want):
    assert dist.chi2_sf(x, dof) == pytest.approx(want, abs=1e-6)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 12), (12, 12), (3, 10), (0, 0)], "k long, n long")
    from pyspark.sql import functions as F

    low, high = dist.wilson(F.col("k"), F.col("n"))
    got = df.select(low.alias("low"), high.alias("high"), dist.wilson_upper(F.col("k"), F.col("n")).alias("up")).collect()
    assert got[0]["high"] == pytest.approx(0.2425, abs=1e-3) and got[0]["low"] == 0
    assert got[1]["high"] == 1 and got[2]["low"] == pytest.approx(0.1078, abs=1e-3)
    assert got[3]["low"] is None and got[3]["up"] == 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "task_id string, condition_id string, used boolean")


def test_degenerate_pairs(spark):
    one = frame(spark, [("a", "ctrl", False), ("a", "d1", True)])
    got = P.with_interval(P.paired_difference(P.task_pairs(one, "used", "ctrl"))).first()
    assert got["mean_diff"] is None and got["p_value"] is None and "fewer" in got["note"]
    flat = frame(spark, [(t, a, a == "d1") for t in "abc" for a in ("ctrl", "d1")])
    got = P.with_interval(P.paired_difference(P.task_pairs(flat, "used", "ctrl"))).first()
    assert got["mean_diff"] == 1 and got["ci_low"] == got["ci_high"] == 1 and got["p_value"] is None and got["note"] == "zero variance"
    assert P.heterogeneity(P.task_pairs(one, "used", "ctrl")).first()["gamma_hat"] is None


def test_known_lift(spark):
    df = D.synthetic_runs(spark, tasks=40, reps=20, lift={"d1": 0.2}, seed=3)
    got = {r["arm"]: r for r in P.use_lift(df).collect()}
    assert got["d1"]["ci_low"] < 0.2 < got["d1"]["ci_high"] and got["d1"]["p_value"] < 1e-6
    assert abs(got["d2"]["mean_diff"]) < 0.08 and got["d2"]["boot_low"] < got["d2"]["mean_diff"] < got["d2"]["boot_high"]
    perm = {r["arm"]: r["p_value"] for r in P.permutation_within_task(P.task_pairs(df, "used", "ctrl")).collect()}
    assert perm["d1"] < 0.002
    fit = mixed.cluster_logistic(df.selectExpr("task_id", "used", "cast(condition_id = 'd1' as double) as x"), "used", "x")
    assert fit["slope"] > 1 and fit["z"] > 4
    assert mixed.cluster_logistic(df.selectExpr("task_id", "used", "1.0 as x"), "used", "x") == {"error": "degenerate"}


def test_unknown_is_not_false(spark):
    df = frame(spark, [("a", "x", True), ("b", "x", None), ("c", "x", False), ("d", "x", None)])
    r = R.rate_by_condition(df, "used").first()
    assert (r["n"], r["k"], r["n_unknown"], r["rate"], r["rate_lower"], r["rate_upper"]) == (2, 1, 2, 0.5, 0.25, 0.75)


def test_censoring(spark):
    rows = [("1", "t", "a", True, 3, 9, None, 0, None), ("2", "t", "a", True, None, 7, None, 0, None), ("3", "t", "a", True, None, 4, "truncated_run", 0, None), ("4", "t", "a", True, 5, 9, None, 1, 3), ("5", "t", "a", False, None, 9, None, None, None), ("6", "t", "a", True, None, None, None, 0, None), ("7", "t", "a", True, 2, 9, None, 4, 3)]
    df = spark.createDataFrame(rows, "run_id string, task_id string, condition_id string, ever_mention boolean, lapse int, horizon int, censor_reason string, first_mention_probe_index int, first_use_probe_index int")
    got = {r["run_id"]: (r["duration"], r["event"], r["censor_reason"]) for r in S.retention_dataset(df).collect()}
    assert got == {"1": (3, 1, None), "2": (7, 0, "administrative"), "3": (4, 0, "truncated_run"), "4": (2, 0, "post_discharge")}


def plain_rmst(d, e, weight, j):
    """Area under the survival curve up to ``j``, time by time."""
    area, s, before = 0.0, 1.0, 0.0
    for t in np.unique(d[(e == 1) & (weight > 0)]):
        if t > j:
            break
        area += s * (t - before)
        s *= 1 - weight[(d == t) & (e == 1)].sum() / weight[d >= t].sum()
        before = float(t)
    return area + s * (j - before)


def test_rmst_truth(spark):
    rng = np.random.default_rng(1)
    lapse = rng.geometric(0.25, 20000)
    rows = [(f"r{k}", f"t{k % 9}", "a", int(min(x, 6)), int(x <= 6)) for k, x in enumerate(lapse)]
    data = spark.createDataFrame(rows, "run_id string, task_id string, condition_id string, duration long, event int")
    from pyspark.sql import functions as F

    horizon = data.groupBy("condition_id").agg(F.count("*").alias("n")).withColumn("j_arm", F.lit(5)).withColumn("j", F.lit(5))
    got = S.rmst(data, horizon).first()["rmst"]
    assert got == pytest.approx(sum(0.75**u for u in range(5)), abs=0.03)
    contrast = S.rmst_contrast(data, reference="a", draws=20).first()
    j = S.common_horizon(data).first()["j"]
    d, e = data.toPandas()[["duration", "event"]].to_numpy().T
    assert contrast["rmst"] == pytest.approx(plain_rmst(d.astype(float), e, np.ones(len(d)), j), abs=1e-9) and contrast["delta_rmst"] == contrast["delta_low"] == 0


def test_horizon_and_reference(spark):
    rows = [(str(k), "t", a, v, 1) for a, v in (("d2", 8), ("z", 2)) for k in range(3)]
    data = spark.createDataFrame(rows, "run_id string, task_id string, condition_id string, duration long, event int")
    assert {r["j"] for r in S.common_horizon(data).collect()} == {2}
    assert S.reference_arm(data).first()["reference"] == "d2"
    assert S.common_horizon(data.where("false")).count() == 0


def test_power_numbers(spark):
    """Published operating figures, within their simulation error."""
    got = D.power(spark, [0.0], p0=0.2, tau=0.5, gamma=0.0, sims=4000).first()
    assert got["paired_t"] == pytest.approx(0.0517, abs=0.012) and got["cmh"] == pytest.approx(0.0510, abs=0.012) and got["cmh_corrected"] == pytest.approx(0.0270, abs=0.012)
    assert D.power(spark, [0.2566], p0=0.2, sims=4000).first()["paired_t"] == pytest.approx(0.8, abs=0.04)
    assert D.minimum_detectable(spark, p0=0.2, sims=1000) == pytest.approx(0.2566, abs=0.04)
    assert D.power(spark, [0.0], p0=0.2, sims=200, permutations=200).first()["permutation"] < 0.15


def test_design():
    assert D.cadence("t", 1, 30) == D.cadence("t", 1, 30) and D.cadence("t", 1, 30)[-1] >= 30 and len(D.cadence("t", 1, 1000)) == 24
    assert D.seed_int("x") == int.from_bytes(__import__("hashlib").sha256(b"x").digest()[:8], "big")
    assert math.isclose(D.marginal_rate(D.base_logit(0.2, 0.5), 0.5), 0.2, abs_tol=1e-9)


def test_gates_without_input(spark):
    from tallyforge.operators import gates as G

    trace = spark.createDataFrame([], "condition_id string, task_id string, analyzable boolean, quarantined boolean, prior_check_status string, read boolean, echoed boolean, ever_mention boolean, unexplained_possession boolean, used boolean, success boolean, available boolean, factor_present boolean")
    probes = spark.createDataFrame([], "parse_ok boolean, outcome string")
    runs = spark.createDataFrame([], "max_tool_uses int, dedupe_delta_input long, dedupe_delta_output long, accounting_version string, ambient_memory array<string>, join_coverage double")
    g = G.triage(trace, probes, runs)
    assert {r["status"] for r in g.collect()} == {"unevaluable"}
    assert not G.blocked(g).first()["blocked"] and G.blocked(g, require_all=True).first()["blocked"]


def test_gates_of_a_task_that_never_varies(spark, tmp_path):
    """Such a task is left out by default; the queries agree with their SQL, where its correlation is NaN."""
    import duckdb

    from tallyforge import registry
    from tallyforge.operators import gates as G
    from tests.compare import rows

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    # each user's use and success vary, but for the last one's
    con.execute("create table events as select u * 40 + e as event_id, timestamp '2024-01-01' + to_seconds(e) as ts, u as user_id, 'click' as event_type, 40.0::double as value, '{\"k\": ' || CASE WHEN u = 3 THEN 14 ELSE 14 + e % 20 END || '}' as props from (select range as u from range(4)) a, (select range as e from range(40)) b")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    for name in ("gates", "gates_blocked"):
        got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
        want = con.execute(registry.ORACLE_SQL[name]).fetch_df()
        assert rows(got) == rows(want)
    trace = spark.createDataFrame([("a", u, v) for u in (True, False) for v in (True, False)] + [("b", True, True), ("c", None, True)], "task_id string, used boolean, success boolean")
    trace = trace.selectExpr("*", "'d1' AS condition_id", "true AS analyzable", "false AS quarantined", "'ok' AS prior_check_status", "true AS read")
    g11 = lambda **k: next(tuple(r)[2:5] for r in G.evaluated(G.by_task(trace, **k), G.task_gates()).collect() if r["id"] == "G11")
    assert g11() == (0.0, 1, "pass")
    value, n, status = g11(strict=True)
    assert math.isnan(value) and (n, status) == (2, "fail")


@pytest.mark.parametrize("odd", ["where false", "where user_id is null", "where user_id is null or k % 2 = 0"])
def test_gates_of_no_rows_and_of_rows_without_a_user(spark, tmp_path, odd):
    """The queries agree with their SQL: counts of nothing are 0 there, and null users are one task."""
    import duckdb

    from tallyforge import registry
    from tests.compare import rows

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    events = "select u * 40 + e as event_id, timestamp '2024-01-01' + to_seconds(e) as ts, nullif(u, 3) as user_id, CASE WHEN e % 2 = 0 THEN 'click' ELSE 'signup' END as event_type, 40.0::double + e as value, 14 + e % 20 as k from (select range as u from range(4)) a, (select range as e from range(40)) b"
    con.execute(f"create table events as select * exclude k, '{{\"k\": ' || k || '}}' as props from ({events}) {odd}")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    for name in ("gates", "gates_blocked"):
        assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).fetch_df())
