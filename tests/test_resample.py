"""Resampling in parts and blocks, and clustered logistic models, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import mixed, resample


def test_picks_are_one_multinomial():
    """Parts of a draw add up to all picks, and every unit is drawn as often as any other."""
    n, size = 1030, 100
    parts = [resample.picks((1, "a", 0), n, p, 400, size) for p in range(11)]
    assert (np.sum(parts, axis=0) == n).all()
    assert np.mean(parts[0]) == pytest.approx(100, rel=0.02) and np.mean(parts[10]) == pytest.approx(30, rel=0.06)
    assert np.var(parts[3]) == pytest.approx(100 * (1 - 100 / n), rel=0.25)
    w = resample.weights((1, "a", 0), n, 3, 100, 400, size)
    assert (w.sum(axis=1) == parts[3]).all() and w.mean() == pytest.approx(1, rel=0.02)


SMALL = {"size": 40, "at_once": 64}


def test_mean_interval(spark):
    """Three quarters of all units in one stratum; the same whatever the partitioning, and near a plain bootstrap."""
    rng = np.random.default_rng(5)
    values = {("big" if k % 4 else "other", f"t{k}"): float(v) for k, v in enumerate(rng.gamma(2, 3, 400))}
    rows = [(a, t, v) for (a, t), v in values.items()] + [("other", "none", None), (None, "t1", 2.0), (None, "t2", 4.0)]
    df = spark.createDataFrame(rows, "arm string, task string, v double")
    got = [{r["arm"]: tuple(r)[1:] for r in resample.mean_interval(d, "task", F.col("v"), by=["arm"], draws=300, seed=3, **SMALL).collect()} for d in (df, df.repartition(9))]
    assert set(got[0]) == {"big", "other", None}
    for arm in got[0]:
        assert got[0][arm] == pytest.approx(got[1][arm], abs=1e-12)
    for arm in ("big", "other"):
        own = np.array([v for (a, _), v in values.items() if a == arm])
        means = own[rng.integers(0, len(own), (20_000, len(own)))].mean(axis=1)
        mean, low, high = got[0][arm]
        assert mean == pytest.approx(own.mean(), abs=1e-12)
        spread = own.std() / len(own) ** 0.5
        assert abs(low - np.quantile(means, 0.025)) < 0.5 * spread and abs(high - np.quantile(means, 0.975)) < 0.5 * spread
    assert got[0][None] == (3.0, 2.0, 4.0)


def test_any_statistic(spark):
    """A ratio of sums over rows that share their unit's weight, in cells of one stratum."""
    rows = [(f"t{k % 90}", "ab"[k % 2], float(k % 7), float(1 + k % 3)) for k in range(900)]
    df = spark.createDataFrame(rows, "task string, side string, x double, y double")
    drawn = resample.resampled(df, "task", ["x", "y"], cell=["side"], draws=100, seed=1, **SMALL)
    assert drawn.count() == 202
    wide = drawn.groupBy("draw").pivot("side", ["a", "b"]).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    got = resample.interval(wide, F.col("a_x") / F.col("a_y") - F.col("b_x") / F.col("b_y")).first()
    a, b = ([r for r in rows if r[1] == s] for s in "ab")
    want = sum(r[2] for r in a) / sum(r[3] for r in a) - sum(r[2] for r in b) / sum(r[3] for r in b)
    assert got["statistic"] == pytest.approx(want) and got["low"] < got["statistic"] < got["high"]


def test_exchange(spark):
    rng = np.random.default_rng(2)
    rows = [("arm", f"t{k}", 8, int(rng.binomial(8, 0.5)), 8, int(rng.binomial(8, 0.45))) for k in range(150)]
    df = spark.createDataFrame(rows, "arm string, task_id string, n1 long, k1 long, n0 long, k0 long")
    drawn = {r["draw"]: r for r in resample.exchanged(df, draws=500, seed=4, **SMALL).collect()}
    seen = sum(k1 / 8 - k0 / 8 for _, _, _, k1, _, k0 in rows)
    assert len(drawn) == 501 and drawn[0]["total"] == pytest.approx(seen) and drawn[7]["n"] == 150
    null = np.array([drawn[k]["total"] for k in range(1, 501)])
    x = rng.hypergeometric([r[3] + r[5] for r in rows], [16 - r[3] - r[5] for r in rows], 8, (4000, 150))
    plain = (x / 8 - (np.array([r[3] + r[5] for r in rows]) - x) / 8).sum(axis=1)
    assert abs(null.mean()) < 0.3 and null.std() == pytest.approx(plain.std(), rel=0.12)


def bound(table, mean, var, m, s2, mu, t2):
    """What the variational fit maximises, term by term."""
    nodes, weights = np.polynomial.hermite_e.hermegauss(40)
    weights = weights / weights.sum()
    g, x, n, k = table
    eta, sd = mean[0] + mean[1] * x + m[g], np.sqrt(var[0] + x * x * var[1] + s2[g])
    soft = np.logaddexp(0, eta[:, None] + sd[:, None] * nodes) @ weights
    out = (k * eta - n * soft).sum() - (mean @ mean + var.sum()) / (2 * mixed.COEFFICIENT_SD**2) + np.log(var).sum() / 2
    out += -len(m) * mu - (m @ m + s2.sum()) / 2 * np.exp(-2 * mu + 2 * t2) + np.log(s2).sum() / 2
    return out - (mu**2 + t2) / (2 * mixed.LOG_SD_SD**2) + np.log(t2) / 2


def test_random_intercepts(spark):
    """The fit is a maximum: no coefficient, deviation or intercept can be moved to a better one."""
    rng = np.random.default_rng(9)
    rows = []
    for c in range(30):
        own = rng.normal(0, 0.9)
        rows += [(f"t{c}", float(x), bool(rng.random() < 1 / (1 + np.exp(-(own - 1 + 0.8 * x))))) for x in rng.integers(1, 4, 25)]
    df = spark.createDataFrame([*rows, ("t0", None, True), ("t1", 1.0, None)], "task_id string, x double, y boolean")
    got = mixed.random_intercepts(df, "y", "x")
    assert got["n_obs"] == 750 and got["n_groups"] == 30 and got["error"] is None and 0.5 < got["coef"] < 1.2 and got["p_value"] < 0.01
    names = sorted({r[0] for r in rows})
    g = np.array([names.index(r[0]) for r in rows])
    table = g, np.array([r[1] for r in rows]), np.ones(len(rows)), np.array([float(r[2]) for r in rows])
    # from the fit's coefficients, the intercepts' own best answer by plain fixed-point rounds
    mean, mu = np.array([got["intercept"], got["coef"]]), got["log_sd"]
    m, s2, t2, var = np.zeros(30), np.full(30, 0.1), 0.02, np.array([0.02, got["se"] ** 2])
    nodes, weights = np.polynomial.hermite_e.hermegauss(40)
    weights = weights / weights.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-((mean[0] + mean[1] * table[1] + m[g])[:, None] + np.sqrt(var[0] + table[1] ** 2 * var[1] + s2[g])[:, None] * nodes)))
        e, v = p @ weights, (p * (1 - p)) @ weights
        precision = np.exp(-2 * mu + 2 * t2)
        h = np.bincount(g, v) + precision
        m, s2 = m + (np.bincount(g, table[3] - e) - precision * m) / h, 1 / h
        var = 1 / (np.array([v.sum(), (v * table[1] ** 2).sum()]) + 1 / mixed.COEFFICIENT_SD**2)
        t2 = 1 / (2 * (m @ m + s2.sum()) * precision + 1 / mixed.LOG_SD_SD**2)
    best = bound(table, mean, var, m, s2, mu, t2)
    assert got["se"] == pytest.approx(np.sqrt(var[1]), rel=1e-3)
    for step in (1e-2, -1e-2):
        assert bound(table, mean + [step, 0], var, m, s2, mu, t2) < best and bound(table, mean + [0, step], var, m, s2, mu, t2) < best
        assert bound(table, mean, var, m, s2, mu + step, t2) < best and bound(table, mean, var * [1, 1 + step], m, s2, mu, t2) < best
    assert mixed.random_intercepts(df.where("y"), "y", "x")["error"] == "degenerate"


def test_models_of_one_large_cluster(spark):
    """A third of all rows in one cluster; a continuous number has as many cells as rows."""
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 3 == 0 else f"t{k % 40}", float(x), bool(rng.random() < 1 / (1 + np.exp(-x)))) for k, x in enumerate(rng.normal(size=3000))]
    got = {r["method"]: r for r in mixed.models(spark.createDataFrame(rows, "task_id string, x double, y boolean"), "y", "x").collect()}
    assert len(got) == 2 and all(abs(r["coef"] - 1) < 0.2 and r["n_obs"] == 3000 and r["error"] is None for r in got.values())
