"""Logistic models of a flag on one number, with rows clustered: robust errors, estimating equations, random intercepts.

Nothing but a few sums a round reaches the driver. Rows are counted by (cluster, number) once, in a written table;
a round computes each row's share with the present coefficients, adds shares up by cluster and
those over all clusters, so neither the cells, a cluster's rows nor the clusters are one task's work.
The variational fit also keeps a row a cluster (mean and variance of its intercept) in a
written table a round.

Of degenerate data (no spread in the number or the flag, fewer than two clusters) the result says so in ``error``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.shared import dropped, fixed

#: Prior deviations of coefficients and of the log of the intercepts' deviation.
COEFFICIENT_SD, LOG_SD_SD = 2.0, 1.0
_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(20)
_WEIGHTS = _WEIGHTS / _WEIGHTS.sum()
_MOST_ROUNDS = 100


def cells(rows: DataFrame, outcome: str, x: str, cluster: str) -> DataFrame:
    """(cluster, x, n, k): rows with both values known, counted; a written table."""
    known = rows.where(F.col(outcome).isNotNull() & F.col(x).isNotNull())
    return fixed(known.groupBy(F.col(cluster).alias("cluster"), F.col(x).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(outcome)).cast("double").alias("k")), "cells")


def _shape(table: DataFrame) -> dict | None:
    """Rows, successes and clusters; None if nothing can be fitted."""
    got = table.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("x").alias("low"), F.max("x").alias("high"), F.countDistinct("cluster").alias("groups")).first()
    if not got["n"] or got["n"] < 4 or not 0 < got["k"] < got["n"] or got["low"] == got["high"] or got["groups"] < 2:
        return None
    return {"n_obs": int(got["n"]), "n_groups": got["groups"]}


def _p(beta: np.ndarray) -> Column:
    eta = F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x")
    return F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), 1 / (1 + F.exp(-eta))))


def _sums(table: DataFrame, **columns: Column) -> dict:
    return table.agg(*(F.sum(c).alias(n) for n, c in columns.items())).first().asDict()


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def cluster_logistic(rows: DataFrame, outcome: str, x: str, cluster: str = "task_id", *, rounds: int = 25) -> dict:
    """Logistic regression with errors robust to clusters."""
    table = cells(rows, outcome, x, cluster)
    shape = _shape(table)
    if shape is None:
        return {"error": "degenerate"}
    beta, X = np.zeros(2), F.col("x")
    for _ in range(rounds):
        p = _p(beta)
        v, r = F.col("n") * p * (1 - p), F.col("k") - F.col("n") * p
        s = _sums(table, a=v, b=v * X, c=v * X * X, g=r, h=r * X)
        info = np.array([[s["a"], s["b"]], [s["b"], s["c"]]])
        step = np.linalg.solve(info, [s["g"], s["h"]])
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    r = F.col("k") - F.col("n") * _p(beta)
    score = table.groupBy("cluster").agg(F.sum(r).alias("g"), F.sum(r * X).alias("h"))
    m = _sums(score, a=F.col("g") ** 2, b=F.col("g") * F.col("h"), c=F.col("h") ** 2)
    bread = np.linalg.inv(info)
    se = np.sqrt(np.diag(bread @ np.array([[m["a"], m["b"]], [m["b"], m["c"]]]) @ bread))
    dropped(table)
    return {"intercept": float(beta[0]), "slope": float(beta[1]), "slope_se": float(se[1]), "z": float(beta[1] / se[1]), "clusters": shape["n_groups"]}


def exchangeable_logistic(rows: DataFrame, outcome: str, x: str, cluster: str = "task_id", *, rounds: int = 60) -> dict:
    """Slope by estimating equations with one correlation inside every cluster, and its robust error.

    A cell's rows have one residual for success and one for failure, so sums over cells are sums over rows.
    """
    table, out = cells(rows, outcome, x, cluster), {"method": "GEE logistic, exchangeable"}
    shape = _shape(table)
    if shape is None:
        return out | {"error": "degenerate"}
    n, k, X = F.col("n"), F.col("k"), F.col("x")
    size = table.groupBy("cluster").agg(F.sum("n").alias("size"))
    sizes = size.agg(F.max("size").alias("most"), F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("pairs")).first()
    beta = np.zeros(2)
    for _ in range(rounds):
        p = _p(beta)
        sd = F.sqrt(p * (1 - p))
        r, squares = (k - n * p) / sd, k * (1 - p) / p + (n - k) * p / (1 - p)
        by = table.groupBy("cluster").agg(*(F.sum(c).alias(name) for name, c in {"size": n, "r": r, "squares": squares, "d0": n * sd, "d1": n * sd * X, "i00": n * sd * sd, "i01": n * sd * sd * X, "i11": n * sd * sd * X * X, "s0": sd * r, "s1": sd * X * r}.items()))
        c = F.col
        both = _sums(by, squares=c("squares"), cross=(c("r") ** 2 - c("squares")) / 2)
        phi = both["squares"] / (shape["n_obs"] - 2)
        alpha = float(np.clip(both["cross"] / (phi * max(sizes["pairs"] - 2, 1)), -0.99 / max(sizes["most"] - 1, 1), 0.99))
        shrink = F.lit(alpha) / (1 + (c("size") - 1) * alpha)
        g0, g1 = (c("s0") - c("d0") * shrink * c("r")) / (1 - alpha), (c("s1") - c("d1") * shrink * c("r")) / (1 - alpha)
        s = _sums(by, a=c("i00") - shrink * c("d0") ** 2, b=c("i01") - shrink * c("d0") * c("d1"), c=c("i11") - shrink * c("d1") ** 2, g0=g0, g1=g1, m00=g0 * g0, m01=g0 * g1, m11=g1 * g1)
        info = np.array([[s["a"], s["b"]], [s["b"], s["c"]]]) / (1 - alpha)
        step = np.linalg.solve(info, [s["g0"], s["g1"]])
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    bread = np.linalg.inv(info)
    se = float(np.sqrt((bread @ np.array([[s["m00"], s["m01"]], [s["m01"], s["m11"]]]) @ bread)[1, 1]))
    dropped(table)
    return out | shape | {"coef": float(beta[1]), "se": se, "alpha": alpha, "p_value": _two_sided(beta[1] / se) if se > 0 else None, "error": None}


def _expected(batches: Iterator[pa.RecordBatch], mean: np.ndarray, var: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For rows (cluster, x, n, k, m, s2): the row's residual and variance, expected under the coefficients' and the intercept's normals."""
    for batch in batches:
        x, n, k, m, s2 = (batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(1, 6))
        sd = np.sqrt(var[0] + x * x * var[1] + s2)
        p = 1 / (1 + np.exp(-((mean[0] + mean[1] * x + m)[:, None] + sd[:, None] * _NODES)))
        e, v = p @ _WEIGHTS, (p * (1 - p)) @ _WEIGHTS
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k - n * e), pa.array((k - n * e) * x), pa.array(n * v), pa.array(n * v * x), pa.array(n * v * x * x)], names=["cluster", "r", "rx", "v", "vx", "vxx"])


def _log_sd(total: float, groups: int, mu: float, s2: float) -> tuple[float, float]:
    """Mean and variance of the normal for the log of the intercepts' deviation that fits best, given their squares' sum."""
    for _ in range(200):
        for _ in range(50):
            e = total * math.exp(min(-2 * mu + 2 * s2, 50.0))
            step = (-groups + e - mu / LOG_SD_SD**2) / (2 * e + 1 / LOG_SD_SD**2)
            mu += max(-1.0, min(1.0, step))
            if abs(step) < 1e-12:
                break
        now = 1 / (2 * total * math.exp(min(-2 * mu + 2 * s2, 50.0)) + 1 / LOG_SD_SD**2)
        if abs(now - s2) < 1e-13:
            break
        s2 = now
    return mu, s2


def random_intercepts(rows: DataFrame, outcome: str, x: str, cluster: str = "task_id", *, rounds: int = _MOST_ROUNDS, tolerance: float = 1e-5) -> dict:
    """Variational fit of a logistic model with a normal intercept for every cluster.

    Coefficients, intercepts and the log of the intercepts' deviation have independent normals. A round is a
    joint Newton step of all means, the intercepts' eliminated cluster by cluster, and a fixed-point step of the variances.
    """
    table, out = cells(rows, outcome, x, cluster), {"method": "variational logistic, random intercepts"}
    shape = _shape(table)
    if shape is None:
        return out | {"error": "degenerate"}
    kind = table.schema["cluster"].dataType.simpleString()
    schema = f"cluster {kind}, r double, rx double, v double, vx double, vxx double"
    mean, var, mu, s2 = np.zeros(2), np.full(2, 0.01), 0.0, 0.1
    state = fixed(table.select("cluster").distinct().withColumns({"m": F.lit(0.0), "s2": F.lit(0.1)}), "intercepts")
    for _ in range(rounds):
        precision = math.exp(-2 * mu + 2 * s2)
        placed = state.withColumnRenamed("cluster", "_cluster")
        joined = table.join(placed, F.col("cluster").eqNullSafe(F.col("_cluster"))).select("cluster", "x", "n", "k", "m", "s2")
        parts = joined.mapInArrow(lambda b, mean=mean, var=var: _expected(b, mean, var), schema)
        by = parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ("r", "rx", "v", "vx", "vxx")))
        by = fixed(by.join(placed, F.col("cluster").eqNullSafe(F.col("_cluster"))).drop("_cluster"), "clusters")
        c, h = F.col, F.col("v") + precision
        g = F.col("r") - precision * F.col("m")
        s = _sums(by, a=c("v") - c("v") ** 2 / h, b=c("vx") - c("v") * c("vx") / h, c=c("vxx") - c("vx") ** 2 / h, g0=c("r") - c("v") * g / h, g1=c("rx") - c("vx") * g / h, v=c("v"), vxx=c("vxx"))
        prior = 1 / COEFFICIENT_SD**2
        step = np.linalg.solve(np.array([[s["a"] + prior, s["b"]], [s["b"], s["c"] + prior]]), np.array([s["g0"], s["g1"]]) - prior * mean)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-30))
        mean, var_now = mean + step, 1 / (np.array([s["v"], s["vxx"]]) + prior)
        moved = (g - c("v") * float(step[0]) - c("vx") * float(step[1])) / h
        m = c("m") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), moved))
        now = fixed(by.select("cluster", m.alias("m"), (1 / h).alias("s2"), F.abs(m - c("m")).alias("d")), "intercepts")
        dropped(state, by)
        got = now.agg(F.sum(c("m") ** 2 + c("s2")).alias("q"), F.max("d").alias("d")).first()
        mu_now, s2_now = _log_sd(got["q"], shape["n_groups"], mu, s2)
        change = max(np.abs(step).max(), np.abs(var_now - var).max(), abs(mu_now - mu), abs(s2_now - s2), got["d"])
        state, var, mu, s2 = now.drop("d"), var_now, mu_now, s2_now
        if change < tolerance:
            break
    dropped(state, table)
    se = float(np.sqrt(var[1]))
    return out | shape | {"coef": float(mean[1]), "se": se, "intercept": float(mean[0]), "log_sd": mu, "p_value": _two_sided(mean[1] / se), "error": None}


def models(rows: DataFrame, outcome: str, x: str, cluster: str = "task_id") -> DataFrame:
    """(method, n_obs, n_groups, coef, se, p_value, error) of the estimating equations and the random intercepts."""
    said = [exchangeable_logistic(rows, outcome, x, cluster), random_intercepts(rows, outcome, x, cluster)]
    names = ("method", "n_obs", "n_groups", "coef", "se", "p_value", "error")
    return rows.sparkSession.createDataFrame([tuple(s.get(k) for k in names) for s in said], "method string, n_obs long, n_groups long, coef double, se double, p_value double, error string")
