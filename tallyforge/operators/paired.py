"""Comparisons of arms over shared tasks: paired differences, heterogeneity, stratified tests.

Sums over tasks are plain aggregates; tails of distributions run in Python on one row a
comparison, and resampling is dealt by tasks and draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dist import chi2_upper, t_critical, t_two_sided
from tallyforge.operators.rates import GROUP, per_task_rates
from tallyforge.operators.resample import exchanged, mean_interval

SEED = 20260805
DRAWS = 2000
CONTROL = "ctrl"


def task_pairs(df: DataFrame, outcome: str, control: str, *, arms: list[str] | None = None, denominator: str | None = None) -> DataFrame:
    """(arm, task_id, n1, k1, n0, k0) for every arm but the control, over tasks that both have known rows for."""
    rates = per_task_rates(df, outcome, denominator=denominator).where("n > 0 and task_id is not null")
    left = rates.where(F.col(GROUP) != control).select(F.col(GROUP).alias("arm"), "task_id", F.col("n").alias("n1"), F.col("k").alias("k1"))
    if arms is not None:
        left = left.where(F.col("arm").isin(arms))
    right = rates.where(F.col(GROUP) == control).select("task_id", F.col("n").alias("n0"), F.col("k").alias("k0"))
    return left.join(right, "task_id")


def paired_difference(pairs: DataFrame) -> DataFrame:
    """Tasks, mean difference of rates, its deviation, standard error and t, by arm."""
    d = F.col("k1") / F.col("n1") - F.col("k0") / F.col("n0")
    out = pairs.groupBy("arm").agg(F.count("*").alias("n_tasks"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return _with_t(out)


def _with_t(out: DataFrame) -> DataFrame:
    sd = F.when(F.col("n_tasks") >= 2, F.when(F.col("sd") < 1e-15, 0.0).otherwise(F.col("sd")))
    out = out.withColumn("sd", sd).withColumn("se", F.col("sd") / F.sqrt("n_tasks")).withColumn("mean_diff", F.when(F.col("n_tasks") >= 2, F.col("mean_diff")))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se"))).withColumn("dof", F.when(F.col("n_tasks") >= 2, F.col("n_tasks") - 1))


def with_interval(out: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-sided p and confidence interval; without variance p is null and the interval is the mean."""
    half = F.coalesce(t_critical(F.lit(1 - alpha / 2), F.col("dof")) * F.col("se"), F.lit(0.0))
    out = out.withColumn("p_value", t_two_sided("t", "dof")).withColumn("ci_low", F.col("mean_diff") - half).withColumn("ci_high", F.col("mean_diff") + half)
    return out.withColumn("note", F.when(F.col("n_tasks") < 2, "fewer than two shared tasks").when(F.col("se") == 0, "zero variance"))


def heterogeneity(pairs: DataFrame) -> DataFrame:
    """DerSimonian-Laird spread of per-task log odds ratios with half a count in each cell."""
    a, b, c, d = F.col("k1") + 0.5, F.col("n1") - F.col("k1") + 0.5, F.col("k0") + 0.5, F.col("n0") - F.col("k0") + 0.5
    rows = pairs.select("arm", F.ln(a * d / (b * c)).alias("y"), (1 / (1 / a + 1 / b + 1 / c + 1 / d)).alias("w"))
    out = rows.groupBy("arm").agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swyy"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    q = F.greatest(F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"), F.lit(0.0))
    out = out.withColumn("q", q)
    over = F.greatest(F.lit(0.0), F.col("q") - (F.col("k") - 1))
    enough = F.col("k") >= 2
    return out.select("arm", F.col("k").alias("n_tasks"), F.when(enough, F.sqrt(F.try_divide(over, F.col("sw") - F.col("sww") / F.col("sw")))).alias("gamma_hat"), F.when(enough, F.col("q")).alias("q"), F.when(enough, F.coalesce(F.try_divide(over, F.col("q")), F.lit(0.0))).alias("i2"))


def cmh(pairs: DataFrame, *, correct: bool = True) -> DataFrame:
    """Cochran-Mantel-Haenszel chi-square (continuity 0.5) and pooled odds ratio, by arm."""
    a, b, c, d = (F.col(x).cast("double") for x in ("a", "b", "c", "d"))
    s = pairs.select("arm", F.col("k1").alias("a"), (F.col("n1") - F.col("k1")).alias("b"), F.col("k0").alias("c"), (F.col("n0") - F.col("k0")).alias("d"), (F.col("n1") + F.col("n0")).cast("double").alias("n")).where("n >= 2")
    n = F.col("n")
    out = s.groupBy("arm").agg(F.count("*").alias("n_strata"), F.sum(a - (a + b) * (a + c) / n).alias("num"), F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("den"), F.sum(a * d / n).alias("ad"), F.sum(b * c / n).alias("bc"))
    away = F.abs("num") - (0.5 if correct else 0.0)
    chi = F.when(F.col("den") > 0, F.when(away > 0, away * away / F.col("den")).otherwise(0.0))
    return out.select("arm", "n_strata", chi.alias("chi2"), F.try_divide("ad", F.nullif(F.col("bc"), F.lit(0.0))).alias("odds_ratio"))


def cmh_test(pairs: DataFrame, *, suppress_above: float = 0.5, correct: bool = True) -> DataFrame:
    """CMH with its p-value, which is withheld where the tasks differ too much among themselves."""
    out = cmh(pairs, correct=correct).join(heterogeneity(pairs).select("arm", "gamma_hat"), "arm", "left")
    held = F.coalesce(F.col("gamma_hat") > suppress_above, F.lit(False))
    return out.withColumn("suppressed", held).withColumn("p_value", F.when(~held, chi2_upper(F.col("chi2"), F.lit(1.0))))


def bootstrap_mean(pairs: DataFrame, *, draws: int = DRAWS, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean difference over resampled tasks, by arm."""
    got = mean_interval(pairs, "task_id", F.col("k1") / F.col("n1") - F.col("k0") / F.col("n0"), by=["arm"], draws=draws, seed=seed, alpha=alpha)
    return got.select("arm", F.col("low").alias("boot_low"), F.col("high").alias("boot_high"))


def permutation_within_task(pairs: DataFrame, *, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Two-sided p of the mean difference under exchange of labels within tasks, by arm."""
    drawn = exchanged(pairs, draws=draws, seed=seed).withColumn("d", F.abs(F.col("total") / F.col("n")))
    seen = drawn.where("draw = 0").select(F.col("arm").alias("_arm"), F.col("d").alias("seen"))
    hits = F.count_if((F.col("draw") > 0) & (F.col("d") >= F.col("seen") - 1e-12))
    return drawn.join(seen, F.col("arm") == F.col("_arm")).groupBy("arm").agg(((1 + hits) / (1 + draws)).alias("p_value"))


def use_lift(df: DataFrame, *, outcome: str = "used", control: str = CONTROL, arms: list[str] | None = None, denominator: str | None = None) -> DataFrame:
    """Every arm's lift over the paired control, with interval, bootstrap and heterogeneity."""
    pairs = task_pairs(df, outcome, control, arms=arms, denominator=denominator)
    return with_interval(paired_difference(pairs)).join(bootstrap_mean(pairs), "arm", "left").join(heterogeneity(pairs).select("arm", "gamma_hat", "i2"), "arm", "left")


DEPTH = {"d1": 1, "d2": 2, "d3": 3}


def depth_slopes(df: DataFrame, *, outcome: str = "read", depth: dict[str, int] | None = None) -> DataFrame:
    """Slope of a task's rate on depth, tested over tasks that have two depths or more."""
    depth = depth or DEPTH
    level = F.lit(None).cast("double")
    for arm, x in depth.items():
        level = F.when(F.col(GROUP) == arm, F.lit(float(x))).otherwise(level)
    rates = per_task_rates(df.where(F.col(GROUP).isin(list(depth))), outcome).where("n > 0").withColumn("x", level)
    slopes = rates.groupBy("task_id").agg(F.regr_slope("rate", "x").alias("d"), F.countDistinct("x").alias("levels")).where("levels >= 2 and task_id is not null")
    return _with_t(slopes.agg(F.count("d").alias("n_tasks"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")))


def contrasts(df: DataFrame, pairs: list[tuple[str, str]], outcomes: list[str]) -> DataFrame:
    """Paired differences of listed (arm, reference) pairs for listed outcomes."""
    out = None
    for arm, ref in pairs:
        for outcome in outcomes:
            one = paired_difference(task_pairs(df, outcome, ref, arms=[arm])).select(F.lit(arm).alias("arm"), F.lit(ref).alias("reference"), F.lit(outcome).alias("outcome"), "n_tasks", "mean_diff", "se", "t", "dof")
            out = one if out is None else out.unionByName(one)
    return out


def friedman(df: DataFrame, arms: list[str], *, outcome: str = "used") -> DataFrame:
    """Friedman statistic over tasks that have every arm: ranks with ties, corrected for them."""
    from pyspark.sql import Window

    k = len(arms)
    rates = per_task_rates(df.where(F.col(GROUP).isin(arms)), outcome).where("n > 0 and task_id is not null").withColumn("rate", F.round("rate", 12))
    task = Window.partitionBy("task_id")  # as many rows as arms
    ranked = rates.withColumn("have", F.count("*").over(task)).where(F.col("have") == k)
    ties = F.count("*").over(Window.partitionBy("task_id", "rate"))
    ranked = ranked.withColumn("ties", ties).withColumn("r", F.rank().over(task.orderBy("rate")) + (F.col("ties") - 1) / 2)
    by_arm = ranked.groupBy(GROUP).agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    out = by_arm.agg(F.max("n").alias("n_tasks"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("tied").alias("tied"), F.count("*").alias("arms"))
    n = F.col("n_tasks")
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    fair = 1 - F.col("tied") / (n * float(k * (k * k - 1)))
    return out.select(F.coalesce("n_tasks", F.lit(0)).cast("long").alias("n_tasks"), F.when((n >= 3) & (F.lit(k) >= 3), F.try_divide(raw, F.nullif(fair, F.lit(0.0)))).alias("statistic"), F.lit(k - 1).alias("dof"))


def calibration(pairs: DataFrame) -> DataFrame:
    """Baseline rate and spread of the control's log odds over tasks, for planning."""
    logit = F.ln((F.col("k0") + 0.5) / (F.col("n0") - F.col("k0") + 0.5))
    return pairs.groupBy("arm").agg((F.sum("k0") / F.sum("n0")).alias("p0"), F.stddev_samp(logit).alias("tau"), F.count("*").alias("n_tasks"))
