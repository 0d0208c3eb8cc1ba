"""Experiment design: seeds, blocked schedules, checkpoint cadence, and simulated power."""

from __future__ import annotations

import hashlib
import json
import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dist import normal_quantile, t_quantile

SEED = 20260805
SIZES = {"tasks": 12, "reps": 5, "family": 9}


def seed_int(material: str) -> int:
    return int.from_bytes(hashlib.sha256(material.encode()).digest()[:8], "big")


def run_id_for(job: str, task: str, condition: str, agent: str, rep: int) -> str:
    return f"{job}-{task}-{condition}-{agent}-r{rep:03d}"


def shuffled(items: list, *material: object) -> list:
    """``items`` in the order of a generator seeded by the named draw."""
    out = list(items)
    random.Random(seed_int("|".join(map(str, material)))).shuffle(out)
    return out


def schedule(spark: SparkSession, *, job: str, tasks: list[str], conditions: list[str], reps: int = 1, seed: int | None = 0, salt: str = "wur-v1") -> DataFrame:
    """Cells in a blocked random order: (task, rep) blocks are shuffled, and the arms inside each.

    A block's own draw depends on its name alone, so another task doesn't change it. A design is a
    table of its cells, made where it is asked for; no seed is seed 0.
    """
    tasks, conditions = ([str(x).strip() for x in own if str(x).strip()] for own in (tasks, conditions))
    if not tasks or not conditions or reps < 1 or len(set(tasks)) < len(tasks) or len(set(conditions)) < len(conditions):
        raise ValueError("a design needs distinct tasks, distinct conditions and at least one repetition")
    seed = seed or 0
    number = {cell: k for k, cell in enumerate((t, c, r) for t in tasks for c in conditions for r in range(1, reps + 1))}
    blocks = shuffled([(t, r) for t in tasks for r in range(1, reps + 1)], salt, "blocks", job, seed)
    rows = []
    for block, (task, rep) in enumerate(blocks):
        for within, arm in enumerate(shuffled(conditions, salt, "within", job, seed, task, rep)):
            rows.append((task, arm, rep, number[task, arm, rep], block, within, len(rows)))
    return spark.createDataFrame(rows, "task_id string, condition_id string, rep int, cell_index int, block_index int, within_block_index int, run_order_index int")


#: What a design's hash names.
DESIGN_VERSION, BLOCK_KEY = "wur-schedule-v1", ("task_id", "rep")


def json_sha256(value) -> str:
    """The hash of a value's canonical JSON: sorted names, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def design_sha256(*, job: str, tasks: list[str], conditions: list[str], reps: int = 1, seed: int | None = 0, experiment: str = "wur", salt: str = "wur-v1") -> str:
    """The hash of a design whatever the order of its lists: another arm or repetition changes it."""
    return json_sha256({"design_version": DESIGN_VERSION, "job_id": job, "experiment": experiment, "block_key": list(BLOCK_KEY), "tasks": sorted(tasks), "conditions": sorted(conditions), "reps": reps, "matrix_seed": seed or 0, "salt": salt})


def order_sha256(scheduled: DataFrame) -> str:
    """The hash of a schedule's order. A design is a table of its cells."""
    return json_sha256([[r["task_id"], r["condition_id"], r["rep"]] for r in scheduled.orderBy("run_order_index").collect()])


def schedule_drift(frozen: DataFrame, derived: DataFrame) -> DataFrame:
    """Cells whose place differs between a frozen and a derived schedule, or that one lacks."""
    keys = ["task_id", "condition_id", "rep"]
    a = frozen.select(*keys, F.col("run_order_index").alias("frozen_order"))
    b = derived.select(*keys, F.col("run_order_index").alias("derived_order"))
    return a.join(b, keys, "full_outer").where(~F.col("frozen_order").eqNullSafe(F.col("derived_order")))


def cadence(task: str, rep: int, budget: int, *, low: int = 1, high: int = 3, most: int = 24, salt: str = "wur-v1") -> list[int]:
    """Calls after which checkpoints fire, until the budget is reached; the last may pass it."""
    rng = random.Random(seed_int(f"{salt}|{task}|{rep}"))
    out, at = [], 0
    while at < budget and len(out) < most:
        at += rng.randint(low, high)
        out.append(at)
    return out


def arms_consistent(plants: DataFrame) -> DataFrame:
    """Folders whose content differs between arms: (task_id, dir, versions)."""
    return plants.groupBy("task_id", "dir").agg(F.countDistinct("sha256").alias("versions")).where("versions > 1")


# power


def expit(x):
    return 1 / (1 + np.exp(-x))


def logit(p):
    return np.log(p / (1 - p))


def marginal_rate(m: float, tau: float, shift: float = 0.0, spread: float = 0.0) -> float:
    """Mean of expit(m + shift + normal of both spreads), by Gauss-Hermite quadrature with 64 nodes."""
    x, w = np.polynomial.hermite_e.hermegauss(64)
    return float((w * expit(m + shift + np.hypot(tau, spread) * x)).sum() / w.sum())


def solved(f, low: float, high: float) -> float:
    """Root of an increasing function by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def base_logit(p0: float, tau: float) -> float:
    return solved(lambda m: marginal_rate(m, tau) - p0, -20, 20)


def shift_for(m: float, tau: float, gamma: float, difference: float) -> float:
    return solved(lambda d: marginal_rate(m, tau, d, gamma) - marginal_rate(m, tau) - difference, -20, 20)


def power(spark: SparkSession, differences: list[float], *, p0: float = 0.05, tau: float = 0.5, gamma: float = 0.0, tasks: int = 12, reps: int = 5, alpha: float = 0.05, sims: int = 4000, seed: int = SEED, chunk: int = 500, permutations: int = 0) -> DataFrame:
    """(difference, sims, paired_t, cmh, cmh_corrected, permutation): shares of simulated studies that reject.

    Simulations are independent, so each chunk of them is a row of work.
    """
    m = base_logit(p0, tau)
    shifts = {d: shift_for(m, tau, gamma, d) if d else 0.0 for d in differences}
    critical, chi = t_quantile(1 - alpha / 2, tasks - 1), normal_quantile(1 - alpha / 2) ** 2
    work = [(float(d), k, min(chunk, sims - k)) for d in differences for k in range(0, sims, chunk)]

    def run(batches):
        for pdf in batches:
            out = []
            for d, start, n in zip(pdf["difference"], pdf["start"], pdf["n"]):
                rng = np.random.default_rng([seed, int(round(d * 1e6)), int(start)])
                base = m + rng.normal(0, tau, (n, tasks))
                k0 = rng.binomial(reps, expit(base))
                k1 = rng.binomial(reps, expit(base + shifts[d] + rng.normal(0, gamma, (n, tasks)) if d or gamma else base))
                diff = (k1 - k0) / reps
                se = diff.std(axis=1, ddof=1) / np.sqrt(tasks)
                t = np.divide(np.abs(diff.mean(axis=1)), se, out=np.zeros(n), where=se > 0)
                total = 2 * reps
                good = k1 + k0
                num = np.abs((k1 - reps * good / total).sum(axis=1))
                den = (reps * reps * good * (total - good) / (total * total * (total - 1))).sum(axis=1)
                test = lambda x: np.divide(x * x, den, out=np.zeros(n), where=den > 0) > chi
                perm = np.zeros(n, int)
                for s in range(n if permutations else 0):
                    x = rng.hypergeometric(good[s], total - good[s], reps, (permutations, tasks))
                    hits = (np.abs((2 * x - good[s]).mean(axis=1)) >= abs((k1[s] - k0[s]).mean()) - 1e-12).sum()
                    perm[s] = (1 + hits) / (1 + permutations) <= alpha
                out.append((d, n, int((t > critical).sum()), int(test(num).sum()), int(test(np.maximum(num - 0.5, 0)).sum()), int(perm.sum())))
            yield pd.DataFrame(out, columns=["difference", "n", "t", "c", "cc", "p"])

    rows = spark.createDataFrame(work, "difference double, start long, n long").repartition(min(len(work), 64))
    got = rows.mapInPandas(run, "difference double, n long, t long, c long, cc long, p long")
    share = lambda c: F.sum(c) / F.sum("n")
    return got.groupBy("difference").agg(F.sum("n").alias("sims"), share("t").alias("paired_t"), share("c").alias("cmh"), share("cc").alias("cmh_corrected"), (share("p") if permutations else F.lit(None).cast("double")).alias("permutation"))


def minimum_detectable(spark: SparkSession, *, target: float = 0.8, low: float = 0.001, high: float = 0.9, rounds: int = 3, grid: int = 9, **options) -> float:
    """The difference with the wanted power: each round simulates a grid at once and keeps the bracket around it."""
    for _ in range(rounds):
        at = np.linspace(low, high, grid)
        found = {r["difference"]: r["paired_t"] for r in power(spark, [float(x) for x in at], **options).collect()}  # a row a grid point
        above = [x for x in at if found[float(x)] >= target]
        top = min(above) if above else at[-1]
        low, high = max([x for x in at if x < top], default=low), top
    return float((low + high) / 2)


def synthetic_runs(spark: SparkSession, *, tasks: int = 12, reps: int = 5, arms: tuple[str, ...] = ("ctrl", "d1", "d2", "d3"), base: float = 0.05, lift: dict[str, float] | None = None, tau: float = 0.5, seed: int = 7) -> DataFrame:
    """Runs with a planted effect, as a design's worth of rows."""
    rng = np.random.default_rng(seed)
    m, rows = base_logit(base, tau), []
    own = {t: rng.normal(0, tau) for t in range(tasks)}
    for t in range(tasks):
        for a in arms:
            up = (lift or {}).get(a, 0.0)
            p = expit(m + own[t] + (shift_for(m, tau, 0.0, up) if up else 0.0))
            rows += [(f"t{t:02d}-{a}-{r}", f"t{t:02d}", a, bool(rng.random() < p), bool(a != "ctrl" and rng.random() < 0.7)) for r in range(reps)]
    return spark.createDataFrame(rows, "run_id string, task_id string, condition_id string, used boolean, read boolean")


def uniform(seed: int, *names: Column) -> Column:
    """A number below 1 that the names alone decide, the same on any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *names)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def normal(seed: int, *names: Column) -> Column:
    """A standard normal number that the names decide, from two uniform ones."""
    u, v = uniform(seed, *names, F.lit("u")), uniform(seed, *names, F.lit("v"))
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(v * (2 * math.pi))


def synthetic_tables(spark: SparkSession, *, tasks: int = 12, reps: int = 5, arms: tuple[str, ...] = ("ctrl", "d1", "d2", "d3"), read_rate: dict[str, float] | None = None, base: float = 0.05, lift: dict[str, float] | None = None, gamma: float = 0.0, tau: float = 0.5, mention_given_read: float = 0.8, probes: int = 10, hazard: float = 0.25, seed: int = 7) -> dict[str, DataFrame]:
    """Runs and checkpoints with a known planted effect, of any size: ``fact_trace`` and ``probes``.

    A task shifts all its arms on the logit scale (spread ``tau``), an arm in a task by itself (``gamma``); a mention lapses
    after a geometric number of checkpoints. Every draw is a hash of its names, made where its row is.
    """
    read_rate = read_rate or {a: 0.0 if a.startswith("ctrl") else 0.7 for a in arms}
    per = len(arms) * reps
    arm = F.element_at(F.array(*(F.lit(a) for a in arms)), (F.floor(F.col("id") / reps) % len(arms)).cast("int") + 1)
    rows = spark.range(tasks * per).select(F.concat(F.lit("t"), F.lpad(F.floor(F.col("id") / per).cast("string"), 2, "0")).alias("task_id"), arm.alias("condition_id"), (F.col("id") % reps).alias("rep"))
    rows = rows.withColumn("run_id", F.concat_ws("-", "task_id", "condition_id", F.concat(F.lit("r"), F.col("rep").cast("string"))))
    of = lambda values, other: reduce(lambda out, kv: F.when(F.col("condition_id") == kv[0], F.lit(float(kv[1]))).otherwise(out), values.items(), F.lit(float(other)))
    draw = lambda name: uniform(seed, F.col("run_id"), F.lit(name))
    p = F.least(F.lit(0.98), F.greatest(F.lit(1e-6), F.lit(base) + of(lift or {}, 0.0)))
    shift = F.lit(tau) * normal(seed, F.col("task_id")) + F.lit(gamma) * normal(seed, F.col("task_id"), F.col("condition_id"))
    present = ~F.col("condition_id").startswith("ctrl")
    rows = rows.withColumn("available", present).withColumn("read", present & (draw("read") < of(read_rate, 0.0))).withColumn("used", draw("used") < 1 / (1 + F.exp(-(F.ln(p / (1 - p)) + shift))))
    rows = rows.withColumn("ever_mention", F.col("read") & (draw("mention") < mention_given_read)).withColumn("opened", F.col("read") & (draw("opened") < 0.6)).withColumn("success", draw("success") < 0.6)
    rows = rows.withColumn("first_mention_probe_index", F.when(F.col("ever_mention"), F.floor(draw("first") * 3)))
    horizon = F.lit(probes) - F.col("first_mention_probe_index")
    lapse = F.floor(F.ln(1 - draw("lapse")) / math.log(1 - hazard)) + 1
    rows = rows.withColumn("horizon", horizon).withColumn("lapse", F.when(lapse < horizon, lapse))
    censored = F.when(~F.col("ever_mention"), "never_mentioned").when(F.col("lapse").isNull(), "administrative")
    fixed_ = {"eligible": F.lit(True), "analyzable": F.lit(True), "quarantined": F.lit(False), "prior_check_status": F.lit("pass"), "exposure_basis": F.lit("event_stream"), "unexplained_possession": F.lit(False), "echoed": F.col("ever_mention"), "accounting_version": F.lit("per_message_v2"), "censor_reason": censored}
    trace = rows.withColumns(fixed_)
    each = rows.select("run_id", "task_id", "condition_id", "first_mention_probe_index", "lapse", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("probe_idx"))
    i0, k = F.col("first_mention_probe_index"), F.col("probe_idx")
    named = F.coalesce((k >= i0) & (F.col("lapse").isNull() | (k < i0 + F.col("lapse"))), F.lit(False))
    agree = uniform(seed, F.col("run_id"), F.lit("agree"), k.cast("string")) < 0.7
    return {"fact_trace": trace, "probes": each.select("run_id", "task_id", "condition_id", "probe_idx", named.alias("mentioned"), F.lit("answered").alias("outcome"), F.lit(True).alias("parse_ok"), F.lit("strict").alias("parse_tier"), agree.alias("fidelity_agree"))}


def family_alpha(alpha: float = 0.05, family: int = SIZES["family"]) -> float:
    """Bonferroni's level of each test, so that the family's is ``alpha``."""
    return alpha / max(1, family)


def type_one(spark: SparkSession, *, p0s: tuple[float, ...] = (0.05, 0.2, 0.5), gammas: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0), alpha: float = 0.05, sims: int = 4000, **options) -> DataFrame:
    """(p0, gamma, sims, paired_t, cmh, cmh_corrected, permutation, halfwidth): rejections where the mean difference is none."""
    out = None
    for p0 in p0s:
        for gamma in gammas:
            one = power(spark, [0.0], p0=p0, gamma=gamma, alpha=alpha, sims=sims, **options)
            one = one.select(F.lit(p0).alias("p0"), F.lit(gamma).alias("gamma"), "sims", "paired_t", "cmh", "cmh_corrected", "permutation", F.lit(1.96 * (alpha * (1 - alpha) / sims) ** 0.5).alias("halfwidth"))
            out = one if out is None else out.unionByName(one)
    return out
