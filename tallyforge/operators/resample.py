"""Resampling as a distributed job: whole units (tasks) are drawn again, rows of a unit share its weight.

Units are numbered in their order and cut into parts; draws are cut into blocks.  A task of the
job has one part and one block, draws the part's weights and adds its rows up by them, so it
sends sums and not rows, and neither a stratum's units nor its draws are one task's work.
How many of a draw's picks fall into a part comes from splitting its number down a
binary tree of parts, a binomial a node, so that all weights together are one multinomial.
Generators are keyed by seed, stratum, block and node: the result doesn't depend on how
rows are partitioned, but for the order in which a few sums are added.

A statistic is any expression of the sums a draw: means, differences, ratios, curves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.scan import ordinal, ranged, scanned
from tallyforge.shared import fixed

#: Units of a part, and draws of a block.
UNITS, BLOCK = 2048, 256


def generator(*key: object) -> np.random.Generator:
    """The stream of a key, the same on every machine."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5(repr(key).encode()).digest()[:16], "little")))


def picks(key: tuple, n: int, part: int, draws: int, size: int = UNITS) -> np.ndarray:
    """How many of each draw's ``n`` picks out of ``n`` units fall into a part, by a binomial for each node above it."""
    low, high = 0, -(-n // size)
    count = np.full(draws, n, np.int64)
    held = lambda a, b: min(b * size, n) - a * size
    while high - low > 1:
        mid = (low + high) // 2
        left = generator(*key, low, high).binomial(count, held(low, mid) / held(low, high))
        low, high, count = (low, mid, left) if part < mid else (mid, high, count - left)
    return count


def weights(key: tuple, n: int, part: int, units: int, draws: int, size: int = UNITS) -> np.ndarray:
    """(draws, units): how often each unit of a part is drawn."""
    rng = generator(*key, "part", part)
    return np.stack([np.bincount(rng.integers(0, units, c), minlength=units) for c in picks(key, n, part, draws, size)])


def numbered(rows: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """``rows`` with _at, the place of their unit among its stratum's, and _n, how many those are. Written."""
    units = rows.select(*by, F.col(unit).alias("_unit")).distinct()
    keys = list(by) or ["_all"]
    placed = scanned(ranged(units.withColumn("_all", F.lit(0)), keys, ["_unit"], "_range"), keys, ["_unit"], {"_at": ordinal()}, F.col("_range")).drop("_range")
    placed = fixed(placed, "units")
    of = lambda k: F.col(k).alias(f"_s{k}")
    sizes = placed.groupBy(*(of(k) for k in keys)).agg(F.max("_at").alias("_n"))
    together = lambda: [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]
    placed = placed.join(sizes, together()).select(*(of(k) for k in by), "_unit", (F.col("_at") - 1).alias("_at"), "_n")
    on = [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in by] + [F.col(unit).eqNullSafe(F.col("_unit"))]
    return fixed(rows.join(placed, on).drop(*(f"_s{k}" for k in by), "_unit"), "numbered")


def _dealt(placed: DataFrame, draws: int, size: int, block: int) -> DataFrame:
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // block) - 1)))
    return placed.withColumn("_part", F.floor(F.col("_at") / size)).withColumn("_block", blocks)


def resampled(rows: DataFrame, unit: str, values: Sequence[str], *, by: Sequence[str] = (), cell: Sequence[str] = (), draws: int, seed: int, size: int = UNITS, at_once: int = BLOCK) -> DataFrame:
    """(*by, *cell, draw, *values): sums of the values over rows, weighted by how often their unit is drawn.

    A part has ``size`` units, a block ``at_once`` draws; other sizes give other draws.

    Draw 0 is the sample itself. Strata in ``by`` have draws of their own; cells of one stratum share them.
    A cell that a draw misses has no row.
    """
    by, cell, values = list(by), list(cell), list(values)
    placed = numbered(rows.select(*by, *cell, F.col(unit), *(F.col(v).cast("double").alias(v) for v in values)), by, unit)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*by, *cell]), "draw long", *(f"`{v}` double" for v in values)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, part, block = int(first["_n"]), int(first["_part"]), int(first["_block"])
        units = min(size, n - part * size)
        count = min(at_once, draws - block * at_once)
        w = weights((seed, *(str(first[k]) for k in by), block), n, part, units, count, size)
        if not block:  # the sample itself
            w = np.concatenate([np.ones((1, units), np.int64), w])
        # rows of a part in one order, so that sums don't depend on how they came
        pdf = pdf.sort_values(["_at", *cell], kind="stable", key=lambda c: c if c.name == "_at" else c.astype(str))
        own = (pdf["_at"].to_numpy() - part * size).astype(np.int64)
        keys = pdf.groupby(cell, dropna=False, sort=False) if cell else None
        of = keys.ngroup().to_numpy() if cell else np.zeros(len(pdf), np.int64)
        heads = pdf[cell].drop_duplicates().reset_index(drop=True) if cell else pd.DataFrame(index=[0])
        c, out = len(heads), []
        columns = {v: pdf[v].to_numpy() for v in values}
        for k, row in enumerate(w):
            times = row[own]
            some = np.flatnonzero(np.bincount(of, times, c))
            got = heads.iloc[some].assign(draw=k + (block * at_once + 1 if block else 0), **{v: np.bincount(of, times * x, c)[some] for v, x in columns.items()})
            out.append(got)
        out = pd.concat(out)
        return out.assign(**{k: first[k] for k in by})[[*by, *cell, "draw", *values]]

    parts = _dealt(placed, draws, size, at_once).groupBy(*by, "_part", "_block").applyInPandas(run, schema)
    return parts.groupBy(*by, *cell, "draw").agg(*(F.sum(v).alias(v) for v in values))


def interval(drawn: DataFrame, statistic: Column, *, by: Sequence[str] = (), alpha: float = 0.05, name: str = "statistic", low: str = "low", high: str = "high") -> DataFrame:
    """(*by, the sample's statistic, its percentile interval over draws) from a row a draw."""
    drawing = F.when(F.col("draw") > 0, statistic)
    ends = F.percentile(drawing, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    got = drawn.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, statistic)).alias(name), ends.alias("_q"))
    return got.select(*by, name, F.col("_q")[0].alias(low), F.col("_q")[1].alias(high))


def mean_interval(rows: DataFrame, unit: str, value: Column, *, by: Sequence[str] = (), draws: int, seed: int, alpha: float = 0.05, **parts: int) -> DataFrame:
    """(*by, mean, low, high): percentile interval of a mean over resampled units; null values are left out."""
    known = rows.select(*by, F.col(unit), value.cast("double").alias("_v")).where("_v is not null").withColumn("_w", F.lit(1.0))
    drawn = resampled(known, unit, ["_v", "_w"], by=by, draws=draws, seed=seed, **parts)
    return interval(drawn, F.col("_v") / F.col("_w"), by=by, alpha=alpha, name="mean")


def exchanged(pairs: DataFrame, *, draws: int, seed: int, size: int = UNITS, at_once: int = BLOCK) -> DataFrame:
    """(arm, draw, total, n): sums over tasks of the difference of two rates when labels are exchanged within tasks.

    Draw 0 is what was seen. For flags, an exchanged arm's successes are hypergeometric given the
    task's margins, so tasks are dealt by parts like units, whatever the number of runs.
    """
    placed = numbered(pairs.select("arm", "task_id", "n1", "k1", "n0", "k0"), ["arm"], "task_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        arm, part, block = pdf["arm"].iloc[0], int(pdf["_part"].iloc[0]), int(pdf["_block"].iloc[0])
        n1, k1, n0, k0 = (pdf[c].to_numpy() for c in ("n1", "k1", "n0", "k0"))
        good, rng = k1 + k0, generator(seed, str(arm), block, part)
        count, at = min(at_once, draws - block * at_once), block * at_once + 1
        x = rng.hypergeometric(good, n1 + n0 - good, n1, (count, len(n1)))
        total = (x / n1 - (good - x) / n0).sum(axis=1)
        if not block:
            total, count, at = np.concatenate([[(k1 / n1 - k0 / n0).sum()], total]), count + 1, 0
        return pd.DataFrame({"arm": arm, "draw": np.arange(count) + at, "total": total, "n": float(len(n1))})

    parts = _dealt(placed, draws, size, at_once).groupBy("arm", "_part", "_block").applyInPandas(run, "arm string, draw long, total double, n double")
    return parts.groupBy("arm", "draw").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
