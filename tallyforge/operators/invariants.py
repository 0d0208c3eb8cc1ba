"""What must hold of rows while a plan runs: counted by the plan itself, told as a verdict, or an error.

An invariant is a condition that no row may break. ``watched`` counts breaks as rows pass, without another pass over them;
``verdicts`` is a row an invariant; ``enforced`` fails at the first break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def scanned_before_truncation() -> Column:
    """A visible region must not be digested when it is scanned: a fact shown in it would count as unread."""
    return ~(F.coalesce(F.col("model_visible"), F.lit(False)) & F.coalesce(F.col("digested"), F.lit(False)))


def _broken(holds: Column) -> Column:
    return F.count_if(~F.coalesce(holds, F.lit(False)))


def watched(df: DataFrame, name: str, **holds: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what is counted when it runs: rows, and for each invariant the rows that break it."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *(_broken(c).alias(n) for n, c in holds.items())), seen


def verdict(seen: Observation, *, failing: bool = False) -> list[tuple[str, int, int, bool]]:
    """(invariant, rows, broken, holds) after a watched frame ran; with ``failing`` a break is an error."""
    got = dict(seen.get)
    rows = got.pop("rows")
    out = [(name, rows, n, n == 0) for name, n in sorted(got.items())]
    wrong = [f"{name}: {n} of {rows} rows" for name, _, n, ok in out if not ok]
    if failing and wrong:
        raise ValueError("; ".join(wrong))
    return out


def verdicts(df: DataFrame, *keys: str, **holds: Column) -> DataFrame:
    """(*keys, invariant, rows, broken, holds) of a frame, from one aggregate."""
    one = df.groupBy(*keys).agg(F.count("*").alias("rows"), *(_broken(c).alias(f"_{n}") for n, c in holds.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("invariant"), F.col(f"_{n}").alias("broken")) for n in holds)))
    return one.select(*keys, "rows", each.alias("v")).select(*keys, "v.invariant", "rows", "v.broken", (F.col("v.broken") == 0).alias("holds"))


def enforced(df: DataFrame, **holds: Column) -> DataFrame:
    """``df``, or an error at the first row that breaks an invariant."""
    out = df
    for name, c in holds.items():
        out = out.where(F.when(~F.coalesce(c, F.lit(False)), F.raise_error(F.lit(f"broken: {name}")).cast("boolean")).otherwise(F.lit(True)))
    return out
