"""Segmented scans: running values along an ordered key that may hold any share of the rows.

A plain window gives a key to one task.  Here a key is cut into parts of its order; each part is scanned
alone, and what a part adds to the running value is one row of a small table.  That table is
scanned along its key and joined back, so that every row gets what came in the parts before its
own.  Any state that can be joined from left to right is scanned so: sums, counts, the last known value, the row
before, least and greatest values; backwards as well.

The key of a part is one struct, in which nulls are equal: rows are dealt by it once, for the windows inside parts
and the join. Orders should be total; rows that tie may come either way round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.shared import fixed

#: Positions of a key that are one part.
PART = 4096


@dataclass(frozen=True)
class Scan:
    """A running value: over the rows of a part, what a part adds, over parts, and both joined."""

    value: Column
    over_rows: Callable[[Column], Column]
    of_part: Callable[[Column, Callable[[Column], Column], Callable], Column]
    over_parts: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]
    before: bool = False


def total(value: Column, before: bool = False) -> Scan:
    """Running sum; nulls add nothing."""
    return Scan(value, F.sum, lambda v, _o, _e: F.sum(v), F.sum, lambda ahead, own: F.coalesce(ahead, F.lit(0)) + F.coalesce(own, F.lit(0)), before)


def count(condition: Column, before: bool = False) -> Scan:
    """How many rows so far meet a condition."""
    return total(F.coalesce(condition, F.lit(False)).cast("long"), before)


def ordinal() -> Scan:
    """The number of a row, from 1."""
    return total(F.lit(1).cast("long"))


def last_known(value: Column, before: bool = False) -> Scan:
    """The last value so far that isn't null; ``before``: of earlier rows only."""
    known = lambda c: F.last(c, ignorenulls=True)
    return Scan(value, known, lambda v, o, latest: latest(F.when(v.isNotNull(), o(v)))["_v"], known, lambda ahead, own: F.coalesce(own, ahead), before)


def row_before(value: Column) -> Scan:
    """A struct with the value (``v``) of the row before, null or not; null for a key's first row."""
    return last_known(F.struct(value.alias("v")), before=True)


def least(value: Column, before: bool = False) -> Scan:
    return Scan(value, F.min, lambda v, _o, _e: F.min(v), F.min, lambda ahead, own: F.least(ahead, own), before)


def most(value: Column, before: bool = False) -> Scan:
    return Scan(value, F.max, lambda v, _o, _e: F.max(v), F.max, lambda ahead, own: F.greatest(ahead, own), before)


def scanned(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, Scan], part: Column | None = None, back: bool = False) -> DataFrame:
    """``df`` with a column for each scan by ``keys``, along ``part`` and then ``order``.

    ``part`` must not fall along ``order``; without it the first column of the order, a number, is cut
    every ``PART``. ``back`` scans from the end.
    """
    part = F.floor(F.col(order[0]) / PART) if part is None else part
    rows = df.withColumn("_k", F.struct(*keys, part.alias("_part")))
    way = F.desc if back else F.asc
    here = Window.partitionBy("_k").orderBy(*(way(c) for c in order))
    frame = lambda w, upto: w.rowsBetween(Window.unboundedPreceding, upto)
    placed = lambda v: F.struct(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), v.alias("_v"))
    parts = rows.groupBy("_k").agg(*(s.of_part(s.value, placed, F.min if back else F.max).alias(name) for name, s in scans.items()))
    along = frame(Window.partitionBy(*(F.col("_k")[k] for k in keys)).orderBy(way(F.col("_k")["_part"])), -1)
    ahead = parts.select(F.col("_k").alias("_of"), *(s.over_parts(F.col(name)).over(along).alias(f"_{name}") for name, s in scans.items()))
    own = rows.select("*", *(s.over_rows(s.value).over(frame(here, -1 if s.before else 0)).alias(f"_own_{name}") for name, s in scans.items()))
    out = own.join(ahead, F.col("_k") == F.col("_of"))
    kept = [c for c in df.columns if c not in scans]
    return out.select(*kept, *(s.joined(F.col(f"_{name}"), F.col(f"_own_{name}")).alias(name) for name, s in scans.items()))


def ranged(df: DataFrame, keys: list[str], order: list[str], name: str = "part") -> DataFrame:
    """``df`` written in ranges of any order, with the number of each row's range: parts for orders that aren't numbers."""
    return fixed(df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()), "ranged")
