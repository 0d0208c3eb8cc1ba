"""Running sums whose keys may hold any share of the rows, as segmented scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.scan import scanned, total


def running_sum(df: DataFrame, keys: list[str], coarse: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, by ``keys``, in the order of ``coarse`` and then ``order``."""
    return scanned(df, keys, order, {name: total(F.col(value))}, F.col(coarse))


def running_count(df: DataFrame, keys: list[str], seq: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the running sum of an expression along ``seq``, by parts of its positions: a run may be of any length."""
    return scanned(df, keys, [seq, *order], {name: total(value)})
