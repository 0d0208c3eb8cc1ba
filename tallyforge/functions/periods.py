"""Inclusive date periods: literals, membership, neighbours and enclosing periods."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FISCAL_START = 1


@dataclass(frozen=True)
class Period:
    """Both ends belong to it. Kinds: year, quarter, month, range."""

    start: date
    end: date
    kind: str
    label: str

    @staticmethod
    def year(y: int) -> "Period":
        return _months("year", y, FISCAL_START, 12, str(y))

    @staticmethod
    def quarter(y: int, q: int) -> "Period":
        if not 1 <= q <= 4:
            raise ValueError("a quarter is 1 to 4")
        return _months("quarter", y, FISCAL_START + 3 * (q - 1), 3, f"{y}-Q{q}")

    @staticmethod
    def month(y: int, m: int) -> "Period":
        return _months("month", y, m, 1, f"{y}-{m:02d}")

    @staticmethod
    def parse(text: str) -> "Period":
        """2024, 2024-Q4, 2024-11 or 2024-10-01..2024-12-31."""
        text = text.strip()
        if m := re.fullmatch(r"(\d{4})", text):
            return Period.year(int(m[1]))
        if m := re.fullmatch(r"(\d{4})-?[Qq]([1-4])", text):
            return Period.quarter(int(m[1]), int(m[2]))
        if m := re.fullmatch(r"(\d{4})-(\d{2})", text):
            return Period.month(int(m[1]), int(m[2]))
        if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})", text):
            a, b = date.fromisoformat(m[1]), date.fromisoformat(m[2])
            if a > b:
                raise ValueError("a range begins before it ends")
            return Period(a, b, "range", text)
        raise ValueError(f"{text!r} is no period")

    def contains(self, when: Column) -> Column:
        """A pair of bounds that Parquet scans take as filters."""
        return when.between(F.lit(self.start), F.lit(self.end))

    def days(self) -> int:
        return (self.end - self.start).days + 1

    def months(self) -> list["Period"]:
        out, (y, m) = [], (self.start.year, self.start.month)
        while date(y, m, 1) <= self.end:
            out.append(Period.month(y, m))
            y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        return out

    def _shifted(self, step: int) -> "Period":
        if self.kind == "range":
            move = timedelta(days=self.days() * step)
            a, b = self.start + move, self.end + move
            return Period(a, b, "range", f"{a}..{b}")
        size = {"year": 12, "quarter": 3, "month": 1}[self.kind]
        at = self.start.year * 12 + self.start.month - 1 + size * step
        return enclosing(date(at // 12, at % 12 + 1, 1), self.kind)

    def next(self) -> "Period":
        return self._shifted(1)

    def previous(self) -> "Period":
        return self._shifted(-1)


def _months(kind: str, y: int, m: int, n: int, label: str) -> Period:
    last = y * 12 + m - 1 + n - 1
    return Period(date(y + (m - 1) // 12, (m - 1) % 12 + 1, 1), date(last // 12, last % 12 + 1, calendar.monthrange(last // 12, last % 12 + 1)[1]), kind, label)


def enclosing(when: date, kind: str) -> Period:
    if kind == "month":
        return Period.month(when.year, when.month)
    y = when.year if when.month >= FISCAL_START else when.year - 1
    if kind == "year":
        return Period.year(y)
    return Period.quarter(y, ((when.month - FISCAL_START) % 12) // 3 + 1)


def iter_periods(start: Period, count: int) -> list[Period]:
    out = []
    for _ in range(count):
        out.append(start)
        start = start.next()
    return out


def period_label(when: Column, kind: str) -> Column:
    """The label of a date's enclosing period, as an expression."""
    y = F.year(when).cast("string")
    if kind == "year":
        return y
    if kind == "quarter":
        return F.concat(y, F.lit("-Q"), F.quarter(when).cast("string"))
    return F.date_format(when, "yyyy-MM")
