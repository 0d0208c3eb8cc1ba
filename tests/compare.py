"""Rows of two engines, in a form that compares."""

import math

import pandas as pd


def cell(v):
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str(v.tolist())
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "dtype"):
        v = float(v)
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(cell(v) for v in r) for r in frame.itertuples(index=False)), key=str)
