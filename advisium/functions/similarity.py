"""Similarity of squashed keys: twice the longest common subsequence over both lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([2.0 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def ratio(a: Column, b: Column) -> Column:
    """0 to 1; 0 if either is blank. Meant for distinct pairs that may_reach() lets through."""
    return _ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether lengths allow a ratio of the cutoff."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= cutoff * (F.length(a) + F.length(b))
