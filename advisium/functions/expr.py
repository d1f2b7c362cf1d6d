"""Small helpers that the column functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names a value, so that an expression that needs it often computes it once; works inside lambdas."""
    return F.transform(F.array(value), body)[0]


def blank(x: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(blank(x), r"(?U)^\s+|\s+$", "")


def quoted(x: Column | str) -> Column:
    """A text in quotes, as reports show it: single ones, or double ones if only single ones are in it."""

    def body(t: Column) -> Column:
        esc = t
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            esc = F.replace(esc, F.lit(raw), F.lit(shown))
        double = F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return let(blank(x), body)
