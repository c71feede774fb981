"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def share(part, whole) -> Column:
    """part / whole as a double, 0 where whole is 0 or missing."""
    return F.coalesce(F.try_divide(as_col(part).cast("double"), as_col(whole)), F.lit(0.0))


def finite(c) -> Column:
    """True for a number that is present, not NaN and not infinite."""
    c = as_col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def not_blank(c) -> Column:
    return F.coalesce(F.length(as_col(c)) > 0, F.lit(False))
