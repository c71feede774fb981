"""Desensitising columns by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MASK_TEXT = "***"


def masked(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(MASK_TEXT))


def rounded(c: Column) -> Column:
    """Half up towards positive infinity, as a whole number."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def noisy(c: Column, key: Column, seed: int = 0) -> Column:
    """Up to five percent off in either direction, drawn by the MD5 of seed and row key: a rerun gives the same value."""
    text = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return c * (F.lit(1.0) + (draw - F.lit(0.5)) * F.lit(0.1))


def desensitize(df: DataFrame, rules: dict[str, str], seed: int = 0, key: str | None = None) -> DataFrame:
    """Apply `{column: MASK | ROUND | NOISE}`; other rules and unknown columns change nothing.

    ROUND and NOISE act on double columns only. NOISE is drawn by `key`, or by the whole row without one.
    """
    changed = {}
    for place, (name, rule) in enumerate(rules.items()):
        if name not in df.columns:
            continue
        is_double = isinstance(df.schema[name].dataType, T.DoubleType)
        column = F.col(name)
        if rule == "MASK":
            changed[name] = masked(column)
        elif rule == "ROUND" and is_double:
            changed[name] = rounded(column)
        elif rule == "NOISE" and is_double:
            row = F.col(key) if key else F.to_json(F.struct("*"))
            changed[name] = noisy(column, row, seed + place)
    return df.withColumns(changed) if changed else df
