"""Null, naming and arithmetic contract shared by all operators.

Sums of groups without any value are 0.0; a division by zero or by null is null; NaN is null; aggregates keep the
name of their input; columns that both sides of a join have get ``_left`` and ``_right``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(F.col(c) if isinstance(c, str) else c), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def no_nan(c: Column) -> Column:
    """Null for NaN and for infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns."""
    return df.select([F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def require(df: DataFrame, *names: str | None) -> None:
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def identifier(name: str, allowed: Iterable[str] | None = None, dotted: bool = False) -> str:
    """A plain SQL identifier, also one of ``allowed`` if given; anything else raises."""
    part = r"[A-Za-z_][A-Za-z0-9_]*"
    if not isinstance(name, str) or len(name) > 128 * (1 + 2 * dotted) or not re.fullmatch(part + (rf"(\.{part}){{0,2}}" if dotted else ""), name):
        raise ValueError(f"not a plain identifier: {name!r}")
    if allowed is not None and name not in set(allowed):
        raise ValueError(f"{name!r} is none of {sorted(allowed)}")
    return name


def literal_text(value: str) -> str:
    """A string as it stands inside a quoted SQL literal. Parameters (``spark.sql(args=...)``) are better where they can be used."""
    if not isinstance(value, str):
        raise TypeError("only strings can be quoted")
    if "\0" in value:
        raise ValueError("a NUL can't stand in a SQL literal")
    return value.replace("'", "''")
