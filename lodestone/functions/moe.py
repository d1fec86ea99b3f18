"""Margins of error at 90 %: propagation, reliability, and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import safe_sum
from .text import _c

#: Standard errors in a margin at 90 %, and at 95 % (fixed values).
Z90, Z95, RELIABLE = 1.645, 1.96, 0.40


def se(moe: Column | str) -> Column:
    return _c(moe) / Z90


def cv(value: Column | str, moe: Column | str) -> Column:
    """Standard error over the absolute estimate; infinite for an estimate of 0."""
    return F.when(_c(value) == 0, F.lit(float("inf"))).otherwise(F.abs(F.try_divide(se(moe), _c(value).cast("double"))))


def reliable(value: Column | str, moe: Column | str, threshold: float = RELIABLE) -> Column:
    return cv(value, moe) < threshold


def interval(value: Column | str, moe: Column | str, confidence: float = 0.90) -> Column:
    """Struct of lower and upper bounds at 90 or 95 %."""
    if confidence not in (0.90, 0.95):
        raise ValueError(f"confidence is 0.90 or 0.95: {confidence!r}")
    half = _c(moe) if confidence == 0.90 else se(moe) * Z95
    return F.struct((_c(value) - half).alias("lower"), (_c(value) + half).alias("upper"))


def summed(df: DataFrame, by: list[str], value: str, moe: str) -> DataFrame:
    """Sums with the root of the summed squares."""
    return df.groupBy(*by).agg(safe_sum(value).alias(value), F.sqrt(safe_sum(F.col(moe) * F.col(moe))).alias(moe))


def difference(a: Column, a_moe: Column, b: Column, b_moe: Column) -> Column:
    return F.struct((a - b).alias("value"), F.sqrt(a_moe * a_moe + b_moe * b_moe).alias("moe"))


def proportion(a: Column, a_moe: Column, b: Column, b_moe: Column) -> Column:
    """a / b within 0 and 1. Where the radicand is negative the ratio's form is taken; no denominator gives zeros."""
    p = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    sa, sb = a_moe / Z90, b_moe / Z90
    inner = sa * sa - p * p * sb * sb
    root = F.sqrt(F.when(inner >= 0, inner).otherwise(sa * sa + p * p * sb * sb))
    none = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("moe"))
    return F.when(b == 0, none).otherwise(F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("value"), F.coalesce(F.try_divide(root, F.abs(b)) * Z90, F.lit(0.0)).alias("moe")))


def quotient(a: Column, a_moe: Column, b: Column, b_moe: Column) -> Column:
    """a / b where a isn't part of b."""
    r = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    sa, sb = a_moe / Z90, b_moe / Z90
    root = F.sqrt(sa * sa + r * r * sb * sb)
    return F.struct(r.alias("value"), F.coalesce(F.try_divide(root, F.abs(b)) * Z90, F.lit(0.0)).alias("moe"))


def product(a: Column, a_moe: Column, b: Column, b_moe: Column) -> Column:
    sa, sb = a_moe / Z90, b_moe / Z90
    return F.struct((a * b).alias("value"), (F.sqrt(a * a * sb * sb + b * b * sa * sa) * Z90).alias("moe"))


def unreliable(df: DataFrame, value: str, moe: str, threshold: float = RELIABLE) -> DataFrame:
    """Rows whose coefficient of variation is above a threshold."""
    return df.withColumn("cv", cv(value, moe)).filter(F.col("cv") > threshold)


def snapshot(df: DataFrame, variables: list[str]) -> Column:
    """Map of the estimates that aren't null, by code; codes end in E, their margins in M."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, variables)), F.array(*(F.col(v).cast("double") for v in variables))), lambda k, v: v.isNotNull())


def moe_of(moes: Column | str, code: Column | str) -> Column:
    """The margin of an estimate's code."""
    return F.try_element_at(_c(moes), F.regexp_replace(_c(code), "E$", "M"))
