"""Contingency tables, rates, chi-square, and margins of error over tables.

Tables stay long, (row, col, value), until ``wide``: margins come from one cube, rates and expected counts from sums over
partitions, so no cell is collected. Distributions' tail probabilities are Column expressions, too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import ratio, require, safe_sum

TOTAL = "Total"


def contingency(df: DataFrame, row: str, col: str, value: str | None = None, weight: str | None = None, how: str = "sum", margins: bool = True) -> DataFrame:
    """(row, col, value) cells; with margins the keys "Total" too. Missing cells are absent here and 0 in ``wide``."""
    require(df, row, col, value, weight)
    v = F.lit(1.0) if value is None else F.col(value).cast("double")
    if weight is not None:
        v = v * F.col(weight)
    if value is None or how == "count":
        how, v = "sum", (F.lit(1.0) if value is None else F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)) * (F.lit(1.0) if weight is None else F.col(weight))
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown aggregate: {how!r}")
    kept = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c"), v.alias("v"))
    agg = safe_sum("v") if how == "sum" else F.avg("v")
    if not margins:
        return kept.groupBy("r", "c").agg(agg.alias("value")).select(F.col("r").alias("row"), F.col("c").alias("col"), "value")
    cube = kept.cube("r", "c").agg(agg.alias("value"), F.grouping("r").alias("gr"), F.grouping("c").alias("gc")).filter("value is not null")
    cube = cube.filter(~((F.col("gr") == 1) & (F.col("gc") == 1) & F.col("value").isNull()))
    return cube.select(F.when(F.col("gr") == 1, TOTAL).otherwise(F.col("r")).alias("row"), F.when(F.col("gc") == 1, TOTAL).otherwise(F.col("c")).alias("col"), "value")


def wide(table: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """One column for each of the given ones."""
    out = table.groupBy("row").pivot("col", list(columns)).agg(F.first("value"))
    return out.fillna(fill, subset=list(columns)) if fill is not None else out


def inner_cells(table: DataFrame) -> DataFrame:
    return table.filter((F.col("row") != TOTAL) & (F.col("col") != TOTAL))


def rates(table: DataFrame, normalize: str = "all") -> DataFrame:
    """Cells over the sum of all, of their row (``index``), or of their column (``columns``); a zero sum gives 0."""
    by = {"all": [], "index": ["row"], "columns": ["col"]}
    if normalize not in by:
        raise ValueError(f"normalize is none of {sorted(by)}: {normalize!r}")
    cells = inner_cells(table)
    if by[normalize]:
        total = F.sum("value").over(Window.partitionBy(*by[normalize]))
        return cells.withColumn("rate", F.coalesce(ratio(F.col("value"), total), F.lit(0.0))).select("row", "col", "rate")
    one = cells.agg(F.sum("value").alias("__n"))
    return cells.crossJoin(F.broadcast(one)).select("row", "col", F.coalesce(ratio(F.col("value"), F.col("__n")), F.lit(0.0)).alias("rate"))


def expected(table: DataFrame) -> DataFrame:
    """Cells of the full grid with observed and expected counts, and the degrees of freedom."""
    cells = inner_cells(table).groupBy("row", "col").agg(safe_sum("value").alias("value"))
    rows = cells.groupBy("row").agg(F.sum("value").alias("__r"))
    cols = cells.groupBy("col").agg(F.sum("value").alias("__c"))
    size = cells.agg(F.sum("value").alias("__n"), F.count_distinct("row").alias("__k"), F.count_distinct("col").alias("__m"))
    # the grid of a contingency table: as many rows as the result has
    grid = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(size)).join(cells, ["row", "col"], "left").fillna(0.0, subset=["value"])
    return grid.select("row", "col", "value", ratio(F.col("__r") * F.col("__c"), F.col("__n")).alias("expected"), ((F.col("__k") - 1) * (F.col("__m") - 1)).cast("long").alias("dof"))


def chi_square(table: DataFrame, yates: bool = True) -> DataFrame:
    """One row: statistic, p_value (both to six places), dof, n_cells. With one degree of freedom Yates' correction applies."""
    e = expected(table)
    gap = F.abs(F.col("value") - F.col("expected"))
    if yates:
        gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    one = e.agg(F.sum(ratio(gap * gap, F.col("expected"))).alias("x"), F.max("dof").alias("dof"), F.count("*").alias("n_cells"))
    return one.select(F.round("x", 6).alias("statistic"), F.round(chi_square_tail("x", "dof"), 6).alias("p_value"), "dof", "n_cells")


def chi_square_tail(x: str, dof: str, terms: int = 400) -> Column:
    """P(chi-square > x), by the series of the regularised lower gamma function, in logarithms against overflow.

    With a = dof / 2 and y = x / 2: 1 - sum of y^(a + k) e^-y / gamma(a + k + 1). Enough terms for y up to about 250.
    """
    a, y = f"({dof} / 2D)", f"({x} / 2D)"
    log_gamma = log_gamma_sql(f"({a} + 1D)")
    series = f"""aggregate(sequence(1, {terms}), named_struct('t', 1D, 's', 1D),
        (acc, k) -> named_struct('t', acc.t * {y} / ({a} + k), 's', acc.s + acc.t * {y} / ({a} + k)), acc -> acc.s)"""
    return F.expr(f"case when {x} is null or {dof} is null or {dof} < 1 then null when {x} <= 0 then 1D when {y} > 250 + 2 * {a} then 0D else greatest(0D, 1D - exp({a} * ln({y}) - {y} - {log_gamma}) * {series}) end")


def log_gamma_sql(z: str) -> str:
    """Stirling's series after shifting the argument up by eight."""
    shift = " + ".join(f"ln({z} + {i}D)" for i in range(8))
    w = f"({z} + 8D)"
    return f"(({w} - 0.5D) * ln({w}) - {w} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {w}) - 1D / (360D * pow({w}, 3)) + 1D / (1260D * pow({w}, 5)) - ({shift}))"


def moe_table(df: DataFrame, row: str, col: str, value: str, moe: str) -> DataFrame:
    """Per cell the summed estimate and its margin of error, the root of the summed squares."""
    require(df, row, col, value, moe)
    return df.groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")).agg(safe_sum(value).alias("value"), F.sqrt(safe_sum(F.col(moe) * F.col(moe))).alias("moe"))


def null_table(df: DataFrame, column: str) -> DataFrame:
    """Rows with and without a value, for each value and so, too, for null."""
    return df.groupBy(column).agg(F.count_if(F.col(column).isNull()).alias("null_count"), F.count_if(F.col(column).isNotNull()).alias("not_null_count"))


def null_totals(df: DataFrame, column: str) -> DataFrame:
    """The same over the whole table, as one row."""
    return df.agg(F.count_if(F.col(column).isNull()).alias("null_count"), F.count_if(F.col(column).isNotNull()).alias("not_null_count"))


def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows Count, Percentage (%) and Total, a column for each flag; one aggregate, no collect."""
    one = df.agg(F.count("*").alias("__n"), *(F.coalesce(F.sum(F.when(F.col(c), 1).otherwise(0)), F.lit(0)).alias(c) for c in flags))
    share = lambda c: F.coalesce(ratio(F.col(c) * 100, F.col("__n")), F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("Count").alias("metric"), *(F.col(c).cast("double").alias(c) for c in flags)),
        F.struct(F.lit("Percentage (%)").alias("metric"), *(share(c).alias(c) for c in flags)),
        F.struct(F.lit("Total").alias("metric"), *(F.col("__n").cast("double").alias(c) for c in flags)),
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")


def group_metrics(df: DataFrame, group: str, pivot: str, values: Sequence[str]) -> DataFrame:
    """Three rows a group, Count, Percentage (%) to two places, and Total, with a column for each pivot value."""
    counted = df.groupBy(group).pivot(pivot, list(values)).count().fillna(0, subset=list(values))
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    cells = lambda f: [f(F.col(f"`{v}`")).cast("double").alias(v) for v in values]
    rows = F.array(
        F.struct(F.lit("Count").alias("metric"), *cells(lambda c: c)),
        F.struct(F.lit("Percentage (%)").alias("metric"), *cells(lambda c: F.coalesce(F.round(ratio(c * 100, total), 2), F.lit(0.0)))),
        F.struct(F.lit("Total").alias("metric"), *cells(lambda c: total)),
    )
    return counted.select(group, F.explode(rows).alias("x")).select(group, "x.*")


def pair_matrix(df: DataFrame, a: str, b: str, metric: str, top: int) -> DataFrame:
    """Sums of a pair of dimensions, cut to the greatest ``top`` of each; long form, missing cells absent."""
    from .relational import top_k

    cells = df.groupBy(a, b).agg(safe_sum(metric).alias(metric))
    keep_a = top_k(cells.groupBy(a).agg(F.sum(metric).alias(metric)), metric, top, ties=[a]).select(a)
    keep_b = top_k(cells.groupBy(b).agg(F.sum(metric).alias(metric)), metric, top, ties=[b]).select(b)
    return cells.join(keep_a, a, "left_semi").join(keep_b, b, "left_semi")


def heat(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Means of the cells, and their place between the least and the greatest, 0 to 1."""
    cells = df.groupBy(x, y).agg(F.avg(value).alias("value"))
    span = cells.agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    return cells.crossJoin(F.broadcast(span)).select(x, y, "value", F.coalesce(ratio(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)).alias("level"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max, nulls and distinct values of columns, a row each, from one aggregate."""
    one = df.agg(*(F.struct(F.count(c).alias("count"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}.{k}").alias(k) for k in ("count", "mean", "std", "min", "max", "nulls", "distinct"))) for c in columns))).alias("x")).select("x.*")


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*")
