"""Change, index, trend bands, outliers, and time series of values by year.

Tables are wide at the edges, ``{variable}_{year}``, and long, (id, variable, year, value), inside: consecutive years are
a lag over one partition by id, not a join for each year.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import no_nan, ratio, require, safe_sum
from .quantiles import exact_quantiles, median

#: Lower bounds of rapid growth, moderate growth, stable and moderate decline (fixed values).
PRESETS = {
    "default": (20, 5, -5, -20),
    "conservative": (30, 10, -10, -30),
    "sensitive": (10, 2, -2, -10),
    "housing": (25, 10, -5, -15),
    "population": (15, 5, -2, -10),
}
BANDS = ("rapid_growth", "moderate_growth", "stable", "moderate_decline", "rapid_decline")
QUANTILE_LABELS = {5: ["lowest", "low", "middle", "high", "highest"], 4: ["lowest", "low", "high", "highest"], 3: ["low", "middle", "high"]}

#: Annual averages of the consumer price index for all urban consumers, from 2000 on (fixed values).
CPI_U = dict(
    enumerate(
        [172.2, 177.1, 179.9, 184.0, 188.9, 195.3, 201.6, 207.3, 215.3, 214.5, 218.1, 224.9, 229.6,
         233.0, 236.7, 237.0, 240.0, 245.1, 251.1, 255.7, 258.8, 271.0, 292.7, 304.7, 313.2, 319.5],
        2000,
    )
)


def year_columns(df: DataFrame, variable: str) -> dict[int, str]:
    """Year to column for ``{variable}_{year}``, 1900 to 2100, in order."""
    found = {int(m[1]): c for c in df.columns if (m := re.fullmatch(rf"{re.escape(variable)}_(\d{{4}})", c)) and 1900 <= int(m[1]) <= 2100}
    return dict(sorted(found.items()))


def to_wide(long: DataFrame, key: str, variables: Sequence[str], years: Sequence[int]) -> DataFrame:
    """``{variable}_{year}`` columns of (key, variable, year, value) rows, known ahead, so no extra job looks for them."""
    names = [f"{v}_{y}" for v in variables for y in years]
    return long.groupBy(key).pivot("__name", names).agg(F.first("value")) if "__name" in long.columns else long.withColumn("__name", F.concat_ws("_", "variable", "year")).groupBy(key).pivot("__name", names).agg(F.first("value"))


def percent(start: Column, end: Column) -> Column:
    return no_nan(ratio((end - start) * 100, start))


def growth_rate(start: Column, end: Column, years: int | Column) -> Column:
    """Compound annual growth in percent; null for ratios of 0 or less and for no years."""
    n = F.lit(years) if isinstance(years, int) else years
    r = ratio(end, start)
    return F.when((r > 0) & (n > 0), (F.pow(r, 1.0 / n.cast("double")) - 1) * 100)


def change(df: DataFrame, variable: str, start: int, end: int, metrics: Sequence[str] = ("absolute", "percent", "cagr", "annualized")) -> DataFrame:
    """df with the chosen changes between two years."""
    require(df, f"{variable}_{start}", f"{variable}_{end}")
    a, b = F.col(f"`{variable}_{start}`").cast("double"), F.col(f"`{variable}_{end}`").cast("double")
    n = end - start
    made = {"absolute": ("change", b - a), "percent": ("pct_change", percent(a, b)), "cagr": ("cagr", growth_rate(a, b, n)), "annualized": ("annual_change", (b - a) / n if n > 0 else F.lit(None).cast("double"))}
    if set(metrics) - set(made):
        raise ValueError(f"metrics are none of {sorted(made)}: {sorted(set(metrics) - set(made))}")
    return df.select("*", *(made[m][1].alias(f"{variable}_{made[m][0]}_{start}_{end}") for m in metrics))


def multi_period(df: DataFrame, variable: str, metrics: Sequence[str] = ("absolute", "percent")) -> DataFrame:
    """Changes between each two consecutive years."""
    years = list(year_columns(df, variable))
    if len(years) < 2:
        raise ValueError(f"{variable} has fewer than two years")
    return reduce(lambda d, p: change(d, variable, *p, metrics), zip(years, years[1:], strict=False), df)


def changes_long(long: DataFrame, keys: Sequence[str], year: str = "year", value: str = "value") -> DataFrame:
    """Consecutive changes of long rows: previous year and value, absolute, percent, and compound rate."""
    w = Window.partitionBy(*keys).orderBy(year)
    a = long.withColumn("prev_year", F.lag(year).over(w)).withColumn("prev_value", F.lag(value).over(w))
    return a.filter("prev_year is not null").select("*", (F.col(value) - F.col("prev_value")).alias("change"), percent(F.col("prev_value"), F.col(value)).alias("pct_change"), growth_rate(F.col("prev_value"), F.col(value), F.col(year) - F.col("prev_year")).alias("cagr"))


def index_to(df: DataFrame, variable: str, base: int, level: float = 100.0) -> DataFrame:
    """df with ``{variable}_index_{year}``, each year over the base year."""
    require(df, f"{variable}_{base}")
    b = F.col(f"`{variable}_{base}`")
    return df.select("*", *(no_nan(ratio(F.col(f"`{c}`") * level, b)).alias(f"{variable}_index_{y}") for y, c in year_columns(df, variable).items()))


def change_summary(df: DataFrame, variable: str, start: int, end: int) -> DataFrame:
    """One row: moments of the changes, and how many rose, fell and stayed. Medians are exact, and found when this is called."""
    c = change(df, variable, start, end, ("absolute", "percent", "cagr"))
    p = f"{variable}_"
    s = f"_{start}_{end}"
    measures = ("change", "pct_change", "cagr")
    middle = {f"{p}{m}{s}": median(c, f"{p}{m}{s}") for m in measures}
    parts = [f(f"{p}{m}{s}").alias(f"{m}_{n}") for m in measures for n, f in (("mean", lambda x: F.avg(F.col(f"`{x}`"))), ("median", middle.get), ("std", lambda x: F.stddev_samp(F.col(f"`{x}`"))), ("min", lambda x: F.min(F.col(f"`{x}`"))), ("max", lambda x: F.max(F.col(f"`{x}`"))))]
    d = F.col(f"`{p}change{s}`")
    return c.agg(*parts, F.count_if(d > 0).alias("increased"), F.count_if(d < 0).alias("decreased"), F.count_if(d == 0).alias("unchanged"), F.count(d).alias("n"))


def bands(c: Column, bounds: Sequence[float], labels: Sequence[str] = BANDS, unknown: str = "unknown") -> Column:
    """The label of the first bound that a value reaches; the last label below all; ``unknown`` for null and NaN."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), unknown)
    for b, l in zip(bounds, labels, strict=False):
        out = out.when(c >= b, l)
    return out.otherwise(labels[-1])


def classify_trends(df: DataFrame, column: str, thresholds: str | Sequence[float] = "default", output: str = "trend") -> DataFrame:
    require(df, column)
    return df.withColumn(output, bands(F.col(column), PRESETS[thresholds] if isinstance(thresholds, str) else thresholds))


def classify_zscore(df: DataFrame, column: str, output: str = "trend") -> DataFrame:
    """df with z scores and bands; without spread all are average with z 0. The moments are one row, joined back."""
    one = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    z = F.when(F.coalesce(F.col("__s"), F.lit(0.0)) > 0, (F.col(column) - F.col("__m")) / F.col("__s")).otherwise(F.lit(0.0))
    label = F.when(F.col("zscore").isNull(), "average").when(F.col("zscore") >= 2, "extreme_positive").when(F.col("zscore") >= 1, "high_positive").when(F.col("zscore") <= -2, "extreme_negative").when(F.col("zscore") <= -1, "high_negative").otherwise("average")
    return df.crossJoin(F.broadcast(one)).withColumn("zscore", z).withColumn(output, label).drop("__m", "__s")


def quantile_bins(df: DataFrame, column: str, n: int, output: str) -> DataFrame:
    """df with the number of the bin, from 0, between linearly interpolated quantiles; equal edges count once.

    Edges are exact; they are found first, and are then constants of the plan. The first bin holds its lower edge; others are
    open below.
    """
    edges = sorted(set(exact_quantiles(df, column, [i / n for i in range(n + 1)]) or []))
    if len(edges) < 2:
        return df.withColumn(output, F.lit(None).cast("int"))
    at = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.withColumn(output, F.when(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")), at))


def classify_quantiles(df: DataFrame, column: str, n: int = 5, labels: Sequence[str] | None = None, output: str = "trend") -> DataFrame:
    names = list(labels) if labels else QUANTILE_LABELS.get(n, [str(i + 1) for i in range(n)])
    return quantile_bins(df, column, n, "__bin").withColumn(output, F.get(F.array(*map(F.lit, names)), F.col("__bin"))).drop("__bin")


def bivariate(df: DataFrame, a: str, b: str, n: int = 3) -> DataFrame:
    """df with the two bins and their joint class, a + b * n."""
    return quantile_bins(quantile_bins(df, a, n, "bin_a"), b, n, "bin_b").withColumn("bivariate_class", F.col("bin_a") + F.col("bin_b") * n)


def bivariate_crosstab(df: DataFrame, a: str, b: str, n: int = 3) -> DataFrame:
    """n * n rows: how many rows each joint class has, zeros included."""
    grid = df.sparkSession.range(n * n).select((F.col("id") % n).cast("int").alias("bin_a"), F.floor(F.col("id") / n).cast("int").alias("bin_b"))
    return grid.join(bivariate(df, a, b, n).groupBy("bin_a", "bin_b").count(), ["bin_a", "bin_b"], "left").fillna(0, subset=["count"])


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5, output: str = "outlier") -> DataFrame:
    """df with low_outlier, high_outlier or normal, by quartiles or by z scores."""
    if method == "iqr":
        q = exact_quantiles(df, column, [0.25, 0.75])
        lo, hi = (q[0] - threshold * (q[1] - q[0]), q[1] + threshold * (q[1] - q[0])) if q else (None, None)
        return df.withColumn(output, F.when(F.col(column) < F.lit(lo).cast("double"), "low_outlier").when(F.col(column) > F.lit(hi).cast("double"), "high_outlier").otherwise("normal"))
    if method == "zscore":
        one = df.agg((F.avg(column) - threshold * F.stddev_samp(column)).alias("__lo"), (F.avg(column) + threshold * F.stddev_samp(column)).alias("__hi"))
    else:
        raise ValueError(f"method is iqr or zscore: {method!r}")
    label = F.when(F.col(column) < F.col("__lo"), "low_outlier").when(F.col(column) > F.col("__hi"), "high_outlier").otherwise("normal")
    return df.crossJoin(F.broadcast(one)).withColumn(output, label).drop("__lo", "__hi")


def trend_summary(df: DataFrame, column: str = "trend") -> DataFrame:
    """Rows and share in percent of each band."""
    one = df.agg(F.count("*").alias("__n"))
    return df.groupBy(column).agg(F.count("*").alias("count")).crossJoin(F.broadcast(one)).select(column, "count", F.round(ratio(F.col("count") * 100, F.col("__n")), 2).alias("percent"))


def compare_trends(a: DataFrame, b: DataFrame, key: str, column: str = "trend") -> DataFrame:
    """Bands of two tables side by side; a band that one side lacks is a change and prints as nan."""
    x, y = a.select(key, F.col(column).alias("trend_1")), b.select(key, F.col(column).alias("trend_2"))
    nan = F.lit("nan")
    return x.join(y, key, "outer").select(key, "trend_1", "trend_2", (~F.col("trend_1").eqNullSafe(F.col("trend_2")) | F.col("trend_1").isNull()).alias("trend_changed"), F.concat(F.coalesce("trend_1", nan), F.lit(" -> "), F.coalesce("trend_2", nan)).alias("transition"))


def change_detection(now: DataFrame, before: DataFrame, key: str, metric: str) -> DataFrame:
    """Sums of two periods by key, percent change (0 where undefined), and direction."""
    a = now.groupBy(key).agg(safe_sum(metric).alias("current"))
    b = before.groupBy(key).agg(safe_sum(metric).alias("historical"))
    both = a.join(b, key, "outer").fillna(0.0, subset=["current", "historical"])
    p = percent(F.col("historical"), F.col("current"))
    direction = F.when((F.col("historical") == 0) & (F.col("current") > 0), "growth_from_zero").when(p > 0, "growth").when(p < 0, "decline").otherwise("stable")
    return both.select(key, "current", "historical", (F.col("current") - F.col("historical")).alias("change"), F.coalesce(p, F.lit(0.0)).alias("pct_change"), direction.alias("direction"))


def by_period(df: DataFrame, time: str, dims: Sequence[str], metric: str, period: str = "monthly") -> DataFrame:
    """Sums by calendar period (weeks begin on Monday) and dimensions."""
    unit = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[period]
    return df.groupBy(F.date_trunc(unit, time).cast("date").alias("period"), *dims).agg(safe_sum(metric).alias(metric))


def series(long: DataFrame, keys: Sequence[str], year: str = "year", value: str = "value", moe: str | None = None) -> DataFrame:
    """A row for each key: years, values (and margins, nulls kept) in order, mean, population deviation, growth and trend.

    Growth is a fraction a year over the years between the first and the last value; the trend compares the halves' means.
    """
    item = F.struct(F.col(year).alias("y"), F.col(value).cast("double").alias("v"), (F.col(moe) if moe else F.lit(None)).cast("double").alias("m"))
    g = long.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("s"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_dev"))
    n = F.size("s")
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    years = (last["y"] - first["y"]).cast("double")
    cagr = F.when((first["v"] > 0) & (last["v"] >= 0) & (years > 0), F.pow(last["v"] / first["v"], 1 / F.greatest(years, F.lit(1.0))) - 1)
    values = F.transform("s", lambda x: x["v"])
    return g.select(*keys, F.transform("s", lambda x: x["y"]).alias("years"), values.alias("values"), *([F.transform("s", lambda x: x["m"]).alias("moes")] if moe else []), first["y"].alias("start_year"), last["y"].alias("end_year"), "mean_value", "std_dev", cagr.alias("cagr"), trend_direction(values, n).alias("trend_direction"))


def trend_direction(values: Column, n: Column) -> Column:
    """increasing or decreasing if the second half's mean is more than 5 % above or below the first's, else stable."""
    half = F.floor(n / 2).cast("int")
    mean = lambda a, size: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(size, F.lit(1))
    a, b = mean(F.slice(values, 1, half), half), mean(F.slice(values, half + 1, F.greatest(n - half, F.lit(1))), n - half)
    c = F.try_divide(b - a, F.abs(a))
    return F.when((n < 2) | (a == 0), "stable").when(c > 0.05, "increasing").when(c < -0.05, "decreasing").otherwise("stable")


def inflation_factor(start: int, end: int) -> float:
    return CPI_U[end] / CPI_U[start]


def adjust_inflation(df: DataFrame, columns: Sequence[str], start: int, end: int) -> DataFrame:
    """Dollar columns in dollars of another year."""
    f = inflation_factor(start, end)
    return df.withColumns({c: F.col(c) * f for c in columns})


def boundary_vintage(year: Column) -> Column:
    return F.when(year >= 2020, 2020).when(year >= 2010, 2010).otherwise(2000)
