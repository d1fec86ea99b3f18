"""Survey tables, waves, significance letters, and raking.

All tables have one long form: (break_key, category, base, count, pct, ci). A break key is "variable=value". ``table``
turns it wide. Every kind of table is one grouped aggregate over the unpivoted break variables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import ratio, require, safe_sum
from .crosstab import chi_square

KINDS = ("single_response", "multiple_response", "cross_tab", "longitudinal", "ranking", "mean_scale", "banner")
DELTA = "Δ (change)"
#: Two-sided critical values of the normal distribution (fixed values).
CRITICAL = {0.05: 1.96, 0.01: 2.576, 0.10: 1.645}


def chain(df: DataFrame, row: str, breaks: Sequence[str], metric: str = "value", weight: str | None = None, kind: str = "cross_tab", top_n: int | None = None) -> DataFrame:
    """(break_key, category, base, count, pct, ci, rank) for one of the seven kinds.

    Counts are sums of the metric, times the weight; without a metric column they are rows or weights. Shares are of the
    rows kept by ``top_n``; of respondents for multiple responses. Means ignore weights, as their base doesn't.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is none of {KINDS}: {kind!r}")
    require(df, row, *breaks)
    has_metric = metric in df.columns
    weight = weight if weight in df.columns else None
    if kind == "mean_scale" and not has_metric:
        raise ValueError(f"means need the numeric column {metric!r}")
    keys = list(breaks)[:1] if kind == "longitudinal" else list(breaks)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    m = F.col(metric).cast("double") if has_metric else F.lit(1.0)
    dealt = df.select(
        F.col(row).cast("string").alias("category"), w.alias("w"), m.alias("m"),
        F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(b).alias("name"), F.col(b).cast("string").alias("value")) for i, b in enumerate(keys)))).alias("b"),
    ).filter("b.value is not null")
    key = F.col("b.value") if kind == "longitudinal" else F.concat_ws("=", "b.name", "b.value")
    dealt = dealt.select(key.alias("break_key"), "category", "w", "m")
    # base counts every row of the break value, also those without a category
    cells = dealt.groupBy("break_key", "category").agg(safe_sum(F.col("m") * F.col("w")).alias("count"), F.sum("w").alias("__w"), F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    by = Window.partitionBy("break_key")
    cells = cells.withColumn("base", F.sum("__w").over(by)).filter("category is not null")
    if kind == "mean_scale":
        cells = cells.filter("n > 0").withColumn("count", F.col("mean")).withColumn("ci", F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt("n")).otherwise(0.0))
    else:
        cells = cells.withColumn("ci", F.lit(None).cast("double"))
    cells = cells.withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), "category")))
    if top_n:
        cells = cells.filter(F.col("rank") <= top_n)
    if kind == "mean_scale":
        pct = F.lit(None).cast("double")
    else:
        whole = F.col("base") if kind == "multiple_response" else F.sum("count").over(by)
        pct = F.when(whole > 0, F.col("count") / whole).otherwise(0.0)
    out = cells.select("break_key", "category", "base", "count", pct.alias("pct"), "ci", "rank")
    return with_delta(out, df, weight) if kind == "longitudinal" else out


def with_delta(cells: DataFrame, df: DataFrame, weight: str | None) -> DataFrame:
    """Adds the change from the first to the last period; categories that one lacks count 0 there."""
    ends = cells.agg(F.min("break_key").alias("first"), F.max("break_key").alias("last"))
    base = df.agg((F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")).alias("base"))
    joined = cells.crossJoin(F.broadcast(ends)).filter("first != last and break_key in (first, last)")
    sign = F.when(F.col("break_key") == F.col("last"), 1).otherwise(-1)
    delta = joined.groupBy("category").agg(F.sum(sign * F.col("count")).alias("count")).crossJoin(F.broadcast(base))
    none = F.lit(None).cast("double")
    return cells.unionByName(delta.select(F.lit(DELTA).alias("break_key"), "category", "base", "count", none.alias("pct"), none.alias("ci"), F.lit(None).cast("int").alias("rank")))


def base_note(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: the note under a multiple-response table."""
    n = F.round(F.coalesce(F.sum(weight), F.lit(0.0)) if weight else F.count("*").cast("double")).cast("long")
    return df.agg(F.concat(F.lit("n="), F.format_number(n, 0), F.lit(" respondents; multiple responses permitted; percentages sum to more than 100%")).alias("base_note"))


def table(cells: DataFrame, break_keys: Sequence[str]) -> DataFrame:
    """Wide: a column for each break key, with shares times 100, or counts where there are no shares."""
    return cells.groupBy("category").pivot("break_key", list(break_keys)).agg(F.first(F.coalesce(F.col("pct") * 100, F.col("count"))))


def compare_waves(waves: Sequence[tuple[str, DataFrame]], row: str, breaks: Sequence[str] = (), metric: str = "value", weight: str | None = None, top_n: int | None = None) -> DataFrame:
    """Single-response tables of waves side by side; with two waves or more and no breaks, also the last minus the first."""
    if not waves:
        raise ValueError("there are no waves")
    each = []
    for name, df in waves:
        given = df if breaks else df.withColumn("_all", F.lit("all"))
        cells = chain(given, row, list(breaks) or ["_all"], metric, weight, "single_response", top_n)
        each.append(cells.withColumn("break_key", F.concat_ws("|", F.lit(name), "break_key") if breaks else F.lit(name)).drop("rank", "ci"))
    merged = reduce(lambda a, b: a.unionByName(b), each)
    if breaks or len(waves) < 2:
        return merged
    first, last = each[0].drop("break_key", "base"), each[-1].drop("break_key", "base")
    a, b = first.select("category", F.col("count").alias("c0"), F.col("pct").alias("p0")), last.select("category", F.col("count").alias("c1"), F.col("pct").alias("p1"))
    base = merged.groupBy("break_key").agg(F.max("base").alias("base")).agg(F.sum("base").alias("base"))
    delta = a.join(b, "category", "outer").crossJoin(F.broadcast(base))
    zero = F.lit(0.0)
    return merged.unionByName(delta.select(F.lit("Δ (last − first)").alias("break_key"), "category", "base", (F.coalesce("c1", zero) - F.coalesce("c0", zero)).alias("count"), (F.col("p1") - F.col("p0")).alias("pct")))


def letter(i: Column) -> Column:
    """A to Z, then AA, AB, and so on."""
    return F.when(i < 26, F.char(65 + i)).otherwise(F.concat(F.char(64 + F.floor(i / 26)), F.char(65 + i % 26)))


def column_significance(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """cells with sig_flag: the letters of the columns that a share is significantly above, by a pooled z-test.

    Each column has its own base. Letters follow the order of break keys.
    """
    if alpha not in CRITICAL:
        raise ValueError(f"alpha is none of {sorted(CRITICAL)}: {alpha!r}")
    columns = cells.groupBy("break_key").agg(F.max("base").alias("n")).withColumn("i", F.row_number().over(Window.orderBy("break_key")) - 1)  # a row for each column of a table
    categories = cells.select("category").distinct()
    grid = categories.crossJoin(F.broadcast(columns)).join(cells.select("break_key", "category", F.coalesce("pct", F.lit(0.0)).alias("p")), ["break_key", "category"], "left").fillna(0.0, subset=["p"])
    a, b = grid.select("category", F.col("break_key").alias("break_key"), F.col("p").alias("p1"), F.col("n").alias("n1"), F.col("i").alias("i1")), grid.select("category", F.col("p").alias("p2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    pairs = a.join(b, "category").filter("i1 != i2 and p1 > p2 and n1 > 0 and n2 > 0")
    pool = (F.col("p1") * F.col("n1") + F.col("p2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(F.greatest(pool * (1 - pool), F.lit(0.0)) * (1 / F.col("n1") + 1 / F.col("n2")))
    hits = pairs.withColumn("se", se).filter((F.col("se") > 1e-12) & ((F.col("p1") - F.col("p2")) / F.col("se") > CRITICAL[alpha]))
    flags = hits.groupBy("break_key", "category").agg(F.array_join(F.transform(F.sort_array(F.collect_list("i2")), letter), "").alias("sig_flag"))
    return cells.join(flags, ["break_key", "category"], "left")


def chi_square_flag(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: statistic, p_value, dof, significant, over counts of all columns but changes; false where a side has one value."""
    grid = cells.filter(~F.col("break_key").startswith("Δ")).select(F.col("category").alias("row"), F.col("break_key").alias("col"), F.col("count").alias("value"))
    return chi_square(grid).select("statistic", "p_value", "dof", F.coalesce((F.col("dof") >= 1) & (F.col("p_value") < alpha), F.lit(False)).alias("significant"))


def rake(df: DataFrame, targets: dict[str, dict[str, float]], weight: str = "weight", start: str | None = None, iterations: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """df with weights whose margins meet the target shares.

    Only the table of cells, at most the product of the targets' sizes, is fitted on the driver; the factor of each cell
    is joined back, so rows are read twice and never iterated. Rows with a value outside the targets raise, and so do
    targets that can't be met together.
    """
    names = list(targets)
    require(df, *names, start)
    w = F.col(start).cast("double") if start else F.lit(1.0)
    for n, t in targets.items():
        strange = df.filter(F.col(n).isNull() | ~F.col(n).cast("string").isin([str(v) for v in t])).select(n).limit(1).collect()
        if strange:
            raise ValueError(f"{n} has values without a target: {strange[0][0]!r}")
    cells = [(tuple(str(r[n]) for n in names), r["__w"]) for r in df.groupBy(*names).agg(F.sum(w).alias("__w")).collect()]
    total = sum(x for _, x in cells)
    factor = {k: 1.0 for k, _ in cells}
    for _ in range(iterations):
        worst = 0.0
        for i, n in enumerate(names):
            goal = {str(v): s / sum(targets[n].values()) for v, s in targets[n].items()}
            have: dict[str, float] = {}
            for k, x in cells:
                have[k[i]] = have.get(k[i], 0.0) + x * factor[k]
            for k, _ in cells:
                if have[k[i]] > 0:
                    step = goal[k[i]] * total / have[k[i]]
                    worst = max(worst, abs(step - 1))
                    factor[k] *= step
        if worst < tolerance:
            break
    else:
        if cells:
            raise RuntimeError(f"weights don't meet their targets after {iterations} rounds: {worst:.2g} off")
    spark = df.sparkSession
    fitted = spark.createDataFrame([(*k, f) for k, f in factor.items()], ", ".join(f"`__{n}` string" for n in names) + ", __factor double")
    met = df.join(F.broadcast(fitted), reduce(lambda a, b: a & b, (F.coalesce(F.col(n).cast("string"), F.lit("None")) == F.col(f"__{n}") for n in names)))
    return met.withColumn(weight, w * F.col("__factor")).drop("__factor", *(f"__{n}" for n in names))


def design_effect(df: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: effective sample size and design effect of weights."""
    return df.agg(F.count("*").alias("n"), ratio(F.sum(weight) * F.sum(weight), F.sum(F.col(weight) * F.col(weight))).alias("effective")).withColumn("design_effect", ratio(F.col("n"), F.col("effective")))
