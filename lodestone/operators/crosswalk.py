"""Weighted boundary crosswalks, stability measures, and hierarchical roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import ratio, require, safe_sum
from .quantiles import median

#: Share of a source that counts as all of it (fixed values).
UNCHANGED, WHOLE, LEAST_WEIGHT = 0.999, 0.9999, 0.01
METHODS = {"area": "area_weight", "population": "population_weight", "housing": "housing_weight"}


def area_weights(df: DataFrame, overlap: str, source: str, output: str = "area_weight") -> DataFrame:
    """Overlap over source area, within 0 and 1; no source area gives 0."""
    return df.withColumn(output, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio(F.col(overlap), F.col(source)), F.lit(0.0)))))


def in_state(xwalk: DataFrame, state: str) -> DataFrame:
    """Edges whose source or target is in a state."""
    return xwalk.filter(F.col("source_geoid").startswith(state) | F.col("target_geoid").startswith(state))


def apply(df: DataFrame, xwalk: DataFrame, geoid: str, values: Sequence[str], method: str = "area", how: str = "sum") -> DataFrame:
    """Values carried to the targets by weight. Sources without an edge keep their code, with weight 1.

    ``how`` mean is the mean of the weighted values. A method whose weight column is missing raises.
    """
    weight = METHODS[method]
    require(xwalk, "source_geoid", "target_geoid", weight)
    agg = {"sum": safe_sum, "mean": F.avg}[how]
    edges = xwalk.select(F.col("source_geoid").alias("__s"), F.col("target_geoid").alias("__t"), F.col(weight).cast("double").alias("__w"))
    met = df.join(edges, F.col(geoid) == F.col("__s"), "left")
    w = F.when(F.col("__s").isNull(), 1.0).otherwise(F.col("__w"))
    weighed = met.select(F.coalesce("__t", geoid).alias(geoid), *((F.col(v) * w).alias(v) for v in values))
    return weighed.groupBy(geoid).agg(*(agg(v).alias(v) for v in values))


def apply_chain(df: DataFrame, xwalks: Sequence[DataFrame], geoid: str, values: Sequence[str], method: str = "area") -> DataFrame:
    """Several crosswalks in turn, as from 2000 over 2010 to 2020; none at all leaves the values as they are."""
    return reduce(lambda d, x: apply(d, x, geoid, values, method), xwalks, df.select(geoid, *values))


def per_source(xwalk: DataFrame) -> DataFrame:
    """A row for each source: targets, their number, weights, and the greatest weight."""
    pair = F.sort_array(F.collect_list(F.struct("target_geoid", "area_weight")))
    a = xwalk.groupBy("source_geoid").agg(pair.alias("__p"), F.count_distinct("target_geoid").alias("n_targets"), F.max("area_weight").alias("max_weight"))
    return a.select("source_geoid", "n_targets", "max_weight", F.array_join(F.transform("__p", lambda x: x["target_geoid"]), ",").alias("targets"), F.map_from_entries(F.transform("__p", lambda x: F.struct(x["target_geoid"], x["area_weight"]))).alias("weights"))


def relationship(xwalk: DataFrame, partial: bool = False) -> DataFrame:
    """Per source ONE_TO_ONE, SPLIT or MERGED; with ``partial`` also PARTIAL_OVERLAP for one target of less than the whole."""
    sources = xwalk.groupBy("target_geoid").agg(F.count_distinct("source_geoid").alias("__n"))
    a = xwalk.join(sources, "target_geoid").groupBy("source_geoid").agg(F.count_distinct("target_geoid").alias("n_targets"), F.max("__n").alias("n_sources"), F.max("area_weight").alias("max_weight"))
    kind = F.when(F.col("n_targets") > 1, "SPLIT").when(F.col("n_sources") > 1, "MERGED")
    if partial:
        kind = kind.when(F.col("max_weight") < UNCHANGED, "PARTIAL_OVERLAP")
    return a.select("source_geoid", "n_targets", "n_sources", kind.otherwise("ONE_TO_ONE").alias("relationship"))


def labels(xwalk: DataFrame) -> DataFrame:
    """Edges with IDENTICAL, RENAMED, SPLIT or PARTIAL."""
    n = F.count("*").over(Window.partitionBy("source_geoid"))
    whole = F.col("area_weight") >= WHOLE
    return xwalk.withColumn("relationship", F.when(whole & (F.col("source_geoid") == F.col("target_geoid")), "IDENTICAL").when(whole, "RENAMED").when(n > 1, "SPLIT").otherwise("PARTIAL"))


def metadata(xwalk: DataFrame) -> DataFrame:
    """One row: edges, sources, targets, and sources of each kind."""
    kinds = relationship(xwalk).agg(*(F.count_if(F.col("relationship") == k).alias(k.lower()) for k in ("ONE_TO_ONE", "SPLIT", "MERGED")))
    return xwalk.agg(F.count("*").alias("n_edges"), F.count_distinct("source_geoid").alias("n_sources"), F.count_distinct("target_geoid").alias("n_targets")).crossJoin(F.broadcast(kinds))


def stability(xwalk: DataFrame, threshold: float = UNCHANGED) -> DataFrame:
    """One row: sources, targets, unchanged, split and merged ones, and the share that changed."""
    s = xwalk.groupBy("source_geoid").agg(F.count_distinct("target_geoid").alias("n"), F.max("area_weight").alias("w"))
    t = xwalk.groupBy("target_geoid").agg(F.count_distinct("source_geoid").alias("n"))
    a = s.agg(F.count("*").alias("total_source"), F.count_if((F.col("n") == 1) & (F.col("w") >= threshold)).alias("unchanged"), F.count_if(F.col("n") > 1).alias("split"))
    b = t.agg(F.count("*").alias("total_target"), F.count_if(F.col("n") > 1).alias("merged"))
    return a.crossJoin(F.broadcast(b)).withColumn("churn_rate", F.coalesce(1 - ratio(F.col("unchanged"), F.col("total_source")), F.lit(0.0)))


def compare_stability(xwalks: dict[str, DataFrame]) -> DataFrame:
    """A row for each transition."""
    return reduce(lambda a, b: a.unionByName(b), (stability(x).withColumn("transition", F.lit(n)) for n, x in xwalks.items()))


def allocation(xwalk: DataFrame) -> DataFrame:
    """One row: moments of the weights, and the shares above .9 and .5 and below .1. The median is exact, and found when this is called."""
    w = F.col("area_weight")
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return xwalk.agg(F.avg(w).alias("mean_weight"), median(xwalk, "area_weight").alias("median_weight"), F.stddev_samp(w).alias("std_weight"), share(w > 0.9).alias("share_above_90"), share(w > 0.5).alias("share_above_50"), share(w < 0.1).alias("share_below_10"), F.count("*").alias("n"))


def volatile(xwalk: DataFrame, threshold: float = 0.9, top: int = 20) -> DataFrame:
    """Sources whose greatest weight is below a threshold, most targets first."""
    a = xwalk.groupBy("source_geoid").agg(F.count_distinct("target_geoid").alias("n_targets"), F.max("area_weight").alias("max_weight"))
    return a.filter(F.col("max_weight") < threshold).orderBy(F.desc("n_targets"), "max_weight", "source_geoid").limit(top)


def reallocation(xwalks: Sequence[DataFrame], origin: str | None = None, least: float = LEAST_WEIGHT) -> DataFrame:
    """(origin, final, weight) over all hops; paths below ``least`` end, codes without an edge pass on unchanged."""
    first = xwalks[0].select(F.col("source_geoid").alias("origin")).distinct() if origin is None else xwalks[0].sparkSession.createDataFrame([(origin,)], "origin string")
    now = first.select("origin", F.col("origin").alias("at"), F.lit(1.0).alias("weight"))
    for x in xwalks:
        edges = x.select(F.col("source_geoid").alias("at"), "target_geoid", F.col("area_weight").alias("w"))
        now = now.join(edges, "at", "left").select("origin", F.coalesce("target_geoid", "at").alias("at"), (F.col("weight") * F.coalesce("w", F.lit(1.0))).alias("weight")).filter(F.col("weight") >= least)
    return now.groupBy("origin", F.col("at").alias("final")).agg(F.sum("weight").alias("weight"))


def rollup(df: DataFrame, geoid: str, length: int, values: Sequence[str], operation: str = "sum", population: str | None = None, least_coverage: float = 0.0) -> DataFrame:
    """Values of a coarser level, by prefix of the code: sum, avg or weighted_avg, with each value's coverage.

    Averages are weighted by population only if every child has one; else they are plain. Coverage is rows with a value over
    rows; below ``least_coverage`` the value is null.
    """
    if operation not in ("sum", "avg", "weighted_avg"):
        raise ValueError(f"unknown operation: {operation!r}")
    require(df, geoid, *values, population)
    p = F.col(population).cast("double") if population else F.lit(None).cast("double")

    def agg(v: str) -> Column:
        x = F.col(v).cast("double")
        has = x.isNotNull()
        if operation == "sum":
            return F.sum(x)
        plain = F.avg(x)
        if operation == "avg":
            return plain
        weighed = ratio(F.sum(x * p), F.sum(F.when(has, p)))
        return F.when(F.count_if(has & p.isNull()) == 0, F.coalesce(weighed, plain)).otherwise(plain)

    out = df.groupBy(F.substring(geoid, 1, length).alias(geoid)).agg(F.count("*").alias("n_children"), *(agg(v).alias(v) for v in values), *(F.avg(F.col(v).isNotNull().cast("double")).alias(f"{v}_coverage") for v in values))
    return out.withColumns({v: F.when(F.col(f"{v}_coverage") >= least_coverage, F.col(v)) for v in values})


def rollup_crosswalked(df: DataFrame, xwalk: DataFrame, geoid: str, length: int, values: Sequence[str]) -> DataFrame:
    """Values carried over a crosswalk first, then summed by prefix."""
    return rollup(apply(df, xwalk, geoid, values), geoid, length, values)
