"""Grouping, joins, filters, validity intervals, top-k, and set operations."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..compat import require, safe_sum

AGGREGATES = {
    "sum": safe_sum,
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
    "approx_count_distinct": F.approx_count_distinct,
    "count_distinct": F.count_distinct,
}


def groupby_agg(df: DataFrame, by: Sequence[str], aggregates: dict[str, str], order_by: str | None = None, drop_null_keys: bool = False) -> DataFrame:
    """One aggregate a column, under the column's own name.

    ``first`` and ``last`` need ``order_by``, so that their result doesn't depend on how rows are dealt. With
    ``drop_null_keys`` groups with a null key go, as in pandas.
    """
    if not aggregates:
        raise ValueError("no aggregates are given")
    require(df, *by, *aggregates, order_by)
    out = []
    for name, how in aggregates.items():
        if how in AGGREGATES:
            out.append(AGGREGATES[how](name).alias(name))
        elif how in ("first", "last") and order_by:
            out.append((F.min_by if how == "first" else F.max_by)(name, order_by).alias(name))
        else:
            raise ValueError(f"aggregate {how!r} is none of {sorted(AGGREGATES)}, or first or last with order_by")
    if drop_null_keys:
        df = df.dropna(subset=list(by))
    return df.groupBy(*by).agg(*out)


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on columns both sides have; other columns that both have get ``_left`` and ``_right``.

    Null keys match nothing, or each other with ``null_safe``. Outer joins give the key of whichever side has it.
    """
    keys = [on] if isinstance(on, str) else list(on)
    require(left, *keys)
    require(right, *keys)
    how = {"full": "outer", "full_outer": "outer", "left_outer": "left", "right_outer": "right"}.get(how, how)
    if how not in ("inner", "left", "right", "outer", "semi", "anti", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how!r}")
    if how.endswith(("semi", "anti")):
        how = "left_" + how.rsplit("_", 1)[-1]
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.select([F.col(f"`{c}`").alias(f"{c}_left" if c in both else c) for c in left.columns])
    if not null_safe:
        b = right.select([F.col(f"`{c}`").alias(f"{c}_right" if c in both else c) for c in right.columns])
        return (left if how.startswith("left_") else a).join(b, keys, how)
    b = right.select([F.col(f"`{c}`").alias(f"__{c}" if c in keys else f"{c}_right" if c in both else c) for c in right.columns])
    left_side = left if how.startswith("left_") else a
    met = left_side.join(b, reduce(lambda x, y: x & y, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys)), how)
    if how.startswith("left_"):
        return met
    rest = [c for c in met.columns if c not in keys and c not in {f"__{k}" for k in keys}]
    return met.select(*(F.coalesce(F.col(f"`{k}`"), F.col(f"`__{k}`")).alias(k) for k in keys), *(F.col(f"`{c}`") for c in rest))


def valid_at(df: DataFrame, when, start: str = "valid_from", end: str = "valid_to", end_exclusive: bool = False) -> DataFrame:
    """Rows whose interval holds a date; a null end or start is open."""
    d = F.lit(when).cast("date")
    before = (F.col(end) > d) if end_exclusive else (F.col(end) >= d)
    return df.filter((F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | before))


def temporal_filter(df: DataFrame, when, start: str = "valid_from", end: str = "valid_to", vintage: str = "vintage_year") -> DataFrame:
    """``valid_at``; if nothing is valid then, the newest vintage up to that year, or else the earliest one.

    One plan: the fallback is a one-row aggregate, joined back.
    """
    d = F.lit(when).cast("date")
    ok = (F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | (F.col(end) >= d))
    facts = df.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("__any"), F.max(F.when(F.col(vintage) <= F.year(d), F.col(vintage))).alias("__best"), F.min(vintage).alias("__least"))
    met = df.crossJoin(F.broadcast(facts))  # one row
    return met.filter(F.when(F.col("__any"), ok).otherwise(F.col(vintage) == F.coalesce("__best", "__least"))).drop("__any", "__best", "__least")


def vintage_at(df: DataFrame, year: int, vintage: str = "vintage_year") -> DataFrame:
    """Rows of the newest vintage up to a year, or of the earliest one if all are later."""
    best = df.agg(F.coalesce(F.max(F.when(F.col(vintage) <= year, F.col(vintage))), F.min(vintage)).alias("__best"))
    return df.join(F.broadcast(best), F.col(vintage) == F.col("__best")).drop("__best")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """For each left row the values of the latest right row of its key up to its time.

    Both sides are put in one order per key and the last value seen is carried on: a single shuffle by key, no range join.
    """
    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*left.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def overlaps(a: DataFrame, b: DataFrame, start: str, end: str, on: Sequence[str] = (), width_days: int = 365) -> DataFrame:
    """Pairs whose closed intervals overlap, open ends as infinite; pairs once, columns with _left and _right.

    Of two that overlap, one holds the other's start. Days are dealt to cells of ``width_days``, cells to a binary tree: an interval
    stands at the few nodes that make it up, a start at all nodes above its cell, so the two meet at one node however long they are.
    An open end stands at the last, or first, day that any interval of either side names: whatever meets beyond meets there.
    """
    both = a.select(start, end).union(b.select(start, end)).select(F.col(start).cast("date").alias("s"), F.col(end).cast("date").alias("e"))
    none = F.lit(0).cast("int")
    reach = both.agg(F.coalesce(F.unix_date(F.min(F.least("s", "e"))), none).alias("__first"), F.coalesce(F.unix_date(F.max(F.greatest("s", "e"))), none).alias("__last"))
    cell = lambda c: F.floor((c - F.col("__first")) / width_days)
    levels = F.sequence(F.lit(0), F.ceil(F.log2(cell(F.col("__last")) + 1)).cast("int"))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        lo = F.coalesce(F.unix_date(F.col(start).cast("date")), F.col("__first"))
        hi = F.coalesce(F.unix_date(F.col(end).cast("date")), F.col("__last"))
        given = df.crossJoin(F.broadcast(reach))  # one row
        renamed = given.select([F.col(f"`{c}`").alias(c if c in on else f"{c}_{side}") for c in df.columns] + [lo.alias(f"__lo_{side}"), hi.alias(f"__hi_{side}"), cell(lo).alias("__p"), cell(hi).alias("__q"), levels.alias("__levels")])
        # names of nodes for intervals of the left, and for those of the right
        holds, held = (0, 1) if side == "left" else (1, 0)
        name = lambda level, node, role: (node * 2 + role) * 64 + level
        up = lambda c, level: F.call_function("shiftright", c, level)

        def made_up(level):
            """The first and last node of a level within the interval, unless the node above is within it too."""
            first, last = -up(-F.col("__p"), level), up(F.col("__q") + 1, level) - 1
            some = first <= last
            return F.array(F.when(some & (first % 2 == 1), name(level, first, holds)), F.when(some & (last % 2 == 0), name(level, last, holds)))

        nodes = F.concat(F.array_compact(F.flatten(F.transform("__levels", made_up))), F.transform("__levels", lambda level: name(level, up(F.col("__p"), level), held)))
        return renamed.filter(f"__lo_{side} <= __hi_{side}").withColumn("__node", F.explode(nodes)).drop("__p", "__q", "__levels")

    met = dealt(a, "left").join(dealt(b, "right"), [*on, "__node"])
    right_starts = (F.col("__lo_right") >= F.col("__lo_left")) & (F.col("__lo_right") <= F.col("__hi_left"))
    left_starts = (F.col("__lo_left") > F.col("__lo_right")) & (F.col("__lo_left") <= F.col("__hi_right"))
    of_left = F.floor(F.col("__node") / 64) % 2 == 0
    return met.filter(F.when(of_left, right_starts).otherwise(left_starts)).drop("__node", "__lo_left", "__hi_left", "__lo_right", "__hi_right")


def top_k(df: DataFrame, order: str, k: int, by: Sequence[str] = (), ties: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """The k rows with the greatest ``order``, over all or per key; ``ties`` decides among equals."""
    keys = [F.col(order).desc_nulls_last(), *(F.col(t).asc() for t in ties)]
    if not by and rank is None:
        return df.orderBy(*keys).limit(k)
    if not by:
        return df.orderBy(*keys).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*keys)))  # k rows
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def share_ranking(df: DataFrame, by: Sequence[str], metric: str, k: int) -> DataFrame:
    """Sums per key with their share of the total before the cut, and the rank; the greatest k."""
    sums = df.groupBy(*by).agg(safe_sum(metric).alias(metric))
    total = df.agg(safe_sum(metric).alias("__total"))
    shared = sums.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col(metric), F.col("__total"))).drop("__total")
    return top_k(shared, metric, k, ties=by, rank="rank")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def children(df: DataFrame, geoid: str, parent: str) -> DataFrame:
    """Rows whose code begins with a parent's, without the parent itself."""
    return df.filter(F.col(geoid).startswith(parent) & (F.col(geoid) != parent))


def latest_by(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("__row")).select(*key, *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*df.columns)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """(ids, variable, value) rows of the given, or all other numeric, columns."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    values = list(values) if values is not None else [c for c, t in df.dtypes if c not in ids and (t in numeric or t.startswith("decimal"))]
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(ids), values, "variable", "value")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master a new one where that is unset, elsewhere that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder: what reads it twice, as row numbers are, reads the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components_of(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) with the least node of each component, by alternating stars; checkpointed each round.

    Larger neighbours go to the least one, then all but the least to that: rounds grow with the logarithm of the component.
    Raises if so many rounds aren't enough.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = pinned(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x is not null").distinct())
    now = pinned(both.filter("x > y"))
    for _ in range(rounds):
        around = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = pinned(around.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        then = pinned(large.join(least, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).distinct())
        moved = then.exceptAll(now).limit(1).count() or now.exceptAll(then).limit(1).count()
        now = then
        if not moved:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return both.select(F.col("x").alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
