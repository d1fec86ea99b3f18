"""Unions of districts, locales, plans and places in relation to others."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import require, safe_sum
from ..functions import geometry as g
from ..functions.text import pad

MILE = 1609.344
#: Miles up to which a town or a rural place is fringe or distant: to an urbanized area, and for rural places to a cluster (fixed values).
TOWN_FRINGE, TOWN_DISTANT, RURAL_FRINGE, RURAL_DISTANT, CLUSTER_FRINGE, CLUSTER_DISTANT = 10.0, 35.0, 5.0, 25.0, 2.5, 10.0
#: Degrees east and north of the eight directions (fixed values).
DIRECTIONS = {"north": (0, 1), "south": (0, -1), "east": (1, 0), "west": (-1, 0), "northeast": (1, 1), "northwest": (-1, 1), "southeast": (1, -1), "southwest": (-1, -1)}


def dissolve(df: DataFrame, by: str, geometry: str, values: Sequence[str] = (), parts: int = 8) -> DataFrame:
    """The union of each group's polygons, and sums of values.

    Groups are united in parts first, so that one task has the outlines of parts before it, and not all polygons of a group.
    """
    def unite(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        first = groups.iloc[:1].copy()
        first["__g"] = g.write_wkt(g.union_rings([g.parse(w) for w in groups["__g"] if w]))
        return first[[c for c in groups.columns if c != "__part"]]

    a = df.select(F.col(by), F.col(geometry).alias("__g"), F.pmod(F.xxhash64(geometry), F.lit(parts)).alias("__part"))
    kind = df.schema[by].dataType.simpleString()
    half = a.groupBy(by, "__part").applyInPandas(unite, f"`{by}` {kind}, __g string")
    whole = half.groupBy(by).applyInPandas(unite, f"`{by}` {kind}, __g string").withColumnRenamed("__g", geometry)
    return whole.join(df.groupBy(by).agg(*(safe_sum(v).alias(v) for v in values)), by) if values else whole


def distance_to_layer(points: DataFrame, layer: DataFrame, x: str, y: str, geometry: str, most: float, output: str) -> DataFrame:
    """points with the distance to the nearest polygon, infinite beyond ``most``: boxes are widened by that and meet points in cells."""
    b = g.bbox(geometry)
    cell = lambda c: F.floor(c / most)
    wide = layer.select(g.rings(geometry).alias("__r"), b.alias("__b")).withColumn("__cx", F.explode(F.sequence(cell(F.col("__b.xmin") - most), cell(F.col("__b.xmax") + most)))).withColumn("__cy", F.explode(F.sequence(cell(F.col("__b.ymin") - most), cell(F.col("__b.ymax") + most))))
    p = points.withColumn("__id", F.monotonically_increasing_id())
    met = p.join(wide, (cell(F.col(x)) == F.col("__cx")) & (cell(F.col(y)) == F.col("__cy")), "left").withColumn("__d", F.when(F.col("__r").isNotNull(), g.distance_to(F.col("__r"), F.col(x), F.col(y))))
    near = met.withColumn("__k", F.row_number().over(Window.partitionBy("__id").orderBy(F.col("__d").asc_nulls_last()))).filter("__k = 1")
    return near.select(*(F.col(f"`{c}`") for c in points.columns), F.when(F.col("__d") <= most, F.col("__d")).otherwise(F.lit(float("inf"))).alias(output))


def locale(points: DataFrame, areas: DataFrame, clusters: DataFrame, cities: DataFrame, x: str, y: str, geometry: str = "geometry", population: str = "population") -> DataFrame:
    """points with locale_code, by the decision tree of twelve locales; coordinates are metres on a plane.

    In an urbanized area: city in a principal city, by its population, else suburb by the area's. In a cluster: town by the
    distance to an area. Else rural by both distances.
    """
    most = TOWN_DISTANT * MILE
    d = distance_to_layer(points, areas, x, y, geometry, most, "__ua")
    d = distance_to_layer(d, clusters, x, y, geometry, most, "__uc")
    from .relational import pinned
    from .spatial import points_in_polygons

    d = pinned(d.withColumn("__id", F.monotonically_increasing_id()))

    place = d.select("__id", F.col(x).alias("__x"), F.col(y).alias("__y"))
    inside = lambda layer, name: points_in_polygons(place, layer.select(F.col(geometry).alias("__g"), F.col(population).alias("__n")), "__x", "__y", "__g", size=most).groupBy("__id").agg(F.max("__n").alias(name))
    d = d.join(inside(areas, "__area"), "__id", "left").join(inside(cities, "__city"), "__id", "left")
    size = lambda n, base: F.when(n >= 250_000, base + 1).when(n >= 100_000, base + 2).otherwise(base + 3)
    ua, uc = F.col("__ua") / MILE, F.col("__uc") / MILE
    urban = F.when(F.col("__city").isNotNull(), size(F.col("__city"), 10)).otherwise(size(F.col("__area"), 20))
    town = F.when(ua <= TOWN_FRINGE, 31).when(ua <= TOWN_DISTANT, 32).otherwise(33)
    rural = F.when((ua <= RURAL_FRINGE) | (uc <= CLUSTER_FRINGE), 41).when((ua <= RURAL_DISTANT) | (uc <= CLUSTER_DISTANT), 42).otherwise(43)
    return d.select(*points.columns, F.when(F.col("__area").isNotNull(), urban).when(uc == 0, town).otherwise(rural).alias("locale_code"))


def locale_shares(districts: DataFrame, areas: DataFrame, clusters: DataFrame, key: str, geometry: str = "geometry", size: float = 1.0) -> DataFrame:
    """(key, locale_code, share) of each district's area: 21 in urbanized areas, 31 in clusters, 43 for the rest."""
    from .spatial import polygon_pairs

    own = districts.select(key, F.col(geometry).alias("__dg"), g.area(geometry).alias("__all"))

    def within(layer: DataFrame, code: int) -> DataFrame:
        pairs = polygon_pairs(own, layer.select(F.col(geometry).alias("__lg")), "__dg", "__lg", size=size)
        return pairs.groupBy(key).agg((F.sum("shared_area") / F.first("__all")).alias("share")).filter("share > 0").withColumn("locale_code", F.lit(code))

    urban = within(areas, 21).unionByName(within(clusters, 31))
    rest = own.join(urban.groupBy(key).agg(F.sum("share").alias("__s")), key, "left").select(key, F.greatest(F.lit(0.0), 1 - F.coalesce("__s", F.lit(0.0))).alias("share"), F.lit(43).alias("locale_code")).filter("share > 0")
    return urban.unionByName(rest).select(key, "locale_code", "share")


def in_relation(df: DataFrame, x: str, y: str, reference: tuple[float, float], relation: str, mode: str = "bounded", km: float = 25.0) -> DataFrame:
    """Rows that lie in a direction from a reference (longitude, latitude), or near it.

    ``bounded``: a box of twice ``km`` a side, ``km`` away that way; ``halfplane`` and ``centroid``: all on that side.
    """
    rx, ry = reference
    r = relation.lower().replace(" ", "_").removesuffix("_of")
    half_y = km / 111.32
    half_x = half_y / max(0.01, math.cos(math.radians(ry)))
    if r in ("near", "around", "close_to"):
        return df.filter(g.haversine(F.col(y), F.col(x), F.lit(ry), F.lit(rx)) <= km * 1000)
    if r not in DIRECTIONS:
        raise ValueError(f"no such relation: {relation!r}")
    dx, dy = DIRECTIONS[r]
    if mode == "bounded":
        cx, cy = rx + dx * half_x, ry + dy * half_y
        return df.filter(F.col(x).between(cx - half_x, cx + half_x) & F.col(y).between(cy - half_y, cy + half_y))
    if mode not in ("halfplane", "centroid"):
        raise ValueError(f"no such mode: {mode!r}")
    side = F.lit(True)
    if dx:
        side = side & ((F.col(x) > rx) if dx > 0 else (F.col(x) < rx))
    if dy:
        side = side & ((F.col(y) > ry) if dy > 0 else (F.col(y) < ry))
    return df.filter(side)


def plan_at(plans: DataFrame, keys: Sequence[str], when, start: str = "effective_from", end: str = "effective_to", strict: bool = False) -> DataFrame:
    """The plan of each key in force at a date: of several the latest begun, or with ``strict`` an error."""
    from .relational import valid_at

    live = valid_at(plans, when, start, end)
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = live.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(start).desc_nulls_last())))
    if strict:
        ranked = ranked.withColumn("__n", n).withColumn("__r", F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.lit("several plans are in force"))))
        return ranked.filter("__r = 1").drop("__r", "__n")
    return ranked.filter("__r = 1").drop("__r")


def link_parents(children: DataFrame, parents: DataFrame, child: str, parent: str, length: int, vintage: str = "vintage_year") -> DataFrame:
    """children with the code of the parent of the same vintage, null if there is none."""
    p = parents.select(F.col(parent).alias("parent_geoid"), F.col(vintage))
    return children.withColumn("parent_geoid", F.substring(child, 1, length)).join(p.withColumn("__there", F.lit(True)), ["parent_geoid", vintage], "left").withColumn("parent_geoid", F.when(F.col("__there"), F.col("parent_geoid"))).select(*children.columns, "parent_geoid")


def demographics(shapes: DataFrame, data: DataFrame, shape_key: str, data_key: str, how: str = "left") -> DataFrame:
    """Shapes with data of the same code, what comes before "US" in a code left out; columns that shapes have already stay theirs."""
    require(shapes, shape_key)
    require(data, data_key)
    rest = [c for c in data.columns if c not in shapes.columns and c != data_key]
    d = data.select(F.substring_index(data_key, "US", -1).alias("__k"), *rest)
    return shapes.join(d, F.col(shape_key) == F.col("__k"), how).drop("__k")


def wide_years(yearly: dict[int, DataFrame], key: str, variables: Sequence[str], name: str | None = "NAME") -> DataFrame:
    """``{variable}_{year}`` of all years side by side, and the name of the newest year that has one: one aggregate, not a join for each year."""
    from functools import reduce

    def long(year: int, df: DataFrame) -> DataFrame:
        n = F.col(name).cast("string") if name and name in df.columns else F.lit(None).cast("string")
        return df.select(key, F.lit(year).alias("__y"), n.alias("__n"), *(F.col(v).cast("double").alias(v) for v in variables))

    every = reduce(lambda a, b: a.unionByName(b), (long(y, df) for y, df in yearly.items()))
    cells = [F.max(F.when(F.col("__y") == y, F.col(v))).alias(f"{v}_{y}") for v in variables for y in sorted(yearly)]
    label = [F.max_by("__n", F.when(F.col("__n").isNotNull(), F.col("__y"))).alias(name)] if name else []
    return every.groupBy(key).agg(*label, *cells)


def census_rows(spark, text: Sequence[Sequence[str]], geography: Sequence[tuple[str, int]], values: Sequence[str]) -> DataFrame:
    """A service's array of arrays, the header first, as rows with a code of its parts and numbers; what is no number is null."""
    header, *body = text
    df = spark.createDataFrame([tuple(r) for r in body], ", ".join(f"`{h}` string" for h in header))
    return df.withColumn("GEOID", F.concat(*(pad(c, n) for c, n in geography))).withColumns({v: F.col(v).try_cast("double") for v in values})


def hexagons(df: DataFrame, x: str, y: str, radius: float, value: str | None = None) -> DataFrame:
    """Rows, and sums of a value, for each hexagon (q, r) of a radius, by rounding in cube coordinates."""
    q = (F.col(x) * (3**0.5 / 3) - F.col(y) / 3) / radius
    r = F.col(y) * 2 / 3 / radius
    s = -q - r
    a, b, c = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(a - q), F.abs(b - r), F.abs(c - s)
    qi = F.when((dq > dr) & (dq > ds), -b - c).otherwise(a)
    ri = F.when((dr >= dq) & (dr > ds), -a - c).otherwise(b)
    return df.select(qi.cast("long").alias("q"), ri.cast("long").alias("r"), *([value] if value else [])).groupBy("q", "r").agg(F.count("*").alias("n"), *([safe_sum(value).alias(value)] if value else []))


def summary_text(df: DataFrame, metric: str, name: str) -> DataFrame:
    """One row of text: total, mean and the leading name."""
    one: Column = F.concat(F.lit("Total "), F.format_number(safe_sum(metric), 0), F.lit(", average "), F.format_number(F.avg(metric), 1), F.lit(", leading "), F.max_by(name, metric))
    return df.groupBy(name).agg(safe_sum(metric).alias(metric)).agg(one.alias("summary"))
