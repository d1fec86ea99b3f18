"""Joins by place: cells make an equality, exact predicates decide.

Geometries are dealt to the cells of a square grid that their boxes meet, and meet in a join on the cell. A pair of boxes
meets in several cells and is kept in the first, so nothing has to be deduplicated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import ratio, require, safe_sum
from ..functions import encoding
from ..functions import geometry as g
from ..functions.relate import relation

PREDICATES = ("intersects", "contains", "within", "touches", "crosses", "overlaps")


def _cells(df: DataFrame, size: float, prefix: str) -> DataFrame:
    """df with a row for each cell (cx, cy) that its box meets, and the first cell of the box."""
    b = F.col(f"{prefix}box")
    lo = lambda k: F.floor(b[k] / size)
    return (
        df.withColumn(f"{prefix}cx", lo("xmin")).withColumn(f"{prefix}cy", lo("ymin"))
        .withColumn("cx", F.explode(F.sequence(lo("xmin"), lo("xmax"))))
        .withColumn("cy", F.explode(F.sequence(lo("ymin"), lo("ymax"))))
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, geometry: str, how: str = "inner", size: float = 1.0) -> DataFrame:
    """Points with the columns of each polygon that covers them, edges included; ``left`` keeps the others, too.

    Columns that both have get _left and _right. Points need no shuffle of their geometry: the cell is arithmetic.
    """
    require(points, x, y)
    require(polygons, geometry)
    both = set(points.columns) & set(polygons.columns)
    a = points.select([F.col(f"`{c}`").alias(f"{c}_left" if c in both else c) for c in points.columns])
    px, py = (F.col(f"{c}_left" if c in both else c).cast("double") for c in (x, y))
    names = [f"{c}_right" if c in both else c for c in polygons.columns]
    b = polygons.toDF(*names).withColumn("__box", g.bbox(f"{geometry}_right" if geometry in both else geometry)).withColumn("__rings", g.rings(f"{geometry}_right" if geometry in both else geometry))
    b = _cells(b, size, "__").drop("__cx", "__cy")
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left: {how!r}")
    # a point is in one cell, so the outer join needs nothing but the predicate
    a = a.withColumn("__px", F.floor(px / size)).withColumn("__py", F.floor(py / size))
    box = px.between(F.col("__box.xmin"), F.col("__box.xmax")) & py.between(F.col("__box.ymin"), F.col("__box.ymax"))
    met = a.join(b, (F.col("__px") == F.col("cx")) & (F.col("__py") == F.col("cy")) & box & g.covers(F.col("__rings"), px, py), how)
    return met.select(*(F.col(f"`{c}`") for c in a.columns if c not in ("__px", "__py")), *(F.col(f"`{c}`") for c in names))


def assign(points: DataFrame, layers: dict[str, tuple[DataFrame, str, Sequence[str]]], x: str, y: str, size: float = 1.0) -> DataFrame:
    """Points with columns of each layer, prefixed by its name; of several polygons that cover a point the first by those columns."""
    out = points.withColumn("__p", F.monotonically_increasing_id())
    for name, (polygons, geometry, columns) in layers.items():
        layer = polygons.select(F.col(geometry).alias("__g"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        hit = points_in_polygons(out, layer, x, y, "__g", "left", size).drop("__g")
        first = Window.partitionBy("__p").orderBy(*(F.col(f"{name}_{c}").asc_nulls_last() for c in columns))
        out = hit.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    return out.drop("__p")


def polygon_pairs(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, predicate: str = "intersects", size: float = 1.0) -> DataFrame:
    """Pairs of polygons for which a predicate holds, with the area they share; columns that both have get _left and _right."""
    if predicate not in PREDICATES:
        raise ValueError(f"predicate is none of {PREDICATES}: {predicate!r}")
    both = set(left.columns) & set(right.columns)
    a = left.toDF(*(f"{c}_left" if c in both else c for c in left.columns))
    b = right.toDF(*(f"{c}_right" if c in both else c for c in right.columns))
    ga, gb = f"{left_geometry}_left" if left_geometry in both else left_geometry, f"{right_geometry}_right" if right_geometry in both else right_geometry
    names = [*a.columns, *b.columns]
    met = _cells(a.withColumn("__abox", g.bbox(ga)), size, "__a").join(_cells(b.withColumn("__bbox", g.bbox(gb)), size, "__b"), ["cx", "cy"])
    met = met.filter((F.col("cx") == F.greatest("__acx", "__bcx")) & (F.col("cy") == F.greatest("__acy", "__bcy")))
    p, q = F.col("__abox"), F.col("__bbox")
    met = met.filter((p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"]))
    met = met.select(*names, g.shared_area(F.col(ga), F.col(gb)).alias("shared_area"), g.area(ga).alias("__aa"), g.area(gb).alias("__ba"), g.edges_meet(F.col(ga), F.col(gb)).alias("__meet"))
    s, eps = F.col("shared_area"), 1e-9
    some = s > eps * F.least("__aa", "__ba")
    hold = {
        "intersects": some | F.col("__meet"),
        "contains": some & (s >= F.col("__ba") * (1 - eps)),
        "within": some & (s >= F.col("__aa") * (1 - eps)),
        "touches": ~some & F.col("__meet"),
        "overlaps": some & (s < F.col("__aa") * (1 - eps)) & (s < F.col("__ba") * (1 - eps)),
        "crosses": F.lit(False),  # two areas never cross
    }[predicate]
    return met.filter(hold).drop("__aa", "__ba", "__meet")


def _levels(df: DataFrame, size: float, top: int) -> DataFrame:
    """df with the level of its box: 0 for sides up to ``size``, one more for each factor of four, so that it meets four cells at most."""
    b = F.col("__box")
    side = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) / size
    level = sum((F.when(side > 4.0**k, 1).otherwise(0) for k in range(top)), F.lit(0))
    return df.filter(b["xmin"].isNotNull()).withColumn("__own", level)


def _met(a: DataFrame, b: DataFrame, size: float, top: int) -> DataFrame:
    """Pairs of rows whose boxes meet, each once: they are looked for on the coarser level of the two.

    On a level, those of it meet those up to it, so many small boxes never meet each other on a coarse level.
    """

    def dealt(df: DataFrame, upward: bool, prefix: str, beyond: int = 0) -> DataFrame:
        level = F.explode(F.sequence(F.col("__own") + beyond, F.lit(top))) if upward else F.col("__own")
        df = df if not beyond else df.filter(F.col("__own") < top)
        df = df.withColumn("level", level).withColumn("__side", F.lit(size) * F.pow(F.lit(4.0), F.col("level")))
        at = lambda c: F.floor(F.col("__box")[c] / F.col("__side"))
        df = df.withColumn("cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("cy", F.explode(F.sequence(at("ymin"), at("ymax"))))
        df = df.withColumn("__fx", at("xmin")).withColumn("__fy", at("ymin")).drop("__own", "__side")
        return df.withColumnsRenamed({"__box": f"__{prefix}box", "__fx": f"__{prefix}fx", "__fy": f"__{prefix}fy"})

    own_a = dealt(a, False, "a").join(dealt(b, True, "b"), ["level", "cx", "cy"])
    own_b = dealt(a, True, "a", 1).join(dealt(b, False, "b"), ["level", "cx", "cy"])
    both = own_a.unionByName(own_b).filter((F.col("cx") == F.greatest("__afx", "__bfx")) & (F.col("cy") == F.greatest("__afy", "__bfy")))
    p, q = F.col("__abox"), F.col("__bbox")
    both = both.filter((p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"]))
    return both.drop("level", "cx", "cy", "__afx", "__afy", "__bfx", "__bfy", "__abox", "__bbox")


def holds(predicate: str, r: Column) -> Column:
    """Whether a predicate holds by the facts of ``relate.relation``; points, lines and areas alike."""
    inner, lower, higher = r["inner"] >= 0, r["a_dim"] < r["b_dim"], r["a_dim"] > r["b_dim"]
    return {
        "intersects": r["meet"],
        "contains": inner & ~r["b_out"],
        "within": inner & ~r["a_out"],
        "touches": r["meet"] & ~inner,
        "crosses": F.when(lower, inner & r["a_out"]).when(higher, inner & r["b_out"]).otherwise((r["a_dim"] == 1) & (r["inner"] == 0)),
        "overlaps": (r["a_dim"] == r["b_dim"]) & (r["inner"] == r["a_dim"]) & r["a_out"] & r["b_out"],
    }[predicate]


def spatial_join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, predicate: str = "intersects", how: str = "inner", size: float | None = None) -> DataFrame:
    """Rows whose geometries, points, lines or areas, stand in a relation; ``how`` is inner, left, right, outer or full.

    Columns that both have get _left and _right. Null and empty geometries, and kinds that aren't known, meet nothing.
    ``size`` is the side of the least cells; without it, it is the mean side of the boxes, from one aggregate of each side.
    Other than inner, both sides are written to the shared folder first, so that their row numbers stay.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"predicate is none of {PREDICATES}: {predicate!r}")
    if how not in ("inner", "left", "right", "outer", "full"):
        raise ValueError(f"how is inner, left, right, outer or full: {how!r}")
    from .relational import pinned

    require(left, left_geometry)
    require(right, right_geometry)
    both = set(left.columns) & set(right.columns)
    a = left.toDF(*(f"{c}_left" if c in both else c for c in left.columns))
    b = right.toDF(*(f"{c}_right" if c in both else c for c in right.columns))
    names = [*a.columns, *b.columns]
    ga, gb = f"{left_geometry}_left" if left_geometry in both else left_geometry, f"{right_geometry}_right" if right_geometry in both else right_geometry
    if how != "inner":
        a, b = (pinned(df.withColumn(k, F.monotonically_increasing_id())) for df, k in ((a, "__a"), (b, "__b")))
    p = (a if how == "inner" else a.select("__a", ga)).withColumn("__box", g.bbox(ga))
    q = (b if how == "inner" else b.select("__b", gb)).withColumn("__box", g.bbox(gb))
    x = F.col("__box")
    side = F.greatest(x["xmax"] - x["xmin"], x["ymax"] - x["ymin"])
    known = [df.agg(F.avg(side), F.max(side)).first() for df in (p, q)]
    if size is None:
        size = max((k[0] or 0.0 for k in known), default=0.0) or 1.0
    widest = max(k[1] or 0.0 for k in known)
    top = 0
    while size * 4.0**top < widest:
        top += 1
    met = _met(_levels(p, size, top), _levels(q, size, top), size, top)
    met = met.withColumn("__r", relation(F.col(ga), F.col(gb))).filter(holds(predicate, F.col("__r"))).drop("__r")
    if how == "inner":
        return met.select(*(F.col(f"`{c}`") for c in names))
    link = met.select("__a", "__b")
    if how == "right":
        out = b.join(link, "__b", "left").join(a, "__a", "left")
    else:
        out = a.join(link, "__a", "left").join(b, "__b", "left" if how == "left" else "full")
    return out.select(*(F.col(f"`{c}`") for c in names))


def apportion(source: DataFrame, target: DataFrame, source_geometry: str, target_geometry: str, target_key: str, extensive: Sequence[str] = (), intensive: Sequence[str] = (), size: float = 1.0) -> DataFrame:
    """Per target the sums of extensive values by share of the source's area, and means of intensive ones by shared area.

    Sources without area give nothing.
    """
    a = source.select(F.col(source_geometry).alias("__sg"), *(F.col(v).cast("double").alias(f"__s_{v}") for v in (*extensive, *intensive))).withColumn("__sa", g.area("__sg")).filter("__sa > 0")
    pairs = polygon_pairs(a, target.select(F.col(target_geometry).alias("__tg"), F.col(target_key)), "__sg", "__tg", size=size)
    share = F.col("shared_area") / F.col("__sa")
    return pairs.groupBy(target_key).agg(*(safe_sum(F.col(f"__s_{v}") * share).alias(v) for v in extensive), *(ratio(F.sum(F.col(f"__s_{v}") * F.col("shared_area")), F.sum("shared_area")).alias(v) for v in intensive))


def area_weights(source: DataFrame, target: DataFrame, source_key: str, target_key: str, geometry: str, size: float = 1.0) -> DataFrame:
    """(source, target, overlap_area, source_area, area_weight) of all pairs that share area: a crosswalk."""
    a = source.select(F.col(source_key).alias("source_geoid"), F.col(geometry).alias("__sg"))
    b = target.select(F.col(target_key).alias("target_geoid"), F.col(geometry).alias("__tg"))
    pairs = polygon_pairs(a, b, "__sg", "__tg", size=size).filter("shared_area > 0")
    return pairs.select("source_geoid", "target_geoid", F.col("shared_area").alias("overlap_area"), g.area("__sg").alias("source_area")).withColumn("area_weight", F.least(F.lit(1.0), ratio(F.col("overlap_area"), F.col("source_area"))))


def nearest(points: DataFrame, targets: DataFrame, x: str, y: str, tx: str, ty: str, target_key: str, k: int = 1, within: float = 1.0, id_column: str | None = None) -> DataFrame:
    """The k nearest targets of each point, ranked, within a distance; ties go to the lesser key.

    Both sides are dealt to squares of side ``within``; a point meets the targets of its own and the eight around, so no
    pair farther than two squares is looked at. Points are told apart by row, not by place.
    """
    t = targets.select(F.col(target_key).alias("target"), F.col(tx).cast("double").alias("__tx"), F.col(ty).cast("double").alias("__ty"))
    t = t.withColumn("cx", F.floor(F.col("__tx") / within)).withColumn("cy", F.floor(F.col("__ty") / within))
    p = points.withColumn("__id", F.col(id_column) if id_column else F.monotonically_increasing_id())
    around = F.sequence(F.lit(-1), F.lit(1))
    p = p.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumn("cx", F.floor(F.col(x) / within) + F.col("__dx")).withColumn("cy", F.floor(F.col(y) / within) + F.col("__dy"))
    met = p.join(t, ["cx", "cy"]).withColumn("distance", g.distance(F.col(x).cast("double"), F.col(y).cast("double"), F.col("__tx"), F.col("__ty"))).filter(F.col("distance") <= within)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("__id").orderBy("distance", "target"))).filter(F.col("rank") <= k)
    return ranked.select(*points.columns, "target", "distance", "rank")


def nearest_any(points: DataFrame, targets: DataFrame, x: str, y: str, tx: str, ty: str, target_key: str, k: int = 1, start: float = 1.0, rounds: int = 12) -> DataFrame:
    """The k nearest targets without a bound: rings of growing size, for the points that have too few yet.

    A point that has met all targets is done, however few they are; the last of the rings reaches everything. Places
    that aren't finite have no distance.
    """
    from .relational import pinned

    finite = lambda *names: reduce(lambda a, b: a & b, (F.abs(F.col(n).cast("double")) < float("inf") for n in names))  # noqa: E731  false for NaN, the greatest double
    left = pinned(points.withColumn("__row", F.monotonically_increasing_id()).filter(finite(x, y)))
    targets = targets.filter(finite(tx, ty))
    box = lambda df, a, b: df.agg(*(f(F.col(c).cast("double")) for c in (a, b) for f in (F.min, F.max)), F.count("*")).first()
    p, t = box(left, x, y), box(targets, tx, ty)
    need = min(k, t[4])
    if not p[4] or not need:
        return nearest(left, targets, x, y, tx, ty, target_key, k, start, "__row").drop("__row")
    reach = 1.001 * sum(max(p[i + 1], t[i + 1]) - min(p[i], t[i]) for i in (0, 2))
    found: list[DataFrame] = []
    radius = start
    for n in range(rounds):
        if n + 1 == rounds:
            radius = max(radius, reach)
        hit = pinned(nearest(left, targets, x, y, tx, ty, target_key, k, radius, "__row"))
        full = hit.groupBy("__row").agg(F.count("*").alias("__n")).filter(F.col("__n") >= need).select("__row")
        found.append(hit.join(full, "__row", "left_semi"))
        left = pinned(left.join(full, "__row", "left_anti"))
        radius *= 4
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"points without their nearest targets are left after {rounds} rings")
    return reduce(lambda a, b: a.unionByName(b), found).drop("__row")


def within_metres(df: DataFrame, lat: str, lon: str, at: tuple[float, float], metres: float) -> DataFrame:
    """Rows within a distance on the sphere, with it; a box is cut out first, which reaches the scan.

    The box holds for latitudes from pole to pole; those beyond, which run on along the meridian, are all measured.
    """
    d, y = metres / 111_000.0 * 1.01, F.col(lat)
    near = df.filter(y.between(at[0] - d, at[0] + d) | (y < -90) | (y > 90)) if -90 <= at[0] <= 90 else df
    return near.withColumn("distance_m", g.haversine(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1]))).filter(F.col("distance_m") <= metres)


def compactness(df: DataFrame, geometry: str) -> DataFrame:
    """df with the four measures of form; empty and null geometries have 0."""
    a = df.withColumn("__a", F.coalesce(g.area(geometry), F.lit(0.0))).withColumn("__p", F.coalesce(g.perimeter(geometry), F.lit(0.0))).withColumn("__h", g.hull_facts(F.coalesce(geometry, F.lit(""))))
    circle = F.col("__h.rectangle_diagonal") * F.col("__h.rectangle_diagonal") * 0.7853981633974483
    return a.select(*df.columns, g.polsby_popper(F.col("__a"), F.col("__p")).alias("polsby_popper"), g.schwartzberg(F.col("__a"), F.col("__p")).alias("schwartzberg"), F.coalesce(ratio(F.col("__a"), F.col("__h.hull_area")), F.lit(0.0)).alias("convex_hull_ratio"), F.coalesce(ratio(F.col("__a"), circle), F.lit(0.0)).alias("reock_mrr"))


def plan_facts(df: DataFrame, plan: str, population: str, polsby: str | None = None) -> DataFrame:
    """Per plan: districts, ideal population, deviations in percent to two places, standard deviation, mean compactness."""
    p = F.col(population).cast("double")
    a = df.groupBy(plan).agg(F.count("*").alias("n_districts"), F.avg(p).alias("ideal"), F.max(p).alias("__hi"), F.min(p).alias("__lo"), F.stddev_samp(p).alias("__sd"), (F.avg(polsby) if polsby else F.lit(None).cast("double")).alias("mean_polsby_popper"))
    pct = lambda c: F.round(ratio((c - F.col("ideal")) * 100, F.col("ideal")), 2)
    return a.select(plan, "n_districts", "ideal", pct(F.col("__hi")).alias("max_deviation_pct"), pct(F.col("__lo")).alias("min_deviation_pct"), F.round(ratio((F.col("__hi") - F.col("__lo")) * 100, F.col("ideal")), 2).alias("range_pct"), F.round("__sd", 1).alias("std_population"), "mean_polsby_popper")


def profile(districts: DataFrame, units: DataFrame, district_key: str, district_geometry: str, x: str, y: str, values: Sequence[str], size: float = 1.0) -> DataFrame:
    """Sums of values of the units whose point lies in a district."""
    met = points_in_polygons(units.select(F.col(x).alias("__x"), F.col(y).alias("__y"), *values), districts.select(district_key, F.col(district_geometry).alias("__g")), "__x", "__y", "__g", size=size)
    return met.groupBy(district_key).agg(*(safe_sum(v).alias(v) for v in values))


def geojson(df: DataFrame, geometry: str, properties: Sequence[str]) -> Column:
    """A feature as JSON text: type, properties, and the coordinates of a geometry of any kind."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)) if properties else F.lit("{}"), F.lit(',"geometry":'), encoding.geojson(df[geometry]), F.lit("}"))


def adjacent_components(df: DataFrame, key: str, geometry: str, size: float = 1.0) -> DataFrame:
    """(key, component): polygons that share area or edges, directly or through others, have the least key of them."""
    from .relational import components_of

    own = df.select(F.col(key).alias("__k"), F.col(geometry).alias("__g"))
    edges = polygon_pairs(own, own, "__g", "__g", "intersects", size).filter("__k_left < __k_right").select(F.col("__k_left").alias("a"), F.col("__k_right").alias("b"))
    found = components_of(edges).select(F.col("node").alias(key), "component")
    return df.select(key).join(found, key, "left").select(key, F.coalesce("component", key).alias("component"))


def feature_collection(df: DataFrame, geometry: str, properties: Sequence[str], limit: int = 1_000_000) -> DataFrame:
    """One row: a GeoJSON collection of a bounded table's features; more than ``limit`` of them raise. ``shapes`` has lines of features."""
    f = df.select(geojson(df, geometry, properties).alias("f")).limit(limit + 1).agg(F.collect_list("f").alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array("f"), ","), F.lit("]}"))
    return f.select(F.when(F.size("f") <= limit, text).otherwise(F.raise_error(F.lit(f"more than {limit} features for one text"))).alias("geojson"))


def covering(polygons: DataFrame, geometry: str, x: float, y: float) -> DataFrame:
    """Polygons that cover one place; boxes are looked at first."""
    b = polygons.withColumn("__b", g.bbox(geometry)).filter(F.lit(x).between(F.col("__b.xmin"), F.col("__b.xmax")) & F.lit(y).between(F.col("__b.ymin"), F.col("__b.ymax")))
    return b.filter(g.covers(g.rings(geometry), F.lit(x), F.lit(y))).drop("__b")
