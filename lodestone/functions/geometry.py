"""Planar geometry on WKT, as Column expressions; overlays and hulls in Arrow batches.

A polygon is its rings, arrays of (x, y). Inside is where a ray crosses all rings an odd number of times, which serves
holes and multipolygons alike. Overlay areas are exact for any simple polygons, by slabs between vertices and crossings.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c

EARTH_M = 6_371_008.8


def point(x: Column | str, y: Column | str) -> Column:
    """POINT text of longitude and latitude; null if either is."""
    return F.concat(F.lit("POINT ("), _c(x).cast("string"), F.lit(" "), _c(y).cast("string"), F.lit(")"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)), F.lit("))"))


def _xy(t: Column) -> Column:
    a = F.split(F.trim(t), r"\s+")
    return F.struct(F.get(a, F.lit(0)).try_cast("double").alias("x"), F.get(a, F.lit(1)).try_cast("double").alias("y"))


def xy(wkt: Column | str) -> Column:
    """The coordinates of a point."""
    return _xy(F.regexp_extract(_c(wkt), r"\(([^()]+)\)", 1))


def rings(wkt: Column | str) -> Column:
    """All rings, or the one line, of a geometry."""
    return F.transform(F.regexp_extract_all(_c(wkt), F.lit(r"\(([^()]+)\)"), 1), lambda r: F.transform(F.split(r, ","), _xy))


def polygons(wkt: Column | str) -> Column:
    """The rings of each polygon of a multipolygon."""
    each = F.regexp_extract_all(_c(wkt), F.lit(r"(\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\))"), 1)
    return F.transform(each, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\(([^()]+)\)"), 1), lambda r: F.transform(F.split(r, ","), _xy)))


def _fold(ring: Column, f) -> Column:
    """Sum of f(p, q) over the edges of a ring."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.coalesce(f(F.get(ring, i - 1), F.get(ring, i)), F.lit(0.0)))


def ring_area(ring: Column) -> Column:
    return F.abs(_fold(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def area(wkt: Column | str) -> Column:
    """Area of (multi)polygons: outer rings less holes; 0 for what has none."""
    first = lambda p: ring_area(F.get(p, F.lit(0)))
    all_of = lambda p: F.aggregate(p, F.lit(0.0), lambda s, r: s + ring_area(r))
    return F.aggregate(polygons(wkt), F.lit(0.0), lambda s, p: s + 2 * first(p) - all_of(p))


def perimeter(wkt: Column | str) -> Column:
    """Length of all rings, or of a line."""
    return F.aggregate(rings(wkt), F.lit(0.0), lambda s, r: s + _fold(r, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def bbox(wkt: Column | str) -> Column:
    """Struct xmin, ymin, xmax, ymax."""
    p = F.flatten(rings(wkt))
    x, y = F.transform(p, lambda a: a["x"]), F.transform(p, lambda a: a["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def centroid(wkt: Column | str) -> Column:
    """Struct x, y of the first ring's centre of mass."""
    r = F.get(rings(wkt), F.lit(0))
    a = _fold(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2
    cx = _fold(r, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    cy = _fold(r, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    return F.struct(F.try_divide(cx, 6 * a).alias("x"), F.try_divide(cy, 6 * a).alias("y"))


def covers(ring_list: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside rings or on their edge."""

    def crosses(p: Column, q: Column) -> Column:
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1.0).otherwise(0.0)

    def on(p: Column, q: Column) -> Column:
        flat = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return F.when(flat & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])), 1.0).otherwise(0.0)

    total = lambda f: F.aggregate(ring_list, F.lit(0.0), lambda s, r: s + _fold(r, f))
    return (total(crosses) % 2 == 1) | (total(on) > 0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h < 0, 0.0).when(h > 1, 1.0).otherwise(h)))  # rounding leads beyond; null stays null


def polsby_popper(a: Column, p: Column) -> Column:
    """4 pi area over squared perimeter; 0 without one."""
    return F.coalesce(F.try_divide(4 * math.pi * a, p * p), F.lit(0.0))


def schwartzberg(a: Column, p: Column) -> Column:
    """Circumference of the circle of equal area over the perimeter; 0 without one."""
    return F.coalesce(F.try_divide(2 * F.sqrt(math.pi * a), p), F.lit(0.0))


def to_mercator(x: Column, y: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    r = 6_378_137.0
    return F.struct((F.radians(x) * r).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * r).alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    r = 6_378_137.0
    return F.struct(F.degrees(x / r).alias("x"), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2).alias("y"))


def axial_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Steps between hexagons in axial coordinates."""
    return ((F.abs(q1 - q2) + F.abs(q1 + r1 - q2 - r2) + F.abs(r1 - r2)) / 2).cast("long")


def valid_position(lat: Column | str, lon: Column | str) -> Column:
    """Whether both are there and within the globe; never null."""
    return F.coalesce(_c(lat).between(-90, 90) & _c(lon).between(-180, 180), F.lit(False))


def bbox_text(c: Column | str) -> Column:
    """Struct of "[minlat, maxlat, minlon, maxlon]" text, with the array (minlon, minlat, maxlon, maxlat)."""
    p = F.split(F.translate(_c(c), "[] '\"", ""), ",")
    n = [F.get(p, F.lit(i)).try_cast("double") for i in range(4)]
    return F.struct(n[0].alias("min_lat"), n[1].alias("max_lat"), n[2].alias("min_lon"), n[3].alias("max_lon"), F.array(n[2], n[0], n[3], n[1]).alias("bbox"))


# What follows works on Python lists, in Arrow batches.

Ring = list[tuple[float, float]]


def parse(wkt: str | None) -> list[Ring]:
    if not wkt:
        return []
    return [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", wkt)]


def _sections(edges: list[tuple[float, float, float, float]], x: float) -> list[float]:
    return sorted(y0 + (x - x0) / (x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in edges if min(x0, x1) < x < max(x0, x1))


def _edges(rs: list[Ring]) -> list[tuple[float, float, float, float]]:
    return [(*p, *q) for r in rs for p, q in zip(r, r[1:], strict=False) if p != q]


def overlap_area(a: list[Ring], b: list[Ring]) -> float:
    """Area that two even-odd polygons share: between two cuts their sections change in a straight line."""
    ea, eb = _edges(a), _edges(b)
    if not ea or not eb:
        return 0.0
    cuts = {x for e in ea + eb for x in (e[0], e[2])}
    for x0, y0, x1, y1 in ea:
        for u0, v0, u1, v1 in eb:
            d = (x1 - x0) * (v1 - v0) - (y1 - y0) * (u1 - u0)
            if d:
                t = ((u0 - x0) * (v1 - v0) - (v0 - y0) * (u1 - u0)) / d
                s = ((u0 - x0) * (y1 - y0) - (v0 - y0) * (x1 - x0)) / d
                if 0 <= t <= 1 and 0 <= s <= 1:
                    cuts.add(x0 + t * (x1 - x0))
    xs, total = sorted(cuts), 0.0
    for l, r in zip(xs, xs[1:], strict=False):
        m = (l + r) / 2
        sa, sb = _sections(ea, m), _sections(eb, m)
        if sa and sb:
            shared = sum(max(0.0, min(sa[i + 1], sb[j + 1]) - max(sa[i], sb[j])) for i in range(0, len(sa) - 1, 2) for j in range(0, len(sb) - 1, 2))
            total += shared * (r - l)
    return total


def touching(a: list[Ring], b: list[Ring]) -> bool:
    """Whether edges of two geometries meet."""

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def within(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    for x0, y0, x1, y1 in _edges(a):
        for u0, v0, u1, v1 in _edges(b):
            p, q, r, s = (x0, y0), (x1, y1), (u0, v0), (u1, v1)
            d1, d2, d3, d4 = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
            if d1 * d2 < 0 and d3 * d4 < 0 or d1 == 0 and within(p, q, r) or d2 == 0 and within(p, q, s) or d3 == 0 and within(r, s, p) or d4 == 0 and within(r, s, q):
                return True
    return False


def hull(points: Ring) -> Ring:
    """Convex hull, closed."""
    ps = sorted(set(points))
    if len(ps) < 3:
        return ps + ps[:1]
    out: Ring = []
    for part in (ps, ps[::-1]):
        start = len(out)
        for p in part:
            while len(out) >= start + 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        out.pop()
    return out + out[:1]


def shoelace(r: Ring) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))) / 2


@F.pandas_udf(T.DoubleType())
def shared_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(parse(x), parse(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def edges_meet(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([touching(parse(x), parse(y)) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(T.StructType([T.StructField("hull_area", T.DoubleType()), T.StructField("rectangle_diagonal", T.DoubleType())]))
def hull_facts(wkt: pd.Series) -> pd.DataFrame:
    """Area of the convex hull, and the diagonal of the least rotated rectangle around it."""
    areas, diagonals = [], []
    for w in wkt:
        h = hull([p for r in parse(w) for p in r])
        best = (math.inf, 0.0)
        for (x0, y0), (x1, y1) in zip(h, h[1:], strict=False):
            n = math.hypot(x1 - x0, y1 - y0)
            if n:
                c, s = (x1 - x0) / n, (y1 - y0) / n
                us, vs = [x * c + y * s for x, y in h], [y * c - x * s for x, y in h]
                wide, high = max(us) - min(us), max(vs) - min(vs)
                best = min(best, (wide * high, math.hypot(wide, high)))
        areas.append(shoelace(h))
        diagonals.append(best[1])
    return pd.DataFrame({"hull_area": areas, "rectangle_diagonal": diagonals})


@F.pandas_udf(T.StringType())
def buffer_point(wkt: pd.Series, radius: pd.Series) -> pd.Series:
    """A circle of 32 corners around a point, eight for each quarter."""

    def one(w: str | None, r: float) -> str | None:
        m = re.search(r"\(\s*([-\d.eE+]+)\s+([-\d.eE+]+)", w or "")
        if not m:
            return None
        x, y = float(m[1]), float(m[2])
        ps = [(x + r * math.cos(k * math.pi / 16), y - r * math.sin(k * math.pi / 16)) for k in range(32)]
        return "POLYGON ((" + ", ".join(f"{a!r} {b!r}" for a, b in [*ps, ps[0]]) + "))"

    return pd.Series([one(w, r) for w, r in zip(wkt, radius, strict=True)], dtype="object")


def union_rings(shapes: list[list[Ring]]) -> list[Ring]:
    """Rings around the union of polygons: of all edges, cut where they meet, those with the union on one side only.

    Outer rings turn left, holes right.
    """
    edges = [e for s in shapes for e in _edges(s)]
    boxes = [(min(p[0] for r in s for p in r), min(p[1] for r in s for p in r), max(p[0] for r in s for p in r), max(p[1] for r in s for p in r)) if any(s) else None for s in shapes]

    def inside(x: float, y: float) -> bool:
        for s, b in zip(shapes, boxes, strict=True):
            if b and b[0] <= x <= b[2] and b[1] <= y <= b[3]:
                hits = sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) for x0, y0, x1, y1 in _edges(s))
                if hits % 2:
                    return True
        return False

    kept: dict[tuple, tuple] = {}
    for x0, y0, x1, y1 in edges:
        cuts = {0.0, 1.0}
        n2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        for u0, v0, u1, v1 in edges:
            d = (x1 - x0) * (v1 - v0) - (y1 - y0) * (u1 - u0)
            if d:
                t = ((u0 - x0) * (v1 - v0) - (v0 - y0) * (u1 - u0)) / d
                s = ((u0 - x0) * (y1 - y0) - (v0 - y0) * (x1 - x0)) / d
                if -1e-12 <= s <= 1 + 1e-12 and 0 < t < 1:
                    cuts.add(t)
            elif (u0 - x0) * (y1 - y0) == (v0 - y0) * (x1 - x0):
                cuts |= {t for t in (((u - x0) * (x1 - x0) + (v - y0) * (y1 - y0)) / n2 for u, v in ((u0, v0), (u1, v1))) if 0 < t < 1}
        ts = sorted(cuts)
        length = math.sqrt(n2)
        for a, b in zip(ts, ts[1:], strict=False):
            if (b - a) * length < 1e-12:
                continue
            p, q = ((round(x0 + t * (x1 - x0), 9), round(y0 + t * (y1 - y0), 9)) for t in (a, b))
            m, e = (a + b) / 2, 1e-7 * max(1.0, length)
            mx, my, nx, ny = x0 + m * (x1 - x0), y0 + m * (y1 - y0), -(y1 - y0) / length * e, (x1 - x0) / length * e
            left, right = inside(mx + nx, my + ny), inside(mx - nx, my - ny)
            if left != right:
                kept[(p, q) if left else (q, p)] = ()
    following: dict[tuple, list[tuple]] = {}
    for p, q in kept:
        following.setdefault(p, []).append(q)
    out: list[Ring] = []
    for p in list(following):
        while following.get(p):
            ring = [p]
            while following.get(ring[-1]):
                ring.append(following[ring[-1]].pop())
                if ring[-1] == p:
                    break
            if len(ring) > 3 and ring[-1] == p:
                out.append(ring)
    return out


def write_wkt(rs: list[Ring]) -> str:
    """POLYGON or MULTIPOLYGON of oriented rings; a hole goes to the smallest outer ring around it."""
    signed = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False)) / 2
    outer = sorted((r for r in rs if signed(r) > 0), key=shoelace)
    holes: dict[int, list[Ring]] = {}
    for h in (r for r in rs if signed(r) < 0):
        x, y = (h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2
        for k, o in enumerate(outer):
            if sum((b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b) for a, b, c, d in _edges([o])) % 2:
                holes.setdefault(k, []).append(h)
                break
    text = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")"
    parts = ["(" + ", ".join(map(text, [o, *holes.get(k, [])])) + ")" for k, o in enumerate(outer)]
    return "POLYGON EMPTY" if not parts else f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def distance_to(ring_list: Column, x: Column, y: Column) -> Column:
    """Distance of a point to rings: 0 inside closed ones, else to the nearest edge; what isn't closed is a line, or a place."""

    def edge(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    def nearest(r: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), F.lit(float("inf")), lambda s, i: F.least(s, F.coalesce(edge(F.get(r, i - 1), F.coalesce(F.get(r, i), F.get(r, i - 1))), F.lit(float("inf")))))

    closed = F.filter(ring_list, lambda r: (F.size(r) > 3) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    return F.when(covers(closed, x, y), 0.0).otherwise(F.aggregate(ring_list, F.lit(float("inf")), lambda s, r: F.least(s, nearest(r))))


def distance_from(wkt: Column | str, x: Column, y: Column) -> Column:
    """Distance of a point to a geometry of any kind: lines have no inside, closed or not; null for what is empty."""
    kind, r = F.upper(F.regexp_extract(_c(wkt), r"^\s*([A-Za-z]+)", 1)), rings(wkt)
    places = F.transform(F.flatten(r), lambda p: F.array(p))
    segments = F.flatten(F.transform(r, lambda l: F.transform(F.sequence(F.lit(1), F.greatest(F.size(l) - 1, F.lit(1))), lambda i: F.array(F.get(l, i - 1), F.coalesce(F.get(l, i), F.get(l, i - 1))))))
    parts = F.when(kind.endswith("POINT"), places).when(kind.endswith("LINESTRING"), segments).otherwise(r)
    return F.when(F.size(r) > 0, distance_to(parts, x, y))


def payload(wkt: Column | str, crs: str = "EPSG:4326") -> Column:
    """Struct wkt, geojson, crs and type of a point or polygon."""
    kind = F.upper(F.regexp_extract(_c(wkt), r"^\s*([A-Za-z]+)", 1))
    p = xy(wkt)
    rings_ = F.transform(rings(wkt), lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"])))
    many = F.transform(polygons(wkt), lambda s: F.transform(s, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    body = F.when(kind == "POINT", F.to_json(F.struct(F.lit("Point").alias("type"), F.array(p["x"], p["y"]).alias("coordinates")))).when(kind == "MULTIPOLYGON", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), many.alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("Polygon").alias("type"), rings_.alias("coordinates"))))
    return F.when(_c(wkt).isNotNull(), F.struct(_c(wkt).alias("wkt"), body.alias("geojson"), F.lit(crs).alias("crs"), kind.alias("type")))


@F.pandas_udf(T.StringType())
def buffer(wkt: pd.Series, radius: pd.Series) -> pd.Series:
    """A geometry with all within a distance of it: the union of the polygon, a box along each edge, and a circle at each corner."""

    def circle(x: float, y: float, r: float) -> list[Ring]:
        ps = [(x + r * math.cos(k * math.pi / 16), y + r * math.sin(k * math.pi / 16)) for k in range(32)]
        return [[*ps, ps[0]]]

    def one(w: str | None, r: float | None) -> str | None:
        rs = parse(w)
        if not rs or r is None or r <= 0:
            return w
        shapes = [rs] if w.lstrip().upper().startswith(("POLYGON", "MULTIPOLYGON")) else []
        for x0, y0, x1, y1 in _edges(rs):
            n = math.hypot(x1 - x0, y1 - y0)
            dx, dy = -(y1 - y0) / n * r, (x1 - x0) / n * r
            shapes.append([[(x0 + dx, y0 + dy), (x0 - dx, y0 - dy), (x1 - dx, y1 - dy), (x1 + dx, y1 + dy), (x0 + dx, y0 + dy)]])
        shapes += [circle(x, y, r) for x, y in {p for ring in rs for p in ring}]
        return write_wkt(union_rings(shapes))

    return pd.Series([one(w, r) for w, r in zip(wkt, radius, strict=True)], dtype="object")
