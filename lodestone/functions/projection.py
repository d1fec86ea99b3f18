"""Projections between geographic coordinates and planes: Mercator of the web, UTM and Albers conic, by published series.

Each formula is written once, for numpy arrays and for Columns: both have functions of the same names. Geographic systems
of WGS 84 and NAD 83 are taken as one, which differ by less than two metres; other datums aren't known, and raise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..compat import require

# fixed values: half axis and flattening of ellipsoids; standard parallels and origin of conic systems (degrees)
WGS84, GRS80 = (6_378_137.0, 1 / 298.257223563), (6_378_137.0, 1 / 298.257222101)
ALBERS = {"EPSG:5070": (29.5, 45.5, 23.0, -96.0), "EPSG:3338": (55.0, 65.0, 50.0, -154.0), "ESRI:102003": (29.5, 45.5, 37.5, -96.0)}
GEOGRAPHIC = {"EPSG:4326", "EPSG:4269"}
SETTING = "spark.lodestone.crs"

Pair = tuple
Way = Callable[..., Pair]


def _around(m, lon):
    """A longitude within the globe; 180 and -180 stay what they are, also with the error of a rounding."""
    return lon - m.rint(lon * ((1 - 1e-12) / 360)) * 360


def _utm(ellipsoid: tuple[float, float], zone: int, south: bool) -> tuple[Way, Way]:
    """Krüger's series to the fourth power of n: exact to less than a millimetre within 3,000 km of the meridian."""
    a, f = ellipsoid
    n = f / (2 - f)
    e = 2 * math.sqrt(n) / (1 + n)
    scale = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    meridian, north = math.radians(zone * 6 - 183), 10_000_000.0 if south else 0.0

    def forward(m, x, y):
        s, l = m.sin(m.radians(y)), m.radians(x) - meridian
        t = m.sinh(m.atanh(s) - m.atanh(s * e) * e)
        xi, eta = m.atan2(t, m.cos(l)), m.atanh(m.sin(l) / m.sqrt(t * t + 1))
        east = eta + sum(m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * c for k, c in enumerate(alpha, 1))
        up = xi + sum(m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * c for k, c in enumerate(alpha, 1))
        return east * scale + 500_000.0, up * scale + north

    def back(m, x, y):
        eta, xi = (x - 500_000.0) / scale, (y - north) / scale
        u = xi - sum(m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * c for k, c in enumerate(beta, 1))
        v = eta - sum(m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * c for k, c in enumerate(beta, 1))
        conformal = m.asinh(m.sin(u) / m.sqrt(m.sinh(v) * m.sinh(v) + m.cos(u) * m.cos(u)))
        s = m.tanh(conformal)
        for _ in range(6):  # each step brings the error down by the squared eccentricity
            s = m.tanh(conformal + m.atanh(s * e) * e)
        return _around(m, m.degrees(m.atan2(m.sinh(v), m.cos(u)) + meridian)), m.degrees(m.asin(s))

    return forward, back


def albers(ellipsoid: tuple[float, float], first: float, second: float, lat: float, lon: float) -> tuple[Way, Way]:
    """The conic projection of equal areas with two standard parallels."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(m, s):
        return (s / (1 - s * s * e2) + m.atanh(s * e) / e) * (1 - e2)

    s1, s2, s0 = (math.sin(math.radians(p)) for p in (first, second, lat))
    m1, m2 = ((1 - s * s) / (1 - e2 * s * s) for s in (s1, s2))  # squares
    n = s1 if first == second else float((m1 - m2) / (q(np, s2) - q(np, s1)))
    c = float(m1 + n * q(np, s1))
    rho0, lon0 = a * math.sqrt(c - n * float(q(np, s0))) / n, math.radians(lon)

    def forward(m, x, y):
        rho, theta = m.sqrt(c - q(m, m.sin(m.radians(y))) * n) * (a / n), m.radians(_around(m, x - lon)) * n
        return rho * m.sin(theta), rho0 - rho * m.cos(theta)

    def back(m, x, y):
        up = rho0 - y
        rho = m.sqrt(x * x + up * up)
        goal = (c - rho * rho * (n * n / (a * a))) / n
        phi = m.asin(goal / 2)
        for _ in range(8):
            s = m.sin(phi)
            w = 1 - s * s * e2
            phi = phi + w * w / (m.cos(phi) * 2) * (goal / (1 - e2) - s / w - m.atanh(s * e) / e)
        turn = math.copysign(1.0, n)
        return _around(m, m.degrees(m.atan2(x * turn, up * turn) / n + lon0)), m.degrees(phi)

    return forward, back


def _mercator() -> tuple[Way, Way]:
    r = WGS84[0]
    return (lambda m, x, y: (m.radians(x) * r, m.asinh(m.tan(m.radians(y))) * r)), (lambda m, x, y: (m.degrees(x / r), m.degrees(m.atan(m.sinh(y / r)))))


def system(code: str) -> tuple[Way, Way]:
    """From longitude and latitude to a system, and back; unknown ones raise."""
    code = code.upper().strip()
    utm = re.fullmatch(r"EPSG:(326|327|269)(\d\d)", code)
    if code in GEOGRAPHIC:
        return (lambda m, x, y: (x, y)), (lambda m, x, y: (x, y))
    if code == "EPSG:3857":
        return _mercator()
    if utm and 1 <= int(utm[2]) <= (23 if utm[1] == "269" else 60):
        return _utm(GRS80 if utm[1] == "269" else WGS84, int(utm[2]), utm[1] == "327")
    if code in ALBERS:
        return albers(GRS80, *ALBERS[code])
    raise ValueError(f"a system that isn't known: {code}")


def project(x: Column, y: Column, code: str) -> Column:
    """Struct x, y of longitude and latitude in a system, without leaving the JVM."""
    east, north = system(code)[0](F, x.cast("double"), y.cast("double"))
    return F.struct(east.alias("x"), north.alias("y"))


def utm_code(x: Column, y: Column) -> Column:
    """The code of the UTM zone of a place; the widened zones of Norway and Svalbard aren't observed."""
    zone = F.least(F.floor((x + 180) / 6) + 1, F.lit(60))
    return F.concat(F.when(y < 0, "EPSG:327").otherwise("EPSG:326"), F.lpad(zone.cast("string"), 2, "0"))


def moved(wkt: pd.Series, source: str, target: str) -> pd.Series:
    """WKT with each place brought from a system to another, heights dropped; null where a place has no finite image.

    Text that says by ``SRID=`` that it is in the target stays; with another number there it must be the source's.
    """
    back, forward = system(source)[1], system(target)[0]
    same = lambda a, b: a.upper().strip() == b.upper().strip()
    number = r"(-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    pair = re.compile(rf"{number}\s+{number}(?:\s+-?[\d.eE+-]+)*")

    def one(w: str | None) -> str | None:
        if w is None or same(source, target):
            return w
        head, body = re.match(r"\s*(SRID=\d+;)?(.*)", w, re.S).groups()
        code = target.rsplit(":", 1)[1]
        if head:
            srid = head[5:-1]
            if srid == code:
                return w
            if srid != source.rsplit(":", 1)[1]:
                raise ValueError(f"a geometry in {srid}, not {source}")
            head = f"SRID={code};"
        body = re.sub(r"^\s*([A-Za-z]+)\s+[ZMzm]{1,2}\b", r"\1", body)
        places = pair.findall(body)
        if not places:
            return (head or "") + body
        p = np.array(places, dtype="float64")
        with np.errstate(all="ignore"):
            x, y = forward(np, *back(np, p[:, 0], p[:, 1]))
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            return None
        now = iter(zip(x.tolist(), y.tolist(), strict=True))
        return (head or "") + pair.sub(lambda _: "{!r} {!r}".format(*next(now)), body)

    return pd.Series([one(w) for w in wkt], dtype="object")


def reproject(df: DataFrame, columns: Sequence[str], source: str, target: str | None = None) -> DataFrame:
    """df with columns of WKT brought from a system to another; without a target to the session's."""
    require(df, *columns)
    target = target or default_system(df.sparkSession)
    system(source), system(target)  # unknown ones raise here, not in a task
    change = F.pandas_udf(lambda w: moved(w, source, target), T.StringType())
    return df.withColumns({c: change(F.col(f"`{c}`")) for c in columns})


def default_system(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, "EPSG:4326")


def set_default_system(spark: SparkSession, code: str) -> None:
    system(code)
    spark.conf.set(SETTING, code.upper().strip())


def kinds(df: DataFrame, geometry: str) -> DataFrame:
    """(kind, srid, rows): which geometries a column holds."""
    c = F.col(f"`{geometry}`")
    kind = F.upper(F.nullif(F.regexp_extract(c, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1), F.lit("")))
    return df.groupBy(kind.alias("kind"), F.regexp_extract(c, r"^\s*SRID=(\d+);", 1).try_cast("int").alias("srid")).agg(F.count("*").alias("rows"))
