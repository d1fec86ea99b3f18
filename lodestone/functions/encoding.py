"""Geometries as WKT, WKB and nested coordinates, by the published layouts of these formats."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: numbers of kinds in WKB, and how deep their coordinates are nested
WKB = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
DEPTH = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2, "MULTIPOINT": 1, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}
GEOJSON = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def nested(wkt: str | None) -> tuple[str, list] | None:
    """(kind, coordinates nested as in GeoJSON); null for nothing, empty lists for EMPTY, an error for other kinds."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:[ZMzm]{1,2}\s)?\s*(.*)", wkt or "", re.S)
    if not m:
        return None
    kind, body = m[1].upper(), m[2].strip()
    if kind not in WKB:
        raise ValueError(f"a kind of geometry that isn't known: {kind}")
    if body.upper() == "EMPTY":
        return kind, []
    number = r"(-?[\d.]+(?:[eE][+-]?\d+)?)"
    pairs = re.sub(rf"{number}\s+{number}(?:\s+-?[\d.eE+-]+)*", lambda p: f"[{float(p[1])!r},{float(p[2])!r}]", body)
    out = json.loads(pairs.replace("(", "[").replace(")", "]"))
    if kind == "POINT":
        out = out[0]
    elif kind == "MULTIPOINT":
        out = [p[0] if isinstance(p[0], list) else p for p in out]
    return kind, out


def text(kind: str, coordinates: list) -> str:
    """WKT of nested coordinates."""
    if not coordinates:
        return f"{kind} EMPTY"

    def write(c: list, depth: int) -> str:
        return f"{float(c[0])!r} {float(c[1])!r}" if depth == 0 else "(" + ", ".join(write(x, depth - 1) for x in c) + ")"

    return f"{kind} ({write(coordinates, 0)})" if kind == "POINT" else f"{kind} {write(coordinates, DEPTH[kind])}"


def wkb(kind: str, coordinates: list) -> bytes:
    """Little-endian WKB; an empty point has no numbers for its place."""
    head = struct.pack("<BI", 1, WKB[kind])
    run = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p[:2]) for p in ps)
    if kind == "POINT":
        return head + struct.pack("<2d", *(coordinates or (float("nan"),) * 2))
    if kind == "LINESTRING":
        return head + run(coordinates)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(run, coordinates))
    return head + struct.pack("<I", len(coordinates)) + b"".join(wkb(kind[5:], c) for c in coordinates)


def read_wkb(data: bytes) -> tuple[str, list]:
    """(kind, coordinates) of WKB, with or without heights, measures and an identifier of the system."""
    kinds = {n: k for k, n in WKB.items()}

    def geometry(at: int) -> tuple[str, list, int]:
        e = "<" if data[at] else ">"
        (code,) = struct.unpack_from(f"{e}I", data, at + 1)
        at += 9 if code & 0x20000000 else 5
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0xFFFF
        extra += (0, 1, 1, 2)[code // 1000]
        kind, wide = kinds[code % 1000], 16 + 8 * extra

        def run(at: int) -> tuple[list, int]:
            (n,) = struct.unpack_from(f"{e}I", data, at)
            return [list(struct.unpack_from(f"{e}2d", data, at + 4 + k * wide)) for k in range(n)], at + 4 + n * wide

        if kind == "POINT":
            p = list(struct.unpack_from(f"{e}2d", data, at))
            return kind, [] if p[0] != p[0] else p, at + wide
        if kind == "LINESTRING":
            return kind, *run(at)
        (n,) = struct.unpack_from(f"{e}I", data, at)
        at, out = at + 4, []
        for _ in range(n):
            part, at = run(at) if kind == "POLYGON" else geometry(at)[1:]
            out.append(part)
        return kind, out, at

    return geometry(0)[:2]


@F.pandas_udf(T.BinaryType())
def to_wkb(wkt: pd.Series) -> pd.Series:
    return pd.Series([wkb(*n) if (n := nested(w)) else None for w in wkt], dtype="object")


@F.pandas_udf(T.StringType())
def from_wkb(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else text(*read_wkb(bytes(d))) for d in data], dtype="object")


@F.pandas_udf(T.StringType())
def sniffed(value: pd.Series) -> pd.Series:
    """WKT of text that is WKT already or WKB in hexadecimal digits."""
    is_hex = lambda v: len(v) >= 10 and len(v) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", v)
    return pd.Series([text(*read_wkb(bytes.fromhex(v))) if v is not None and is_hex(v) else v for v in value], dtype="object")


@F.pandas_udf(T.StringType())
def geojson(wkt: pd.Series) -> pd.Series:
    """The geometry of a feature as JSON text, null as the word."""
    shape = lambda n: "null" if n is None else json.dumps({"type": GEOJSON[n[0]], "coordinates": n[1]}, separators=(",", ":"))
    return pd.Series([shape(nested(w)) for w in wkt], dtype="object")
