"""Files of shapes: shapefiles, GeoPackages, KML and GeoJSON, by their published layouts.

Reading is one task a file, in batches; a format's own limit (2 GB) bounds a file. Writers of formats that are one file
take at most ``limit`` rows through the driver and raise beyond; tables of any size go to Parquet, CSV or lines of GeoJSON.
Readers give properties as JSON text and geometry as WKT.
"""

from __future__ import annotations

import json
import re
import sqlite3
import struct
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..compat import identifier, require
from ..functions import encoding
from ..functions.geometry import write_wkt

BATCH = 2000
LIMIT = 1_000_000


def _batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.filter(F.lower("path").endswith(ending)).select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), "content")


# shapefiles


def shp_records(data: bytes) -> Iterator[str | None]:
    """WKT of each record; heights and measures are left out. Rings that turn right are outer ones."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack_from("<i", body)[0] % 10 if body else 0
        if kind == 0:
            yield None
        elif kind == 1:
            yield encoding.text("POINT", list(struct.unpack_from("<2d", body, 4)))
        elif kind == 8:
            (n,) = struct.unpack_from("<i", body, 36)
            yield encoding.text("MULTIPOINT", list(struct.iter_unpack("<2d", body[40 : 40 + 16 * n])))
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            points = list(struct.iter_unpack("<2d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n]))
            runs = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind == 5:
                yield write_wkt([r[::-1] for r in runs])
            else:
                yield encoding.text("LINESTRING", runs[0]) if parts == 1 else encoding.text("MULTILINESTRING", runs)
        else:
            raise ValueError(f"a kind of record that isn't known: {kind}")


def dbf_records(data: bytes) -> Iterator[dict | None]:
    """Values by name; null for a record that is marked as deleted."""
    n, head, wide = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32

    def value(raw: bytes, kind: str):
        if kind in "IO":
            return struct.unpack("<i" if kind == "I" else "<d", raw)[0]
        try:
            s = raw.decode("utf-8").strip(" \0")
        except UnicodeDecodeError:
            s = raw.decode("latin-1").strip(" \0")
        if kind in "NF":
            return None if not s or set(s) == {"*"} else int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s)
        if kind == "L":
            return {"Y": True, "T": True, "N": False, "F": False}.get(s.upper())
        return s or None

    for k in range(n):
        record = data[head + k * wide : head + (k + 1) * wide]
        if len(record) < wide:
            return
        out, at = {}, 1
        for name, kind, size in fields:
            out[name] = value(record[at : at + size], kind)
            at += size
        yield None if record[:1] == b"*" else out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of the shapefiles at a path, attributes by the order of records."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shp, dbf in zip(b["shp"], b["dbf"], strict=True):
                shapes = shp_records(bytes(shp))
                values = dbf_records(bytes(dbf)) if dbf is not None else ({} for _ in iter(int, 1))
                yield from _batches(((json.dumps(v, ensure_ascii=False), g) for g, v in zip(shapes, values, strict=False) if v is not None), ["properties", "geometry"])

    pairs = _files(spark, path, ".shp").withColumnRenamed("content", "shp").join(_files(spark, path, ".dbf").withColumnRenamed("content", "dbf"), "stem", "left")
    return pairs.select("shp", "dbf").mapInPandas(read, "properties string, geometry string")


def _dbf(rows: list[dict], names: list[str]) -> bytes:
    cells = [["" if r[n] is None else ("T" if r[n] else "F") if isinstance(r[n], bool) else str(r[n]) for n in names] for r in rows]
    raw = [[c.encode() for c in r] for r in cells]
    short: list[str] = []
    for n in names:
        s = n.encode()[:10].decode("utf-8", "ignore")
        if s in short:
            raise ValueError(f"names of attributes are the same in ten bytes: {n}")
        short.append(s)
    kinds = []
    for n in names:
        types = {type(r[n]) for r in rows if r[n] is not None}
        kinds.append("L" if types == {bool} else "N" if types and types <= {int, float} else "C")
    sizes = [max([1, *(len(r[k]) for r in raw)]) for k in range(len(names))]
    if max(sizes, default=0) > 254:
        raise ValueError("an attribute of a shapefile holds 254 bytes at most")
    fields = b"".join(struct.pack("<11sc4xBB14x", s.encode(), k.encode(), z, 0) for s, k, z in zip(short, kinds, sizes, strict=True))
    body = b"".join(b" " + b"".join(c.rjust(z) if k == "N" else c.ljust(z) for c, k, z in zip(r, kinds, sizes, strict=True)) for r in raw)
    return struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 32 + len(fields) + 1, 1 + sum(sizes)) + fields + b"\r" + body + b"\x1a"


def _shp(shapes: list[tuple[str, list] | None]) -> tuple[bytes, bytes]:
    """Records and their index. One kind a file, as the layout has it."""
    number = {"POINT": 1, "LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5, "MULTIPOLYGON": 5, "MULTIPOINT": 8}  # fixed values
    kinds = {number[s[0]] for s in shapes if s and s[1]}
    if len(kinds) > 1:
        raise ValueError("a shapefile holds points, lines or areas, not several of them")
    kind = min(kinds, default=0)
    turns = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))
    everything = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    records, index, at = [], [], 50
    for k, s in enumerate(shapes):
        if not s or not s[1]:
            body = struct.pack("<i", 0)
        elif kind == 1:
            body, ps = struct.pack("<i2d", 1, *s[1]), [s[1]]
        else:
            name, c = s
            runs = [c] if name in ("LINESTRING", "MULTIPOINT") else c if name != "MULTIPOLYGON" else [r for p in c for r in p]
            if kind == 5:
                areas = [c] if name == "POLYGON" else c
                runs = [r if (turns(r) < 0) == (j == 0) else r[::-1] for p in areas for j, r in enumerate(p)]
            ps = [p for r in runs for p in r]
            box = [min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)]
            starts = [sum(map(len, runs[:j])) for j in range(len(runs))]
            body = struct.pack("<i4d", kind, *box) + (struct.pack("<i", len(ps)) if kind == 8 else struct.pack(f"<2i{len(runs)}i", len(runs), len(ps), *starts)) + b"".join(struct.pack("<2d", *p) for p in ps)
        if s and s[1]:
            everything = [min(everything[0], *(p[0] for p in ps)), min(everything[1], *(p[1] for p in ps)), max(everything[2], *(p[0] for p in ps)), max(everything[3], *(p[1] for p in ps))]
        index.append(struct.pack(">2i", at, len(body) // 2))
        records.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        at += 4 + len(body) // 2
    if not kinds:
        everything = [0.0] * 4
    head = lambda words: struct.pack(">i20xi", 9994, words) + struct.pack("<2i4d32x", 1000, kind, *everything)
    return head(at) + b"".join(records), head(50 + 4 * len(index)) + b"".join(index)


# GeoPackages


def gpkg_rows(data: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    """(layer, system, properties, geometry) of all layers of features."""
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    for table, column, srs in con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        rows = con.execute(f"SELECT * FROM {quoted(table)}")
        names = [c[0] for c in rows.description]
        for r in rows:
            values = {n: v.hex() if isinstance(v, bytes) else v for n, v in zip(names, r, strict=True) if n != column}
            blob = r[names.index(column)]
            wkt = None
            if blob is not None:
                wkt = encoding.text(*encoding.read_wkb(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]))
            yield table, srs, json.dumps(values, ensure_ascii=False), wkt
    con.close()


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(layer, srs_id, properties, geometry) of the GeoPackages at a path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                yield from _batches((r for r in gpkg_rows(bytes(data)) if layer in (None, r[0])), ["layer", "srs_id", "properties", "geometry"])

    return _files(spark, path, ".gpkg").select("content").mapInPandas(read, "layer string, srs_id int, properties string, geometry string")


def _gpkg(rows: list[dict], names: list[str], shapes: list, layer: str, srs: int) -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript(
        "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"  # fixed values of the format
        "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"
    )
    con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", {i: (f"{o}:{i}", i, o, i) for o, i in (("NONE", -1), ("NONE", 0), ("EPSG", 4326), ("EPSG", srs))}.values())
    kind = {int: "INTEGER", bool: "BOOLEAN", float: "DOUBLE"}
    typed = [kind.get(next((type(r[n]) for r in rows if r[n] is not None), str), "TEXT") for n in names]
    con.execute(f"CREATE TABLE {layer} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB" + "".join(f', "{n}" {k}' for n, k in zip(names, typed, strict=True)) + ")")
    con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
    head = lambda s: b"GP" + struct.pack("<BBi", 0, 1 if s[1] else 17, srs)
    plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
    con.executemany(f"INSERT INTO {layer} VALUES (NULL, ?{', ?' * len(names)})", ((head(s) + encoding.wkb(*s) if s else None, *(plain(r[n]) for n in names)) for r, s in zip(rows, shapes, strict=True)))
    con.commit()
    return con.serialize()


# KML

KML = (
    "name string, description string, Point struct<coordinates:string>, LineString struct<coordinates:string>, "
    "Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>,innerBoundaryIs:array<struct<LinearRing:struct<coordinates:string>>>>, "
    "MultiGeometry struct<Polygon:array<struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>,innerBoundaryIs:array<struct<LinearRing:struct<coordinates:string>>>>>,"
    "LineString:array<struct<coordinates:string>>,Point:array<struct<coordinates:string>>>, "
    "ExtendedData struct<Data:array<struct<_name:string,value:string>>>"
)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of all placemarks, by Spark's XML reader; a mixed collection gives its areas, else its lines, else its points."""
    p = spark.read.format("xml").option("rowTag", "Placemark").schema(KML).load(path)
    run = lambda c: F.concat(F.lit("("), F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"([^,\s]+),([^,\s]+)(?:,[^\s]*)?", "$1 $2"), r"(\S+ \S+) (?=\S)", "$1, "), F.lit(")"))
    area = lambda a: F.concat(F.lit("("), F.array_join(F.concat(F.array(run(a["outerBoundaryIs"]["LinearRing"]["coordinates"])), F.coalesce(F.transform(a["innerBoundaryIs"], lambda i: run(i["LinearRing"]["coordinates"])), F.array().cast("array<string>"))), ", "), F.lit(")"))
    many = lambda kind, c, f: F.when(F.size(c) > 0, F.concat(F.lit(f"{kind} ("), F.array_join(F.transform(c, f), ", "), F.lit(")")))
    m = F.col("MultiGeometry")
    wkt = F.coalesce(
        F.concat(F.lit("POINT "), run(F.col("Point.coordinates"))),
        F.concat(F.lit("LINESTRING "), run(F.col("LineString.coordinates"))),
        F.when(F.col("Polygon").isNotNull(), F.concat(F.lit("POLYGON "), area(F.col("Polygon")))),
        many("MULTIPOLYGON", m["Polygon"], area),
        many("MULTILINESTRING", m["LineString"], lambda l: run(l["coordinates"])),
        many("MULTIPOINT", m["Point"], lambda l: run(l["coordinates"])),
    )
    data = F.coalesce(F.map_from_entries(F.transform("ExtendedData.Data", lambda d: F.struct(d["_name"], d["value"]))), F.create_map().cast("map<string,string>"))
    named = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("description"), F.col("description")), lambda k, v: v.isNotNull() & ~F.map_contains_key(data, k))
    return p.select(F.to_json(F.map_concat(named, data)).alias("properties"), wkt.alias("geometry"))


def _kml(rows: list[dict], names: list[str], shapes: list) -> bytes:
    def run(ps: list) -> str:
        return "<coordinates>" + " ".join(f"{x!r},{y!r}" for x, y in ps) + "</coordinates>"

    def area(c: list) -> str:
        side = lambda tag, r: f"<{tag}><LinearRing>{run(r)}</LinearRing></{tag}>"
        return "<Polygon>" + "".join(side("innerBoundaryIs" if k else "outerBoundaryIs", r) for k, r in enumerate(c)) + "</Polygon>"

    def body(s: tuple[str, list] | None) -> str:
        if not s or not s[1]:
            return ""
        kind, c = s
        if kind.startswith("MULTI"):
            return "<MultiGeometry>" + "".join(body((kind[5:], x)) for x in c) + "</MultiGeometry>"
        return area(c) if kind == "POLYGON" else f"<Point>{run([c])}</Point>" if kind == "POINT" else f"<LineString>{run(c)}</LineString>"

    data = lambda r: "".join(f"<Data name={quoteattr(n)}><value>{escape(str(r[n]))}</value></Data>" for n in names if r[n] is not None)
    marks = "\n".join(f"<Placemark><ExtendedData>{data(r)}</ExtendedData>{body(s)}</Placemark>" for r, s in zip(rows, shapes, strict=True))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n{marks}\n</Document></kml>\n'.encode()


# what all writers share


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """One file through Hadoop's file systems."""
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(P(path), True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def _bounded(df: DataFrame, limit: int) -> list[Row]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a format that is one file")
    return rows


def write_shapes(df: DataFrame, path: str, fmt: str, geometry: str = "geometry", layer: str = "layer", srs: int = 4326, limit: int = LIMIT) -> None:
    """A table in a format of shapes.

    geoparquet (WKB beside the columns, without the format's metadata), parquet (without geometry), csv (WKT) and geojsonl
    (a feature a line) are written by all tasks; geojson, kml, gpkg and shp are one file, of at most ``limit`` rows.
    """
    require(df, geometry)
    names = [c for c in df.columns if c != geometry]
    spark = df.sparkSession
    if fmt == "geoparquet":
        df.withColumn(geometry, encoding.to_wkb(F.col(geometry))).write.mode("overwrite").parquet(path)
    elif fmt == "parquet":
        df.drop(geometry).write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "geojsonl":
        features(df, geometry).write.mode("overwrite").text(path)
    elif fmt == "geojson":
        lines = ",\n".join(r[0] for r in _bounded(features(df, geometry), limit))
        _put(spark, path, f'{{"type":"FeatureCollection","features":[\n{lines}\n]}}\n'.encode())
    elif fmt in ("kml", "gpkg", "shp"):
        rows = [r.asDict() for r in _bounded(df, limit)]
        shapes = [encoding.nested(r[geometry]) for r in rows]
        if fmt == "kml":
            _put(spark, path, _kml(rows, names, shapes))
        elif fmt == "gpkg":
            for n in (layer, *names):
                identifier(n)
            _put(spark, path, _gpkg(rows, names, shapes, layer, srs))
        else:
            stem = re.sub(r"\.shp$", "", path)
            shp, shx = _shp(shapes)
            for ending, data in ((".shx", shx), (".dbf", _dbf(rows, names)), (".cpg", b"UTF-8"), (".shp", shp)):
                _put(spark, stem + ending, data)
    else:
        raise ValueError(f"a format that isn't known: {fmt!r}")


def features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """A GeoJSON feature a row, as text; points, lines and areas alike."""
    names = [c for c in df.columns if c != geometry]
    properties = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), encoding.geojson(F.col(f"`{geometry}`")), F.lit("}")).alias("value"))
