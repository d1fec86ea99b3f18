"""Files of shapes and sheets: fixed values, odd content and limits."""

from __future__ import annotations

import datetime
import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import encoding
from lodestone.sources import io, shapes, sheets

POINT, LINE = "POINT (1.5 -2.0)", "LINESTRING (0.0 0.0, 3.0 4.0, 1e-07 5.0)"
LINES = "MULTILINESTRING ((0.0 0.0, 3.0 4.0), (5.0 5.0, 6.0 6.0))"
HOLED = "POLYGON ((0.0 0.0, 9.0 0.0, 9.0 9.0, 0.0 9.0, 0.0 0.0), (2.0 2.0, 2.0 4.0, 4.0 4.0, 4.0 2.0, 2.0 2.0))"
MANY = "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 9.0 5.0, 9.0 9.0, 5.0 5.0)))"
POINTS = "MULTIPOINT (1.0 2.0, 3.0 4.0)"
ALL = [POINT, LINE, LINES, HOLED, MANY, POINTS]


@pytest.mark.parametrize("wkt", [*ALL, "POLYGON EMPTY", "POINT EMPTY"])
def test_encodings_are_exact_both_ways(wkt):
    assert encoding.text(*encoding.nested(wkt)) == wkt
    assert encoding.text(*encoding.read_wkb(encoding.wkb(*encoding.nested(wkt)))) == wkt


def test_wkb_fixed_values():
    assert encoding.wkb("POINT", [1.0, 2.0]).hex() == "0101000000000000000000f03f0000000000000040"
    big = bytes.fromhex("00000000013ff00000000000004000000000000000")
    assert encoding.read_wkb(big) == ("POINT", [1.0, 2.0])
    high = struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1.0, 2.0, 9.0)  # a height and a system
    assert encoding.read_wkb(high) == ("POINT", [1.0, 2.0])
    assert encoding.read_wkb(struct.pack("<BIddd", 1, 1001, 1.0, 2.0, 9.0)) == ("POINT", [1.0, 2.0])
    assert encoding.nested("SRID=4326;POINT Z (1 2 3)") == ("POINT", [1.0, 2.0])
    assert encoding.nested("MULTIPOINT ((1 2), (3 4))") == ("MULTIPOINT", [[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(ValueError):
        encoding.nested("CIRCLE (1 2)")


def test_sniffed(spark):
    df = spark.createDataFrame([(POINT,), ("0101000000000000000000f03f0000000000000040",), (None,)], "g string")
    assert [r[0] for r in df.select(encoding.sniffed("g")).collect()] == [POINT, "POINT (1.0 2.0)", None]
    kept = df.filter("g like 'P%' or g is null").select(encoding.from_wkb(encoding.to_wkb("g"))).collect()
    assert [r[0] for r in kept] == [POINT, None]


def table(spark, wkts):
    odd = ["plain", "a,\"b\" <c> & 'd'", "žluťoučký", None, "", "x" * 200]
    return spark.createDataFrame([(k, odd[k % 6], k / 4, k % 2 == 0, w) for k, w in enumerate(wkts)], "k long, name string, v double, even boolean, geometry string")


@pytest.mark.parametrize("fmt,reader", [("gpkg", shapes.read_gpkg), ("kml", shapes.read_kml), ("geojson", io.read_geojson), ("geojsonl", None)])
def test_all_kinds_come_back(spark, tmp_path, fmt, reader):
    df = table(spark, [*ALL, None])
    path = str(tmp_path / f"all.{fmt}")
    shapes.write_shapes(df, path, fmt)
    if reader is None:
        back = spark.read.text(path).select(F.get_json_object("value", "$.properties").alias("properties"), F.get_json_object("value", "$.geometry.type").alias("geometry"))
        assert [r.geometry for r in back.orderBy(F.get_json_object("properties", "$.k").cast("int")).collect()] == [*(encoding.GEOJSON[w.split(" ")[0]] for w in ALL), None]
    else:
        back = reader(spark, path)
        got = {int(json.loads(r.properties)["k"]): r.geometry for r in back.collect()}
        assert {k: g and encoding.nested(g) for k, g in got.items()} == {k: w and encoding.nested(w) for k, w in enumerate([*ALL, None])}
    names = {int(p["k"]): p.get("name") or None for p in (json.loads(r.properties) for r in back.collect())}
    assert names == {r.k: r["name"] or None for r in df.collect()}


@pytest.mark.parametrize("wkts", [[POINT, None, "POINT (7.0 8.0)"], [LINE, LINES], [HOLED, MANY, None], [POINTS]])
def test_shapefiles(spark, tmp_path, wkts):
    df = table(spark, wkts)
    shapes.write_shapes(df, str(tmp_path / "s.shp"), "shp")
    rows = shapes.read_shapefile(spark, str(tmp_path)).collect()
    got = [(json.loads(r.properties), r.geometry and encoding.nested(r.geometry)) for r in rows]
    rings = lambda n: n and (n[0], sorted(map(str, n[1])) if n[0] == "MULTIPOLYGON" else n[1])
    assert [rings(g) for _, g in got][: 1 if HOLED in wkts else None] == [rings(w and encoding.nested(w)) for w in wkts][: 1 if HOLED in wkts else None]
    assert [(p["k"], p["name"], p["v"], p["even"]) for p, _ in got] == [(r.k, r["name"] or None, r.v, r.even) for r in df.collect()]
    size = (tmp_path / "s.shp").stat().st_size
    assert struct.unpack(">i", (tmp_path / "s.shp").read_bytes()[24:28])[0] * 2 == size


def test_shapefiles_leave_deleted_records_and_do_without_attributes(spark, tmp_path):
    shapes.write_shapes(table(spark, [POINT, "POINT (7.0 8.0)"]), str(tmp_path / "s.shp"), "shp")
    data = bytearray((tmp_path / "s.dbf").read_bytes())
    head = struct.unpack_from("<H", data, 8)[0]
    data[head : head + 1] = b"*"
    (tmp_path / "s.dbf").write_bytes(bytes(data))
    (tmp_path / ".s.dbf.crc").unlink()
    assert [r.geometry for r in shapes.read_shapefile(spark, str(tmp_path)).collect()] == ["POINT (7.0 8.0)"]
    (tmp_path / "s.dbf").unlink()
    assert [tuple(r) for r in shapes.read_shapefile(spark, str(tmp_path)).collect()] == [("{}", POINT), ("{}", "POINT (7.0 8.0)")]


def test_writers_raise(spark, tmp_path):
    path = str(tmp_path / "x")
    for fmt in ("shp", "gpkg", "kml", "geojson"):
        with pytest.raises(ValueError, match="more than 1 rows"):
            shapes.write_shapes(table(spark, [POINT, POINT]), path, fmt, limit=1)
    with pytest.raises(ValueError, match="several"):
        shapes.write_shapes(table(spark, [POINT, LINE]), path, "shp")
    with pytest.raises(ValueError, match="known"):
        shapes.write_shapes(table(spark, [POINT]), path, "dwg")
    with pytest.raises(ValueError):
        shapes.write_shapes(table(spark, [POINT]), path, "gpkg", layer="a; DROP TABLE b")


def test_gpkg_is_a_database(spark, tmp_path):
    shapes.write_shapes(table(spark, ALL), str(tmp_path / "a.gpkg"), "gpkg", layer="places")
    con = sqlite3.connect(tmp_path / "a.gpkg")
    assert con.execute("SELECT count(*), min(k), max(v) FROM places").fetchone() == (6, 0, 1.25)
    assert con.execute("PRAGMA application_id").fetchone() == (1196444487,)
    assert shapes.read_gpkg(spark, str(tmp_path), layer="none").collect() == []


def test_empty_tables(spark, tmp_path):
    none = table(spark, [POINT]).limit(0)
    for fmt, reader in (("shp", shapes.read_shapefile), ("gpkg", shapes.read_gpkg), ("geojson", io.read_geojson), ("kml", shapes.read_kml)):
        shapes.write_shapes(none, str(tmp_path / fmt / f"e.{fmt}"), fmt)
        assert reader(spark, str(tmp_path / fmt)).collect() == []


def test_sheets(spark, tmp_path):
    when = datetime.datetime(2024, 2, 29, 13, 5)
    df = spark.createDataFrame([(1, "a <&> \"b\"", 1.5, True, when), (2, None, float("nan"), False, None), (3, " x\x01\ny ", -2e-9, None, when)], "k int, s string, v double, b boolean, w timestamp")
    path = str(tmp_path / "b.xlsx")
    sheets.write_xlsx(df.coalesce(1), path, "A & B")
    rows = sheets.read_xlsx(spark, path).orderBy("row").collect()
    assert [r.row for r in rows] == [1, 2, 3, 4]
    assert rows[0]["values"] == ["k", "s", "v", "b", "w"]
    assert rows[1]["values"] == ["1", 'a <&> "b"', "1.5", "1", "2024-02-29 13:05:00"]
    assert rows[2]["values"] == ["2", None, None, "0"]
    assert rows[3]["values"] == ["3", " x\x01\ny ", "-2e-09", None, "2024-02-29 13:05:00"]
    assert zipfile.ZipFile(path).testzip() is None
    assert sheets.read_xlsx(spark, path, "A & B").count() == 4
    with pytest.raises(ValueError):
        sheets.write_xlsx(df, path, limit=2)
    with pytest.raises(ValueError):
        sheets.write_xlsx(df, path, "a/b")
    assert [sheets.letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [sheets.number(c) for c in ("A1", "Z9", "AA10", "ZZ1", "AAA1")] == [0, 25, 26, 701, 702]
