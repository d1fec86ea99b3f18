"""Edge cases and fixed values of the operators."""

from __future__ import annotations

import json as stdjson
import math
import random
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import compat
from lodestone.functions import codes, geoid, geometry, grid, json, moe, projection, text, variables
from lodestone.operators import crosstab, crosswalk, longitudinal, relational, spatial, survey
from lodestone.sources import federation, io
from lodestone.streaming import windows

CALM = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Contract


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 1.0)], "g string, v double")
    assert rows(relational.groupby_agg(df, ["g"], {"v": "sum"})) == [("a", 0.0), ("b", 2.0), (None, 1.0)]
    assert rows(relational.groupby_agg(df, ["g"], {"v": "count"}, drop_null_keys=True)) == [("a", 0), ("b", 1)]
    assert relational.groupby_agg(df.limit(0), ["g"], {"v": "sum"}).collect() == []
    for bad in ({}, {"v": "mode"}, {"v": "first"}):
        with pytest.raises(ValueError):
            relational.groupby_agg(df, ["g"], bad)


@CALM
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(-1000, 1000))), max_size=30))
def test_groupby_property(spark, data):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in data], "g int, v double")
    want = {}
    for g, v in data:
        want[g] = want.get(g, 0.0) + (v or 0.0)
    assert {r[0]: r[1] for r in relational.groupby_agg(df, ["g"], {"v": "sum"}).collect()} == want


def test_join_names_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k int, v string")
    j = relational.join(a, b, "k")
    assert j.columns == ["k", "v_left", "v_right"] and rows(j) == [(1, "x", "p"), (1, "x", "q")]
    assert rows(relational.join(a, b, "k", null_safe=True)) == [(1, "x", "p"), (1, "x", "q"), (None, "y", "r")]
    assert rows(relational.join(a, b, "k", "anti")) == [(None, "y")]
    with pytest.raises(ValueError):
        relational.join(a, b, "k", "cross")


def test_validity(spark):
    v = spark.createDataFrame([("A", "2010-01-01", "2019-12-31", 2010), ("B", "2020-01-01", None, 2020), ("C", None, None, 2020)], "geoid string, f string, t string, vintage_year int").select("geoid", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "vintage_year")
    at = lambda d: sorted(r.geoid for r in relational.temporal_filter(v, d).collect())
    assert at("2015-06-01") == ["A", "C"] and at("2021-01-01") == ["B", "C"] and at("2019-12-31") == ["A", "C"]
    assert sorted(r.geoid for r in relational.temporal_filter(v.filter("geoid = 'A'"), "2000-01-01").collect()) == ["A"]
    assert rows(relational.vintage_at(v.select("geoid", "vintage_year"), 1990)) == [("A", 2010)]
    assert relational.temporal_filter(v.limit(0), "2015-06-01").collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 51), (60, 60)], "a long, b long")
    got = dict(rows(relational.components_of(edges)))
    assert all(got[i] == 1 for i in range(1, 21)) and got[51] == 50 and got[60] == 60


def test_components_of_shuffled_ids(spark):
    """A path and a grid whose ids don't rise along them stay whole; too few rounds raise."""
    d = random.Random(3)
    path = d.sample(range(1, 201), 200)
    side = 12
    ids = d.sample(range(1000, 1000 + side * side), side * side)
    grid_ = [(ids[i * side + j], ids[(i + u) * side + j + v]) for i in range(side) for j in range(side) for u, v in ((0, 1), (1, 0)) if i + u < side and j + v < side]
    edges = spark.createDataFrame([*zip(path, path[1:], strict=False), *grid_, (5000, 5000)], "a long, b long")
    assert dict(rows(relational.components_of(edges))) == dict.fromkeys(path, 1) | dict.fromkeys(ids, 1000) | {5000: 5000}
    with pytest.raises(RuntimeError):
        relational.components_of(edges, rounds=1)


def test_identifiers():
    assert compat.identifier("a_b") == "a_b" and compat.identifier("a.b.c", dotted=True)
    for bad in ("1a", "a;b", "a b", "", "a.b"):
        with pytest.raises(ValueError):
            compat.identifier(bad)
    assert compat.literal_text("o'k") == "o''k"


# Tables


def test_contingency_fixture(spark):
    df = spark.createDataFrame([("W", "A", 1000.0), ("W", "B", 800.0), ("B", "A", 500.0), ("B", "B", 600.0), ("H", "A", 300.0), ("H", "B", 400.0)], "race string, county string, p double")
    c = {(r.row, r.col): r.value for r in crosstab.contingency(df, "race", "county", "p").collect()}
    assert c["Total", "Total"] == 3600 and c["Total", "A"] == 1800 and c["W", "Total"] == 1800
    x = crosstab.chi_square(crosstab.contingency(df, "race", "county", "p")).first()
    assert x.dof == 2 and x.n_cells == 6 and x.p_value < 1e-6


@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (6.634897, 1, 0.01), (124.342113, 100, 0.05)])
def test_chi_square_tail(spark, x, dof, p):
    got = spark.createDataFrame([(x, dof)], "x double, dof long").select(crosstab.chi_square_tail("x", "dof")).first()[0]
    assert abs(got - p) < 1e-6


def test_yates(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 20.0), ("b", "x", 30.0), ("b", "y", 25.0)], "r string, c string, v double")
    t = crosstab.contingency(df, "r", "c", "v")
    plain, corrected = crosstab.chi_square(t, yates=False).first(), crosstab.chi_square(t).first()
    assert abs(plain.statistic - 85 * (10 * 25 - 20 * 30) ** 2 / (30 * 55 * 40 * 45)) < 1e-5 and corrected.statistic < plain.statistic


# Survey


def test_waves_fixture(spark):
    frame = lambda d, r: spark.createDataFrame([("D",)] * d + [("R",)] * r, "party string")
    got = {(r.break_key, r.category): r["count"] for r in survey.compare_waves([("W1", frame(60, 40)), ("W2", frame(55, 45)), ("W3", frame(50, 50))], "party").collect()}
    assert got["Δ (last − first)", "D"] == -10 and got["Δ (last − first)", "R"] == 10
    with pytest.raises(ValueError):
        survey.compare_waves([], "party")


def test_letters_beyond_z(spark):
    assert tuple(one(spark, *(survey.letter(F.lit(i)) for i in (0, 25, 26, 27, 52)))) == ("A", "Z", "AA", "AB", "BA")


def test_raking_meets_targets(spark):
    df = spark.createDataFrame([("18", "M"), ("18", "F"), ("35", "M"), ("35", "F"), ("65", "M"), ("65", "F")], "age string, sex string")
    w = survey.rake(df, {"age": {"18": 0.3, "35": 0.4, "65": 0.3}, "sex": {"M": 0.5, "F": 0.5}})
    got = {r.age: r.s for r in w.groupBy("age").agg(F.sum("weight").alias("s")).collect()}
    assert w.count() == 6 and abs(got["35"] - 2.4) < 1e-4
    with pytest.raises(ValueError):
        survey.rake(df, {"age": {"18": 1.0}})


def test_single_row_mean_has_no_interval(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "r string, b string, value double")
    assert survey.chain(df, "r", ["b"], kind="mean_scale").first().ci == 0.0
    with pytest.raises(ValueError):
        survey.chain(df.drop("value"), "r", ["b"], kind="mean_scale")


# Longitudinal


def test_change_fixture(spark):
    df = spark.createDataFrame([("1", 50000.0, 65000.0), ("2", 0.0, 5.0), ("3", None, 5.0)], "g string, v_2010 double, v_2020 double")
    r = {x.g: x for x in longitudinal.change(df, "v", 2010, 2020).collect()}
    assert r["1"].v_change_2010_2020 == 15000 and r["1"].v_pct_change_2010_2020 == 30 and r["1"].v_annual_change_2010_2020 == 1500
    assert r["2"].v_pct_change_2010_2020 is None and r["3"].v_cagr_2010_2020 is None


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (25.0, 10.0, 0.0, -3.0, -10.0, -25.0, 50.0, 20.0, 5.0, -5.0, -20.0, None, float("nan"))], "v double")
    got = [r.trend for r in longitudinal.classify_trends(df, "v").collect()]
    assert got == ["rapid_growth", "moderate_growth", "stable", "stable", "moderate_decline", "rapid_decline", "rapid_growth", "rapid_growth", "moderate_growth", "stable", "moderate_decline", "unknown", "unknown"]


def test_quantiles_with_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 5, 6)], "v double")
    assert sorted(r.b for r in longitudinal.quantile_bins(df, "v", 3, "b").collect()) == [0, 0, 0, 0, 1, 1]


def test_zscore_without_spread(spark):
    got = longitudinal.classify_zscore(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect()
    assert {(r.zscore, r.trend) for r in got} == {(0.0, "average")}


def test_change_detection_fixture(spark):
    now = spark.createDataFrame([("A", 100.0), ("B", 200.0), ("NEW", 500.0), ("DORMANT", 0.0)], "k string, v double")
    before = spark.createDataFrame([("A", 80.0), ("B", 220.0), ("DORMANT", 0.0)], "k string, v double")
    got = {r.k: (r.direction, round(r.pct_change, 2)) for r in longitudinal.change_detection(now, before, "k", "v").collect()}
    assert got == {"A": ("growth", 25.0), "B": ("decline", -9.09), "NEW": ("growth_from_zero", 0.0), "DORMANT": ("stable", 0.0)}


def test_series(spark):
    df = spark.createDataFrame([("T", y, v, m) for y, v, m in zip(range(2015, 2021), (4000.0, 4100.0, 4200.0, 4300.0, 4400.0, 4600.0), (10.0, None, 12.0, 1.0, 1.0, 1.0), strict=True)], "k string, year int, value double, moe double")
    r = longitudinal.series(df, ["k"], moe="moe").first()
    assert r.start_year == 2015 and r.end_year == 2020 and r.trend_direction == "increasing" and r.moes[:3] == [10.0, None, 12.0]
    assert abs(r.cagr - ((4600 / 4000) ** 0.2 - 1)) < 1e-12


# Crosswalks


def test_stability_fixture(spark):
    x = spark.createDataFrame([("1", "a", 0.6), ("1", "b", 0.4), ("2", "c", 1.0)], "source_geoid string, target_geoid string, area_weight double")
    s = crosswalk.stability(x).first()
    assert (s.total_source, s.total_target, s.unchanged, s.split, s.churn_rate) == (2, 3, 1, 1, 0.5)
    v = spark.createDataFrame([("1", 4000.0), ("9", 7.0)], "g string, v double")
    assert rows(crosswalk.apply(v, x, "g", ["v"])) == [("9", 7.0), ("a", 2400.0), ("b", 1600.0)]
    with pytest.raises(ValueError):
        crosswalk.apply(v, x, "g", ["v"], method="population")


def test_two_hops(spark):
    cols = "source_geoid string, target_geoid string, area_weight double"
    a = spark.createDataFrame([("01", "0601", 0.7), ("01", "0602", 0.3), ("02", "0603", 1.0)], cols)
    b = spark.createDataFrame([("0601", "X", 0.5), ("0601", "Y", 0.5), ("0602", "X", 0.5)], cols)
    got = {r.final: round(r.weight, 6) for r in crosswalk.reallocation([a, b], "01").collect()}
    assert got == {"X": 0.5, "Y": 0.35}


# Functions


def test_text(spark):
    r = one(spark, text.unquote(F.lit("  'a b' ")), text.squeeze(F.lit(None).cast("string")), text.snake_case(F.lit("someName Of-thing")), text.alphanumeric(F.lit("a-b_c!"), "_"), text.normalize_name(F.lit("Ünï-Çode  O'Brien")), text.uuid5(uuid.NAMESPACE_DNS, F.lit("é")), text.uuid5(uuid.NAMESPACE_DNS, F.lit(" ")), text.token_score(F.lit("Oil and gas"), F.lit("gas")))
    assert tuple(r) == ("a b", "", "some_name_of_thing", "ab_c", "unicode obrien", str(uuid.uuid5(uuid.NAMESPACE_DNS, "é")), None, 0.333)


def test_geoid(spark):
    r = one(spark, geoid.normalize(F.lit("6"), "State"), geoid.normalize(F.lit("123456789012"), "tract"), geoid.parent(F.lit("060371011001"), "bg", "tract"), geoid.slug(F.lit("06037101100"), "tract"), geoid.from_slug(F.lit("ca-037-tract-101100")), geoid.slug(F.lit("0614"), "congressional_district"), geoid.from_slug(F.lit("zcta-90210")), geoid.from_slug(F.lit("xx-cd-1")), geoid.state_fips(F.lit(" texas")), geoid.validate(F.lit(None).cast("string"), "county"))
    assert tuple(r) == ("06", "123456789012", "06037101100", "ca-037-tract-101100", "06037101100", "ca-cd-14", "90210", None, "48", False)
    with pytest.raises(ValueError):
        geoid.level("galaxy")


def test_codes(spark):
    r = one(spark, codes.crosswalk_naics(F.lit("517110"), 2012, 2022), codes.naics_ancestors(F.lit("5111")), codes.soc(F.lit("11-1010"))["level"], codes.naics(F.lit("5")), codes.locale_info(F.lit(21))["category"], codes.walkability(F.lit(None).cast("int")), codes.urbanicity(F.lit(30000), F.lit(6.0)))
    assert tuple(r) == (["517111"], ["51", "511", "5111"], "broad", None, "suburban", None, "suburb_small")


def test_moe(spark):
    L = F.lit
    r = one(spark, moe.cv(L(0.0), L(5.0)), moe.difference(L(10.0), L(3.0), L(4.0), L(4.0)), moe.proportion(L(5.0), L(1.0), L(0.0), L(1.0)), moe.quotient(L(5.0), L(1.0), L(0.0), L(1.0)), moe.interval(L(10.0), L(1.645), 0.95)["upper"])
    assert r[0] == math.inf and tuple(r[1]) == (6.0, 5.0) and tuple(r[2]) == (0.0, 0.0) and tuple(r[3]) == (0.0, 0.0) and abs(r[4] - 11.96) < 1e-9


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}, "c": [1, 2]}'), (2, "broken{"), (3, None), (4, '{"c": []}')], "id int, j string")
    got = json.flatten(df, "j", "a struct<b:int>, c array<int>", explode_arrays=True)
    assert got.columns == ["id", "j_a_b", "j_c", "j_corrupt"]
    assert rows(got) == [(1, 1, 1, False), (1, 1, 2, False), (2, None, None, True), (3, None, None, False), (4, None, None, False)]
    out = json.for_export(spark.createDataFrame([(float("nan"), bytearray(b"x"), [1])], "d double, b binary, a array<int>"))
    assert rows(out) == [("", "eA==", "[1]")]


# Places


def test_geometry(spark):
    L = F.lit
    ring = L("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    r = one(spark, geometry.area(ring), geometry.perimeter(ring), geometry.covers(geometry.rings(ring), L(1.5), L(1.5)), geometry.covers(geometry.rings(ring), L(0.0), L(2.0)), geometry.covers(geometry.rings(ring), L(3.0), L(3.0)), geometry.point(L(1.0), L(None).cast("double")))
    assert tuple(r) == (15.0, 20.0, False, True, True, None)
    tri = geometry.parse("POLYGON ((0 0, 2 0, 1 2, 0 0))")
    assert abs(geometry.overlap_area(tri, geometry.parse("POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))")) - 1.5) < 1e-12
    hole = geometry.parse("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    assert abs(geometry.overlap_area(hole, geometry.parse("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")) - 3) < 1e-12


def test_areal_fixture(spark):
    source = spark.createDataFrame([("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", 1000.0, 50000.0)], "g string, pop double, income double")
    quads = [(f"q{i}{j}", f"POLYGON (({i} {j}, {i + 1} {j}, {i + 1} {j + 1}, {i} {j + 1}, {i} {j}))") for i in range(2) for j in range(2)]
    got = spatial.apportion(source, spark.createDataFrame(quads, "q string, g string"), "g", "g", "q", ["pop"], ["income"])
    assert rows(got) == [(q, 250.0, 50000.0) for q, _ in quads]


def test_nearest_without_bound(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 0.0, 0.0)], "id int, x double, y double")
    t = spark.createDataFrame([("a", 1.0, 0.0), ("b", 50.0, 0.0)], "k string, u double, v double")
    got = spatial.nearest_any(p, t, "x", "y", "u", "v", "k", 1)
    assert rows(got.select("id", "target", "distance")) == [(1, "a", 1.0), (2, "b", 50.0), (3, "a", 1.0)]


def test_nearest_with_few_or_far_targets(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5e8, 0.0), (3, None, 0.0), (4, float("nan"), 0.0)], "id int, x double, y double")
    t = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1e9, 0.0), ("c", None, 0.0)], "k string, u double, v double")
    got = spatial.nearest_any(p, t, "x", "y", "u", "v", "k", 3)
    assert rows(got.select("id", "target", "distance", "rank")) == [(1, "a", 1.0, 1), (1, "b", 1e9, 2), (2, "a", 5e8 - 1, 1), (2, "b", 5e8, 2)]
    assert spatial.nearest_any(p, t.limit(0), "x", "y", "u", "v", "k").collect() == []


def test_grid(spark):
    df = spark.createDataFrame([(49.703498679, 11.770681595), (None, 1.0), (95.0, 1.0)], "lat double, lon double").withColumn("c", grid.point_cell("lat", "lon", 30))
    r = df.select(grid.token("c").alias("t"), grid.cell_level("c").alias("l"), grid.token(grid.parent("c", 10)).alias("p"), (grid.from_token(grid.token("c")) == F.col("c")).alias("same")).collect()
    assert r[0].l == 30 and r[0].same and r[0].t.startswith("47a1cbd5") and r[1].t is None and r[2].t is None
    kids = df.limit(1).select(F.explode(grid.children(grid.parent("c", 10))).alias("k"), grid.parent("c", 10).alias("p")).select((grid.parent("k", 10) == F.col("p")).alias("ok"), grid.cell_level("k").alias("l")).collect()
    assert {(k.ok, k.l) for k in kids} == {(True, 11)}


# Sources and streams


def test_staged_write(spark, tmp_path):
    path = str(tmp_path / "out")
    io.staged_write(spark.range(3), path)
    io.staged_write(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_store(spark, tmp_path):
    s = io.Store(spark, str(tmp_path))
    for y in (2010, 2020):
        s.save("boundaries", spark.createDataFrame([(f"g{y}",)], "geoid string"), geography_type="tract", vintage_year=y)
    assert [r.geoid for r in s.at("boundaries", 2015, geography_type="tract").collect()] == ["g2010"]
    assert sorted(r[0] for r in s.vintages("boundaries").collect()) == [2010, 2020]


def test_geojson(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [2, 3]}}]}')
    got = [r.geometry for r in io.read_geojson(spark, str(tmp_path / "f.json")).collect()]
    assert got == ["POLYGON ((0 0, 1 0, 1 1, 0 0))", "POINT (2 3)"]


def test_federation():
    assert federation.preset("cluster")["spark.sql.shuffle.partitions"] == "96"
    assert "FOREIGN TABLE" in federation.foreign_table("c", "s", "t", "k", "x", "y")
    with pytest.raises(ValueError):
        federation.federated_view("c", "s; drop", "v", "a", "b", "t")
    with pytest.raises(ValueError):
        federation.external_table("c", "s", "t", "/x", "xls", [])


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", ["event_type"], "value", late="400 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = {(r.window_start, r.event_type): r.n for r in spark.table("w").collect()}
    finally:
        q.stop()
    assert got == {(r.window_start, r.event_type): r.n for r in windows.windowed(src, "ts", ["event_type"], "value").collect()}


def test_geocode_cache(spark, tmp_path):
    c = io.GeocodeCache(spark, str(tmp_path / "g"))
    rows_ = "address string, latitude double, longitude double, source string"
    c.put(spark.createDataFrame([("1 Main  St", 40.0, -75.0, "a"), ("2 Oak", 41.0, -76.0, "a")], rows_))
    c.put(spark.createDataFrame([("1 main st", 40.5, -75.5, "b")], rows_))
    got = {r.address: r.source for r in c.get(spark.createDataFrame([("1 MAIN ST",), ("9 Elm",)], "address string")).collect()}
    assert got == {"1 MAIN ST": "b", "9 Elm": None} and c.latest().count() == 2 and c.within(40.9, 41.1, -77, -75).count() == 1


def test_files_and_catalogue(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello")
    io.copy_tree(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert io.exists(spark, str(tmp_path / "b" / "x.txt")) and not io.exists(spark, str(tmp_path / "c"))
    assert text.file_digests(spark, str(tmp_path / "b" / "x.txt")).first().digest == __import__("hashlib").sha256(b"hello").hexdigest()
    assert io.quick_signature(spark, str(tmp_path / "b" / "x.txt")).first().size == 5
    spark.range(1).createOrReplaceTempView("seen_here")
    assert "seen_here" in io.tables(spark) and io.table_info(spark, "seen_here").first().type == "bigint"
    assert io.summary_rows(spark, [(1, None)], ["a", "b"]).first() == ("1", None)


def test_grid_shapes():
    c = int(grid.cell_ids(__import__("numpy").array([40.0]), __import__("numpy").array([-75.0]), 12)[0])
    assert len(grid.ring(c, 1)) == 5 and grid.steps(c, c) == 0 and all(grid.steps(c, n) == 1 for n in grid.neighbours(c))
    assert c in grid.cover_box(39.9, -75.1, 40.1, -74.9, 12) and 1 <= len(grid.region_cover(39.9, -75.1, 40.1, -74.9)) <= 8
    lats, lons = zip(*grid.corners(c), strict=True)
    assert min(lats) <= 40 <= max(lats) and min(lons) <= -75 <= max(lons)
    assert grid.level_for("County") == grid.level_for_area(3000) and grid.infer(level=3) == "s2" and grid.infer() == "h3"
    with pytest.raises(ValueError):
        grid.infer("h3", level=3)


def test_union_and_buffer():
    a, b = geometry.parse("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), geometry.parse("POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))")
    u = geometry.union_rings([a, b])
    assert len(u) == 1 and abs(geometry.shoelace(u[0]) - 7) < 1e-9
    ring = [geometry.parse(f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))") for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    assert geometry.write_wkt(geometry.union_rings(ring)).count("(") == 3 and geometry.write_wkt(geometry.union_rings([])) == "POLYGON EMPTY"
    assert geometry.write_wkt(geometry.union_rings([a, geometry.parse("POLYGON ((5 5, 6 5, 6 6, 5 6, 5 5))")])).startswith("MULTIPOLYGON")


@pytest.mark.parametrize("keep", [50_000, 40])
def test_exact_quantiles(spark, keep):
    import numpy as np

    from lodestone.operators.quantiles import exact_quantiles

    d = np.random.Generator(np.random.PCG64(4))
    for values in (d.normal(size=3000), d.integers(0, 30, 3000).astype(float), np.r_[np.zeros(2500), d.normal(size=500)], d.exponential(size=1), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1]
        assert np.allclose(exact_quantiles(df, "v", shares, keep), np.quantile(values, shares), rtol=1e-12, atol=1e-12)
    assert exact_quantiles(df.limit(0), "v", [0.5]) is None


AREA, HOLED = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
RELATIONS = [
    ("POINT (5 5)", AREA, {"intersects", "within"}),
    ("POINT (5 5)", HOLED, set()),
    ("POINT (4 5)", HOLED, {"intersects", "touches"}),
    ("MULTIPOINT ((5 5), (20 5))", AREA, {"intersects", "crosses"}),
    ("MULTIPOINT (1 1, 2 2)", "MULTIPOINT (2 2, 3 3)", {"intersects", "overlaps"}),
    ("LINESTRING (0 0, 4 0)", "LINESTRING (2 0, 6 0)", {"intersects", "overlaps"}),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (0 4, 4 0)", {"intersects", "crosses"}),
    ("LINESTRING (0 0, 4 4)", "LINESTRING (4 4, 9 0)", {"intersects", "touches"}),
    ("LINESTRING (0 0, 4 0)", "LINESTRING (2 0, 2 5)", {"intersects", "touches"}),
    ("LINESTRING (0 0, 4 0)", "POINT (4 0)", {"intersects", "touches"}),
    ("LINESTRING (0 0, 4 0)", "POINT (2 0)", {"intersects", "contains"}),
    ("LINESTRING (1 0, 9 0)", AREA, {"intersects", "touches"}),
    ("LINESTRING (1 1, 9 1)", AREA, {"intersects", "within"}),
    ("LINESTRING (1 5, 9 5)", HOLED, {"intersects", "crosses"}),
    ("LINESTRING (-5 5, 15 5)", AREA, {"intersects", "crosses"}),
    (AREA, "LINESTRING (-5 5, 15 5)", {"intersects", "crosses"}),
    (AREA, HOLED, {"intersects", "contains"}),
    (AREA, AREA, {"intersects", "contains", "within"}),
    ("POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))", HOLED, {"intersects", "touches"}),
    ("POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))", AREA, {"intersects", "overlaps"}),
    ("POLYGON EMPTY", AREA, set()),
    (None, AREA, set()),
    ("CIRCLE (1 1)", AREA, set()),
]


def test_relations(spark):
    a = spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(RELATIONS)], "k int, g string")
    b = spark.createDataFrame([(k, y) for k, (_, y, _) in enumerate(RELATIONS)], "k int, g string")
    for p in spatial.PREDICATES:
        got = {r[0] for r in spatial.spatial_join(a, b, "g", "g", p).filter("k_left = k_right").select("k_left").collect()}
        assert got == {k for k, (_, _, want) in enumerate(RELATIONS) if p in want}, p
    with pytest.raises(ValueError):
        spatial.spatial_join(a, b, "g", "g", "near")
    with pytest.raises(ValueError):
        spatial.spatial_join(a, b, "g", "g", how="semi")


@pytest.mark.parametrize("size", [None, 0.5, 300.0])
def test_spatial_join_of_very_different_sizes(spark, size):
    rnd = random.Random(7)
    boxes = [[(x, y, x + w, y + w) for x, y, w in ((rnd.uniform(-900, 900), rnd.uniform(-900, 900), rnd.choice([0.25, 3, 60, 900])) for _ in range(90))] for _ in range(2)]
    text_of = lambda b: f"POLYGON (({b[0]} {b[1]}, {b[2]} {b[1]}, {b[2]} {b[3]}, {b[0]} {b[3]}, {b[0]} {b[1]}))"
    a, b = (spark.createDataFrame([(k, text_of(x)) for k, x in enumerate(bs)], f"{n} int, g string") for n, bs in zip("ab", boxes, strict=True))
    want = sorted((i, j) for i, p in enumerate(boxes[0]) for j, q in enumerate(boxes[1]) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    got = [tuple(r) for r in spatial.spatial_join(a, b, "g", "g", size=size).select("a", "b").collect()]
    assert sorted(got) == want


def test_spatial_join_of_empty_tables(spark):
    a, none = spark.createDataFrame([(1, AREA)], "a int, g string"), spark.createDataFrame([], "b int, h string")
    assert rows(spatial.spatial_join(a, none, "g", "h")) == []
    assert rows(spatial.spatial_join(a, none, "g", "h", how="left").select("a", "b")) == [(1, None)]
    assert rows(spatial.spatial_join(none, a, "h", "g", how="outer").select("a", "b")) == [(1, None)]


def test_projection_fixed_values(spark):
    import numpy as np

    forward, back = projection.albers((6_378_206.4, 1 - math.sqrt(1 - 0.00676866)), 29.5, 45.5, 23.0, -96.0)
    x, y = forward(np, -75.0, 35.0)  # the worked example of the textbook on map projections
    assert abs(x - 1_885_472.7) < 0.1 and abs(y - 1_535_925.0) < 0.1
    assert np.allclose(back(np, x, y), (-75.0, 35.0), atol=1e-10)
    forward, back = projection.system("EPSG:32617")
    x, y = forward(np, -(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)
    assert abs(x - 630_084) < 1.5 and abs(y - 4_833_438) < 1.5
    assert np.allclose(forward(np, -81.0, 0.0), (500_000.0, 0.0))
    assert np.allclose(projection.system("EPSG:32733")[0](np, 15.0, -0.0), (500_000.0, 10_000_000.0))
    # 30 degrees along the meridian, by quadrature of the ellipse
    a, e2 = 6_378_137.0, projection.WGS84[1] * (2 - projection.WGS84[1])
    t = (np.arange(100_000) + 0.5) / 100_000 * math.radians(30)
    arc = np.sum(a * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5) * math.radians(30) / 100_000
    assert abs(forward(np, -81.0, 30.0)[1] - 0.9996 * arc) < 1e-4
    for code in ("EPSG:32601", "EPSG:32760", "EPSG:26910", "EPSG:5070", "EPSG:3338", "ESRI:102003", "EPSG:3857"):
        forward, back = projection.system(code)
        x, y = np.array([-178.0, -176.5, -175.0]), np.array([-40.0, 12.0, 61.0])
        if code == "EPSG:26910":
            x = x + 54
        assert np.allclose(back(np, *forward(np, x, y)), (x, y), atol=1e-9), code
    with pytest.raises(ValueError):
        projection.system("EPSG:27700")


def test_reproject(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 1 0, 1 1, 0 0))",), ("SRID=3857;POINT (5 5)",), ("SRID=4326;POINT Z (180 0 7)",), ("POINT (0 90)",), ("POLYGON EMPTY",), (None,)], "g string")
    got = [r[0] for r in projection.reproject(df, ["g"], "EPSG:4326", "EPSG:3857").collect()]
    assert got[0].startswith("POLYGON ((0.0 0.0, 111319.49") and got[1] == "SRID=3857;POINT (5 5)"
    assert got[2].startswith("SRID=3857;POINT (20037508.34") and got[2].endswith(" 0.0)")
    assert got[4:] == ["POLYGON EMPTY", None]
    assert projection.reproject(df, ["g"], "EPSG:4326").collect() == df.collect()
    projection.set_default_system(spark, "epsg:3857")
    try:
        assert projection.default_system(spark) == "EPSG:3857"
        assert projection.reproject(df, ["g"], "EPSG:4326").first()[0] == got[0]
    finally:
        spark.conf.unset(projection.SETTING)
    with pytest.raises(ValueError):
        projection.reproject(df, ["g"], "EPSG:1")
    r = one(spark, projection.project(F.lit(-79.3871389), F.lit(43.6425667), "EPSG:32617").alias("p"))["p"]
    assert abs(r.x - 630_084) < 1.5 and abs(r.y - 4_833_438) < 1.5
    where = spark.createDataFrame([(-79.4, 43.6), (15.0, -33.0), (180.0, 1.0), (-180.0, 1.0)], "x double, y double")
    assert [r[0] for r in where.select(projection.utm_code(F.col("x"), F.col("y"))).collect()] == ["EPSG:32617", "EPSG:32733", "EPSG:32660", "EPSG:32601"]


def test_variables_and_runtimes():
    assert variables.resolve("poverty") == ["B17001_001E", "B17001_002E"]
    assert variables.resolve("B01001_001E") == ["B01001_001E"] == variables.resolve(["B01001_001E"])
    assert variables.resolve("x", {"x": ["a", "b"]}) == ["a", "b"]
    assert variables.with_margins(["B17001_001E", "P1_001N"]) == ["B17001_001E", "B17001_001M", "P1_001N"]
    variables.resolve("income").clear()
    assert len(variables.resolve("income")) == 3
    assert federation.loaders() == ["python"] and federation.loaders(converter=True) == ["ogr2ogr", "sedona", "python"]
    assert federation.loaders(native=True)[0] == "native" and federation.loaders(sedona=True) == ["sedona", "python"]
    assert federation.runtime("17.1.x-scala2.12", sedona=False) == ["native", "sedona", "python"]
    assert federation.runtime("16.4", sedona=False) == ["python"] == federation.runtime(sedona=False)
    assert federation.runtime("9.9", sedona=True) == ["sedona", "python"]


def test_a_collection_is_bounded(spark):
    df = spark.range(3).select("id", F.lit(AREA).alias("g"))
    assert spatial.feature_collection(df, "g", ["id"], limit=3).first()[0].count('"Feature"') == 3
    many = spark.createDataFrame([(1, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")], "id int, g string")
    assert stdjson.loads(many.select(spatial.geojson(many, "g", ["id"])).first()[0]) == {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}
    with pytest.raises(Exception, match="more than 2 features"):
        spatial.feature_collection(df, "g", ["id"], limit=2).collect()


def test_summaries_have_exact_medians(spark):
    df = spark.createDataFrame([(float(k), float(k * k)) for k in range(1, 10)] + [(1.0, None)], "v_2000 double, v_2010 double")
    r = longitudinal.change_summary(df, "v", 2000, 2010).first()
    assert (r.change_median, r.change_max, r.n, r.unchanged) == (20.0, 72.0, 9, 1)
    assert longitudinal.change_summary(df.limit(0), "v", 2000, 2010).first().change_median is None
    assert crosswalk.allocation(spark.createDataFrame([("a", "b", w) for w in (0.1, 0.4, 0.5, 1.0)], "source_geoid string, target_geoid string, area_weight double")).first().median_weight == 0.45


def test_distance_to_any_kind(spark):
    x, y = F.lit(2.0), F.lit(1.0)
    wanted = [
        ("POINT (2 4)", 3.0), ("MULTIPOINT (2 3, 9 9)", 2.0), ("MULTIPOINT ((9 9), (2 0))", 1.0),
        ("LINESTRING (0 0, 4 0)", 1.0), ("LINESTRING (5 -5, 5 5)", 3.0), ("LINESTRING (0 0, 4 0, 4 4, 0 4, 0 0)", 1.0),
        ("MULTILINESTRING ((9 0, 9 9), (2 3, 9 3))", 2.0), ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 0.0),
        ("POLYGON ((-9 -9, 9 -9, 9 9, -9 9, -9 -9), (0 0, 4 0, 4 4, 0 4, 0 0))", 1.0), ("POLYGON EMPTY", None), (None, None),
    ]
    df = spark.createDataFrame([(w,) for w, _ in wanted], "g string")
    assert [r[0] for r in df.select(geometry.distance_from("g", x, y)).collect()] == [d for _, d in wanted]


def test_overlaps_of_long_intervals(spark):
    """Pairs equal plain Python's at every width of cells, and long intervals make few rows on the way."""
    import datetime
    import random

    rnd, day = random.Random(7), datetime.date(1700, 1, 1)
    far = lambda n: day + datetime.timedelta(days=n)

    def made(n):
        rows = []
        for k in range(n):
            s, long = rnd.randrange(200_000), rnd.choice([0, 1, 2, 40, 365, 50_000, 100_000])
            rows.append((k, rnd.choice("xy"), None if rnd.random() < 0.2 else far(s), None if rnd.random() < 0.2 else far(s + long)))
        return rows

    left, right = made(120), [*made(110), (500, "x", far(9), far(3)), (501, "y", None, None), (502, None, None, None)]
    a, b = (spark.createDataFrame(r, "k long, g string, s date, e date").repartition(2) for r in (left, right))
    least, most = datetime.date.min, datetime.date.max
    meets = lambda x, y: (x[2] or least) <= (y[3] or most) and (y[2] or least) <= (x[3] or most) and all(r[2] is None or r[3] is None or r[2] <= r[3] for r in (x, y))
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and meets(x, y))
    for width in (1, 7, 365, 1_000_000):
        got = relational.overlaps(a, b, "s", "e", ["g"], width).select("k_left", "k_right").collect()
        assert sorted(map(tuple, got)) == want, width

    def exploded(plan):
        metric = plan.metrics().get("numOutputRows")
        own = metric.get().value() if plan.nodeName() == "Generate" and metric.isDefined() else 0
        return own + sum(exploded(plan.children().apply(i)) for i in range(plan.children().size()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = relational.overlaps(a, b, "s", "e", ["g"], 30)
        assert len(df.collect()) == len(want)
        assert 0 < exploded(df._jdf.queryExecution().executedPlan()) < 60 * (len(left) + len(right))  # in proportion to the rows; 6,000 cells long otherwise
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_within_metres_beyond_the_poles(spark):
    """Latitudes that run on past a pole are measured as any others: 400 degrees are 40, and 95 are 85 on the other side."""
    rows = [(1, 40.1, 7.0), (2, 400.2, 7.0), (3, -320.1, 7.0), (4, 41.0, 7.0), (5, 139.9, 187.0), (6, 140.0, 187.0), (7, 401.0, 7.0), (8, None, 7.0), (9, 40.0, None), (10, 100.0, 7.0)]
    df = spark.createDataFrame(rows, "k int, lat double, lon double")
    got = {r.k: r.distance_m for r in spatial.within_metres(df, "lat", "lon", (40.0, 7.0), 50_000).collect()}
    degree = math.radians(geometry.EARTH_M)
    assert got == pytest.approx({1: 0.1 * degree, 2: 0.2 * degree, 3: 0.1 * degree, 5: 0.1 * degree, 6: 0.0}, rel=1e-6, abs=1e-1)
    assert {r.k for r in spatial.within_metres(df, "lat", "lon", (400.0, 7.0), 50_000).collect()} == set(got)
    everywhere = {r.k for r in spatial.within_metres(df, "lat", "lon", (40.0, 7.0), 30_000_000).collect()}
    assert everywhere == {1, 2, 3, 4, 5, 6, 7, 10}  # a point without a coordinate is at no distance
