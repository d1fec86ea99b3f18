"""Queries that write tables to the shared folder, read them back, and hold them against the tables they came from."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import encoding, geometry, text, variables
from ..operators.relational import shared_folder
from ..sources import federation, io, shapes, sheets
from .queries import BARS, bars, districts, query, t


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


FACES = "SELECT n_name, 100.0::DOUBLE AS area, 40.0::DOUBLE AS around FROM nation"
PARTS = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


@query("csv_round_trip", PARTS)
def _(s, d):
    p, path = t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), place(s, "csv")
    io.write_csv(p, path, one_file=False)
    return io.read_csv(s, path, p.schema)


@query("csv_types_inferred", "SELECT typeof(o_orderkey)::VARCHAR = 'BIGINT' AS whole, o_orderkey, o_totalprice FROM orders")
def _(s, d):
    path = place(s, "csv")
    io.write(t(s, d, "orders").select("o_orderkey", "o_totalprice"), path, "csv", header=True)
    df = io.read_csv(s, path)
    kinds = dict(df.dtypes)
    return df.select(F.lit(kinds["o_orderkey"] in ("int", "bigint") and kinds["o_totalprice"] == "double").alias("whole"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice")


@query("parquet_round_trip", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders")
def _(s, d):
    path = place(s, "orders")
    io.write(t(s, d, "orders"), path, by=["o_orderstatus"], compression="zstd")
    return io.read_parquet(s, path, ["o_orderstatus", "o_orderkey", "o_totalprice"])


@query("staged_write", "SELECT c_custkey, c_acctbal FROM customer")
def _(s, d):
    path = place(s, "staged")
    io.staged_write(t(s, d, "nation"), path)
    io.staged_write(t(s, d, "customer").select("c_custkey", "c_acctbal"), path)  # in place of what was there
    return io.read_parquet(s, path)


@query("pipe_segments", "SELECT CAST(c_custkey AS VARCHAR) AS LOGRECNO, c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS P1 FROM customer WHERE c_nationkey < 10")
def _(s, d):
    c, geo, data = t(s, d, "customer"), place(s, "geo"), place(s, "segment")
    io.write(c.select(F.when(F.col("c_nationkey") < 10, "050").otherwise("140"), "c_custkey", "c_mktsegment"), geo, "csv", sep="|")
    io.write(c.select("c_custkey", "c_nationkey"), data, "csv", sep="|")
    return io.join_segments(io.read_pipe(s, geo, ["SUMLEV", "LOGRECNO", "name"]), io.read_pipe(s, data, ["LOGRECNO", "P1"]), level="050").select("LOGRECNO", "name", "P1")


@query("table_columns", "SELECT * FROM (VALUES ('r_regionkey', 'int', true), ('r_name', 'string', true)) v(\"column\", type, listed)")
def _(s, d):
    t(s, d, "region").createOrReplaceTempView("own_region")
    return io.table_info(s, "own_region").withColumn("listed", F.lit("own_region" in io.tables(s)))


def _store(s, d):
    store, o = io.Store(s, place(s, "store")), t(s, d, "orders").withColumn("vintage_year", F.year("o_orderdate"))
    # one write for all vintages: partitions come from the column
    o.select(F.col("o_orderkey").alias("geoid"), "o_totalprice", F.lit("tract").alias("geography_type"), "vintage_year").write.partitionBy("geography_type", "vintage_year").parquet(f"{store.root}/boundaries")
    return store


YEARS = "SELECT o_orderkey AS geoid, o_totalprice, year(o_orderdate) AS y FROM orders"


@query("store_at", f"SELECT geoid, o_totalprice FROM ({YEARS}) WHERE y = (SELECT coalesce(max(y) FILTER (y <= 1996), min(y)) FROM ({YEARS}))")
def _(s, d):
    return _store(s, d).at("boundaries", 1996, geography_type="tract").select("geoid", "o_totalprice")


@query("store_vintages", f"SELECT DISTINCT CAST(y AS INTEGER) AS vintage_year FROM ({YEARS})")
def _(s, d):
    return _store(s, d).vintages("boundaries", geography_type="tract").select(F.col("vintage_year").cast("int").alias("vintage_year"))


@query("store_replaces_one_vintage", "SELECT r_regionkey AS k, 1 AS vintage_year FROM region UNION ALL SELECT n_nationkey, 2 FROM nation")
def _(s, d):
    store = io.Store(s, place(s, "store"))
    region, nation = t(s, d, "region").select(F.col("r_regionkey").alias("k")), t(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    store.save("series", region, vintage_year=1)
    store.save("series", region, vintage_year=2)
    store.save("series", nation, vintage_year=2)
    return store.load("series").select("k", F.col("vintage_year").cast("int").alias("vintage_year"))


TERMS = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS term_start, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 700 DAY AS DATE) END AS term_end, o_orderstatus AS office_code FROM orders"


def _reference(s, d):
    root = place(s, "reference")
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("term_start"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(F.to_date("o_orderdate"), 700)).alias("term_end"), F.col("o_orderstatus").alias("office_code"))
    for name, extra in (("office_terms", {}), ("seats", {"state_code": F.lit("a")}), ("redistricting_plans", {"jurisdiction_code": F.col("office_code"), "is_active": F.col("id") % 2 == 0})):
        o.withColumns(extra).write.parquet(f"{root}/{name}")
    return io.Reference(s, root)


@query("reference_terms_as_of", f"SELECT id FROM ({TERMS}) WHERE term_start <= DATE '1996-06-01' AND (term_end IS NULL OR term_end > DATE '1996-06-01')")
def _(s, d):
    return _reference(s, d).scan("office_terms", as_of="1996-06-01").select("id")


@query("reference_current_terms", f"SELECT id FROM ({TERMS}) WHERE term_end IS NULL AND office_code = 'O'")
def _(s, d):
    return _reference(s, d).scan("office_terms", current_only=True, office_code="O").select("id")


@query("reference_seats", f"SELECT id, office_code FROM ({TERMS}) WHERE office_code = 'F'")
def _(s, d):
    return _reference(s, d).scan("seats", office_code="F").select("id", "office_code")


@query("reference_active_plans", f"SELECT id, office_code AS jurisdiction_code FROM ({TERMS}) WHERE id % 2 = 0")
def _(s, d):
    return _reference(s, d).scan("redistricting_plans", active_only=True).select("id", "jurisdiction_code")


POSITIONS = "SELECT c_name AS address, CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 180 AS DOUBLE) AS longitude FROM customer"


def _cache(s, d):
    cache, c = io.GeocodeCache(s, place(s, "geocodes")), t(s, d, "customer")
    cache.put(c.select(F.col("c_name").alias("address"), (F.col("c_custkey") % 90).cast("double").alias("latitude"), (F.col("c_custkey") % 180).cast("double").alias("longitude"), F.lit("own").alias("source")))
    return cache


@query("geocodes_of_addresses", f"SELECT address, latitude, longitude FROM ({POSITIONS}) UNION ALL SELECT s_name, NULL, NULL FROM supplier")
def _(s, d):
    asked = t(s, d, "customer").select(F.col("c_name").alias("address")).union(t(s, d, "supplier").select("s_name"))
    return _cache(s, d).get(asked).select("address", "latitude", "longitude")


@query("geocodes_in_box", f"SELECT address FROM ({POSITIONS}) WHERE latitude BETWEEN 10 AND 40 AND longitude BETWEEN 20 AND 130")
def _(s, d):
    return _cache(s, d).within(10, 40, 20, 130).select("address")


@query("clean_columns", 'SELECT c_name AS "account_name", c_custkey AS "cust_key", c_acctbal AS "bal" FROM customer')
def _(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias(" Cust Key"), F.col("c_acctbal").alias("Bal"), F.col("c_name").alias("Account/Name"))
    return text.to_front(text.sanitised(c), "account_name")


@query("box_texts", "SELECT c_custkey, CAST(c_custkey % 50 AS DOUBLE) AS min_lat, CAST(c_custkey % 50 + 2 AS DOUBLE) AS max_lat, CAST(-(c_custkey % 70) AS DOUBLE) AS min_lon, CAST(5 AS DOUBLE) AS max_lon FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    box = F.concat(F.lit("['"), k % 50, F.lit("', '"), k % 50 + 2, F.lit("', '"), F.negative(k % 70), F.lit("', '5']"))
    c = t(s, d, "customer").select("c_custkey", geometry.bbox_text(box).alias("b"))
    return c.select("c_custkey", "b.min_lat", "b.max_lat", "b.min_lon", "b.max_lon")


@query("plane_distance", "SELECT o_orderkey, round(sqrt(pow(o_custkey - o_orderkey, 2) + pow(o_totalprice, 2)), 4) AS distance FROM orders")
def _(s, d):
    at = lambda n: F.col(n).cast("double")
    return t(s, d, "orders").select("o_orderkey", F.round(geometry.distance(at("o_custkey"), F.lit(0.0), at("o_orderkey"), at("o_totalprice")), 4).alias("distance"))


def _database(s) -> dict[str, str]:
    """The database that comes with Spark: in memory where executors are the driver's own, or else in a folder of the driver."""
    s.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    at = f"{os.path.realpath(tempfile.mkdtemp(prefix='lodestone-'))}/" if io.apart(s) else "memory:"
    return {"url": f"jdbc:derby:{at}m{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@query("jdbc_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    at = _database(s)
    io.write_jdbc(t(s, d, "nation").select("n_name"), table="customer", **at)
    io.write_jdbc(t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), table="customer", mode="overwrite", **at)  # in place of what was there
    return io.read_jdbc(s, query="SELECT * FROM customer", **at)


@query("jdbc_in_parts", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(s, d):
    at, o = _database(s), t(s, d, "orders").select("o_orderkey", "o_totalprice")
    io.write_jdbc(o, table="orders", **at)
    most = o.agg(F.max("o_orderkey")).first()[0] or 1
    return io.read_jdbc(s, query='SELECT "o_orderkey", "o_totalprice" FROM orders WHERE "o_totalprice" > 100000', partition=("o_orderkey", 1, most, 4), **at)


@query("jdbc_shapes", FACES)
def _(s, d):
    at = _database(s)
    io.write_jdbc(districts(s, d), table="districts", **at)
    back = io.read_jdbc(s, query="SELECT * FROM districts", **at)
    return back.select("n_name", geometry.area("shape").alias("area"), geometry.perimeter("shape").alias("around"))


@query("copied_files", "SELECT count(*) AS rows, true AS there, false AS elsewhere, 1 AS digests FROM orders")
def _(s, d):
    a, b = place(s, "source"), place(s, "goal")
    io.write(t(s, d, "orders").coalesce(1), a)
    io.copy_tree(s, a, b)
    digests = text.file_digests(s, f"{a}/*.parquet").unionByName(text.file_digests(s, f"{b}/*.parquet"))
    rows = io.read_parquet(s, b).agg(F.count("*").alias("rows"))
    found = digests.agg(F.count_distinct("digest").cast("int").alias("digests"))
    return rows.crossJoin(found).select("rows", F.lit(io.exists(s, b)).alias("there"), F.lit(io.exists(s, f"{b}-none")).alias("elsewhere"), "digests")


@query("variable_codes", "SELECT * FROM (VALUES ('poverty', 'B17001_001E'), ('poverty', 'B17001_001M'), ('poverty', 'B17001_002E'), ('poverty', 'B17001_002M'), ('pl_h1_housing', 'H1_001N'), ('pl_h1_housing', 'H1_002N'), ('pl_h1_housing', 'H1_003N')) v(subject, code)")
def _(s, d):
    return s.createDataFrame([(g, c) for g in ("poverty", "pl_h1_housing") for c in variables.with_margins(variables.resolve(g))], "subject string, code string")


@query("loader_order", "SELECT * FROM (VALUES ('native', 'native'), ('native', 'ogr2ogr'), ('native', 'sedona'), ('native', 'python'), ('converter', 'ogr2ogr'), ('converter', 'sedona'), ('converter', 'python'), ('sedona', 'sedona'), ('sedona', 'python')) v(there, loader)")
def _(s, d):
    return s.createDataFrame([(k, l) for k in ("native", "converter", "sedona") for l in federation.loaders(**{k: True})], "there string, loader string")


@query("federation_statements", "SELECT * FROM (VALUES (1, 'CREATE FOREIGN TABLE IF NOT EXISTS c.s.t USING CONNECTION k OPTIONS (schema ''x'', table ''y'')'), (2, 'CREATE OR REPLACE VIEW c.s.v AS SELECT * FROM a.b.t'), (3, 'jdbc:postgresql://h:5432/db'), (4, 'census_tract_2020'), (5, 'CREATE SCHEMA IF NOT EXISTS c.s')) v(n, statement)")
def _(s, d):
    made = [federation.foreign_table("c", "s", "t", "k", "x", "y"), federation.federated_view("c", "s", "v", "a", "b", "t"), federation.jdbc_url("h", "db"), federation.census_table(2020, "tract"), federation.foreign_tables("c", "s", "k", "x", ["t", "t"])[0]]
    return s.createDataFrame(list(enumerate(made, 1)), "n int, statement string")


@query("open_intervals", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM (SELECT c_custkey, c_nationkey AS g, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2300-01-01' + CAST(c_custkey AS INTEGER) END AS s, CASE WHEN c_custkey % 2 <> 0 THEN DATE '2300-03-01' + CAST(2 * c_custkey AS INTEGER) END AS e FROM customer) a JOIN (SELECT s_suppkey AS c_custkey, s_nationkey AS g, CASE WHEN s_suppkey % 2 <> 0 THEN DATE '1700-01-01' + CAST(s_suppkey AS INTEGER) END AS s, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2300-02-01' + CAST(s_suppkey AS INTEGER) END AS e FROM supplier) b ON a.g = b.g AND (a.s IS NULL OR b.e IS NULL OR a.s <= b.e) AND (b.s IS NULL OR a.e IS NULL OR b.s <= a.e)")
def _(s, d):
    from ..operators.relational import overlaps

    def given(df, key, group, first, last, every):
        k = F.col(key).cast("int")
        start = F.when(k % every[0] != 0, F.date_add(F.lit(first).cast("date"), k))
        return df.select(F.col(key).alias("k"), F.col(group).alias("g"), start.alias("s"), F.when(k % every[1] != 0, F.date_add(F.lit(last).cast("date"), k * every[2])).alias("e"))

    a = given(t(s, d, "customer"), "c_custkey", "c_nationkey", "2300-01-01", "2300-03-01", (3, 2, 2))
    b = given(t(s, d, "supplier"), "s_suppkey", "s_nationkey", "1700-01-01", "2300-02-01", (2, 5, 1))
    return overlaps(a, b, "s", "e", ["g"]).select(F.col("k_left").alias("a"), F.col("k_right").alias("b"))


@query("json_schema_of_all_rows", "SELECT event_id, CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 1::BIGINT END AS late FROM events")
def _(s, d):
    from ..functions.json import flatten

    e = t(s, d, "events")
    last = e.agg(F.max("event_id").alias("last"))
    j = e.select("event_id").crossJoin(F.broadcast(last)).select("event_id", F.when(F.col("event_id") == F.col("last"), '{"late": 1}').otherwise("{}").alias("p"))  # one row
    return flatten(j, "p").select("event_id", F.col("p_late").alias("late"))


# areas of the districts and the suppliers' lines, through files of shapes
LENGTHS = f"SELECT s_suppkey, v - u AS length FROM ({BARS})"


def _faces(df):
    g = F.col("geometry")
    return df.select(F.get_json_object("properties", "$.n_name").alias("n_name"), geometry.area(g).alias("area"), geometry.perimeter(g).alias("around"))


def _lengths(df):
    return df.select(F.get_json_object("properties", "$.s_suppkey").cast("long").alias("s_suppkey"), geometry.perimeter("geometry").alias("length"))


def _shape_queries(fmt: str, reader) -> None:
    @query(f"{fmt}_areas", FACES)
    def _(s, d):
        path = f"{place(s, fmt)}.{fmt}"
        shapes.write_shapes(districts(s, d).withColumnRenamed("shape", "geometry"), path, fmt)
        return _faces(reader(s, f"{path[: -len(fmt)]}*"))

    @query(f"{fmt}_lines", LENGTHS)
    def _(s, d):
        path = f"{place(s, fmt)}.{fmt}"
        shapes.write_shapes(bars(s, d).withColumnRenamed("bar", "geometry"), path, fmt)
        return _lengths(reader(s, f"{path[: -len(fmt)]}*"))


for _fmt, _reader in (("shp", shapes.read_shapefile), ("gpkg", shapes.read_gpkg), ("kml", shapes.read_kml), ("geojson", io.read_geojson)):
    _shape_queries(_fmt, _reader)


@query("geoparquet_areas", FACES)
def _(s, d):
    path = place(s, "geoparquet")
    shapes.write_shapes(districts(s, d).withColumnRenamed("shape", "geometry"), path, "geoparquet")
    g = encoding.from_wkb("geometry")
    return io.read_parquet(s, path).select("n_name", geometry.area(g).alias("area"), geometry.perimeter(g).alias("around"))


@query("excel_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    path = f"{place(s, 'book')}.xlsx"
    sheets.write_xlsx(t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "customers")
    v = F.col("values")
    return sheets.read_xlsx(s, path, "customers").filter("row > 1").select(v[0].cast("long").alias("c_custkey"), v[1].alias("c_name"), v[2].cast("double").alias("c_acctbal"))
