"""Queries over the whole test tables, each with the SQL that gives the same rows.

Inputs the tables lack, such as crosswalks, districts and validity intervals, are derived by rules stated in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..compat import safe_sum
from ..functions import codes, geoid, geometry, grid, json, moe, projection, text
from ..operators import crosstab, crosswalk, longitudinal, relational, spatial, survey, territory
from ..sources import io
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"a query is registered twice: {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_parquet(spark, f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places: sums of parts differ in their last bits."""
    return df.select([F.round(F.col(f"`{c}`"), places).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def revenue(spark: SparkSession, d: str) -> DataFrame:
    """(nation, year, value): revenue of line items by the customer's nation."""
    l = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    # line items are summed by order first: the join then moves a row an order
    per_order = l.groupBy("l_orderkey").agg(F.sum("value").alias("value"))
    return per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("nation", "year").agg(F.sum("value").alias("value"))


REVENUE = """SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_extendedprice * (1 - l_discount)) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
WIDE = f"""SELECT nation, max(CASE WHEN year = 1996 THEN value END) AS rev_1996, max(CASE WHEN year = 1998 THEN value END) AS rev_1998,
    max(CASE WHEN year = 2000 THEN value END) AS rev_2000 FROM ({REVENUE}) GROUP BY nation"""
YEARS = [1996, 1998, 2000]


def wide_revenue(spark: SparkSession, d: str) -> DataFrame:
    long = revenue(spark, d).filter(F.col("year").isin(YEARS)).withColumn("variable", F.lit("rev"))
    everyone = revenue(spark, d).select("nation").distinct()
    return everyone.join(longitudinal.to_wide(long, "nation", ["rev"], YEARS), "nation", "left")


CHANGE = f"""SELECT *, rev_2000 - rev_1996 AS change, CASE WHEN rev_1996 <> 0 THEN (rev_2000 - rev_1996) * 100 / rev_1996 END AS pct,
    CASE WHEN rev_1996 <> 0 AND rev_2000 / rev_1996 > 0 THEN (pow(rev_2000 / rev_1996, 0.25) - 1) * 100 END AS cagr FROM ({WIDE})"""


def change_frame(spark: SparkSession, d: str) -> DataFrame:
    c = longitudinal.change(wide_revenue(spark, d), "rev", 1996, 2000)
    return c.select("nation", "rev_1996", "rev_1998", "rev_2000", F.col("rev_change_1996_2000").alias("change"), F.col("rev_pct_change_1996_2000").alias("pct"), F.col("rev_cagr_1996_2000").alias("cagr"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation and year, pivoted, its change, and the band of its trend."""
    return longitudinal.classify_trends(change_frame(spark, d), "pct").select("nation", "change", "pct", "cagr", "trend")


TREND = "CASE WHEN pct IS NULL THEN 'unknown' WHEN pct >= 20 THEN 'rapid_growth' WHEN pct >= 5 THEN 'moderate_growth' WHEN pct >= -5 THEN 'stable' WHEN pct >= -20 THEN 'moderate_decline' ELSE 'rapid_decline' END"
query("flagship_trends", f"SELECT nation, round(change, 4) AS change, round(pct, 6) AS pct, round(cagr, 6) AS cagr, {TREND} AS trend FROM ({CHANGE})")(
    lambda s, d: flagship(s, d).select("nation", F.round("change", 4).alias("change"), F.round("pct", 6).alias("pct"), F.round("cagr", 6).alias("cagr"), "trend")
)

# Relational


@query(
    "groupby_agg",
    """SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0.0), 2) AS o_totalprice, count(o_custkey) AS o_custkey, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1""",
)
def _(s, d):
    return rounded(relational.groupby_agg(t(s, d, "orders"), ["o_orderpriority"], {"o_totalprice": "sum", "o_custkey": "count", "o_orderstatus": "max"}), 2)


@query("groupby_moments", "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice, round(var_samp(l_discount), 8) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY 1")
def _(s, d):
    g = relational.groupby_agg(t(s, d, "lineitem"), ["l_returnflag"], {"l_quantity": "mean", "l_extendedprice": "stddev", "l_discount": "variance", "l_tax": "min"})
    return g.select("l_returnflag", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("l_discount", 8).alias("l_discount"), "l_tax")


@query("groupby_null_sum", "SELECT c_mktsegment, round(coalesce(sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END), 0.0), 2) AS v, count(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) AS n FROM customer GROUP BY 1")
def _(s, d):
    c = t(s, d, "customer").withColumn("v", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")))
    return rounded(relational.groupby_agg(c.withColumn("n", F.col("v")), ["c_mktsegment"], {"v": "sum", "n": "count"}), 2)


@query("groupby_first_last", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def _(s, d):
    return relational.groupby_agg(t(s, d, "orders"), ["o_custkey"], {"o_orderstatus": "first", "o_orderpriority": "last"}, order_by="o_orderkey")


# keys that are moved by three leave unmatched rows on both sides
for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    def _whole_join(s, d, how=_how):
        a = t(s, d, "supplier").select((F.col("s_nationkey") + 3).alias("k"), "s_suppkey", F.col("s_name").alias("name"))
        b = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
        return relational.join(a, b, "k", how)

    query(
        f"join_{_how}_whole",
        f"""SELECT coalesce(a.k, b.k) AS k, s_suppkey, a.name AS name_left, b.name AS name_right FROM (SELECT s_nationkey + 3 AS k, s_suppkey, s_name AS name FROM supplier) a
        {_kind} (SELECT n_nationkey AS k, n_name AS name FROM nation) b ON a.k = b.k""",
    )(_whole_join)


@query("join_null_safe", "SELECT coalesce(a.k, b.k) AS k, n, s FROM (SELECT nullif(c_nationkey % 5, 0) AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT nullif(s_nationkey % 5, 0) AS k, count(*) AS s FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def _(s, d):
    a = t(s, d, "customer").groupBy(F.expr("nullif(c_nationkey % 5, 0)").alias("k")).agg(F.count("*").alias("n"))
    b = t(s, d, "supplier").groupBy(F.expr("nullif(s_nationkey % 5, 0)").alias("k")).agg(F.count("*").alias("s"))
    return relational.join(a, b, "k", null_safe=True)


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(s, d):
    return relational.join(t(s, d, "customer").withColumnRenamed("c_custkey", "k"), t(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "semi").select(F.col("k").alias("c_custkey"), "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return relational.join(t(s, d, "customer").withColumnRenamed("c_custkey", "k"), t(s, d, "orders").select(F.col("o_custkey").alias("k")), "k", "anti").select(F.col("k").alias("c_custkey"), "c_name")


@query("filter_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(s, d):
    return t(s, d, "lineitem").filter("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(s, d):
    return relational.top_k(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ties=["o_orderkey"])


@query("top_k_per_key", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def _(s, d):
    return relational.top_k(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", 2, by=["o_custkey"], ties=["o_orderkey"], rank="rank")


@query("share_ranking", "SELECT c_mktsegment, round(v, 2) AS c_acctbal, round(v / t, 6) AS share, CAST(row_number() OVER (ORDER BY v DESC, c_mktsegment) AS INTEGER) AS rank FROM (SELECT c_mktsegment, sum(c_acctbal) AS v, (SELECT sum(c_acctbal) FROM customer) AS t FROM customer GROUP BY 1) ORDER BY v DESC, c_mktsegment LIMIT 3")
def _(s, d):
    r = relational.share_ranking(t(s, d, "customer"), ["c_mktsegment"], "c_acctbal", 3)
    return r.select("c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), F.round("share", 6).alias("share"), "rank")


@query("union_years", "SELECT k, name, extra FROM (SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region)")
def _(s, d):
    return relational.union_all(t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("region").alias("extra")))


INTERVALS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS valid_to, CAST(year(o_orderdate) AS INTEGER) AS vintage_year, o_custkey FROM orders"


def intervals(s, d):
    return t(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 7 != 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("valid_to"), F.year("o_orderdate").alias("vintage_year"), "o_custkey")


@query("valid_at", f"SELECT o_orderkey FROM ({INTERVALS}) WHERE valid_from <= DATE '1999-06-15' AND (valid_to IS NULL OR valid_to >= DATE '1999-06-15')")
def _(s, d):
    return relational.valid_at(intervals(s, d), "1999-06-15").select("o_orderkey")


@query("temporal_filter", f"SELECT o_orderkey FROM ({INTERVALS}) WHERE vintage_year = (SELECT min(vintage_year) FROM ({INTERVALS}))")
def _(s, d):
    return relational.temporal_filter(intervals(s, d), "1950-01-01").select("o_orderkey")


@query("vintage_at", f"SELECT vintage_year, count(*) AS n FROM ({INTERVALS}) WHERE vintage_year = (SELECT max(vintage_year) FROM ({INTERVALS}) WHERE vintage_year <= 1999) GROUP BY 1")
def _(s, d):
    return relational.vintage_at(intervals(s, d), 1999).groupBy("vintage_year").agg(F.count("*").alias("n"))


@query(
    "as_of_join",
    """SELECT user_id, event_id, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC LIMIT 1) AS last_purchase FROM events e WHERE event_type = 'error'""",
)
def _(s, d):
    e = t(s, d, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return relational.as_of(e.filter("event_type = 'error'").select("user_id", "event_id", "ts"), bought, ["user_id"], "ts", "ts", ["last_purchase"]).select("user_id", "event_id", "last_purchase")


@query("interval_overlaps", f"WITH i AS (SELECT * FROM ({INTERVALS}) WHERE valid_to IS NOT NULL) SELECT a.o_custkey AS o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to")
def _(s, d):
    i = intervals(s, d).filter("valid_to is not null").select("o_custkey", "o_orderkey", "valid_from", "valid_to")
    return relational.overlaps(i, i, "valid_from", "valid_to", ["o_custkey"]).filter("o_orderkey_left < o_orderkey_right").select("o_custkey", F.col("o_orderkey_left").alias("a"), F.col("o_orderkey_right").alias("b"))


@query("latest_by", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(s, d):
    return relational.latest_by(t(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id")


@query("to_long", "SELECT s_suppkey, variable, round(value, 2) AS value FROM (SELECT s_suppkey, 's_nationkey' AS variable, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier)")
def _(s, d):
    return rounded(relational.to_long(t(s, d, "supplier"), ["s_suppkey"], ["s_nationkey", "s_acctbal"]), 2)


@query("sql_with_arguments", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def _(s, d):
    return io.sql(s, "SELECT p_brand, count(*) AS n FROM q_part WHERE p_size > :least GROUP BY 1", {"q_part": t(s, d, "part")}, least=25)


# Tables and statistics

CELLS = "SELECT o_orderpriority AS r, o_orderstatus AS c, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2"


def order_table(s, d, margins: bool = True):
    return crosstab.contingency(t(s, d, "orders"), "o_orderpriority", "o_orderstatus", margins=margins)


@query("contingency_margins", "SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS row, CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS col, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def _(s, d):
    return order_table(s, d)


@query("contingency_weighted", "SELECT l_returnflag AS row, l_linestatus AS col, round(sum(l_quantity * l_discount), 4) AS value FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return rounded(crosstab.contingency(t(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "l_discount", margins=False), 4)


@query("contingency_wide", "SELECT r AS row, sum(CASE WHEN c = 'F' THEN v ELSE 0 END) AS F, sum(CASE WHEN c = 'O' THEN v ELSE 0 END) AS O, sum(CASE WHEN c = 'P' THEN v ELSE 0 END) AS P FROM (" + CELLS + ") GROUP BY 1")
def _(s, d):
    return crosstab.wide(order_table(s, d, False), STATUSES)


for _name, _over in (("all", ""), ("index", "PARTITION BY r"), ("columns", "PARTITION BY c")):
    query(f"rate_{_name}", f"SELECT r AS row, c AS col, round(v / sum(v) OVER ({_over}), 9) AS rate FROM ({CELLS})")(lambda s, d, n=_name: rounded(crosstab.rates(order_table(s, d), n), 9))


@query("expected_counts", f"SELECT r AS row, c AS col, v AS value, round(sum(v) OVER (PARTITION BY r) * sum(v) OVER (PARTITION BY c) / sum(v) OVER (), 6) AS expected FROM ({CELLS})")
def _(s, d):
    return rounded(crosstab.expected(order_table(s, d)).select("row", "col", "value", "expected"))


CHI = f"SELECT round(sum((v - e) * (v - e) / e), 6) AS statistic, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS dof, count(*) AS n_cells FROM (SELECT *, sum(v) OVER (PARTITION BY r) * sum(v) OVER (PARTITION BY c) / sum(v) OVER () AS e FROM ({CELLS}))"


@query("chi_square", CHI)
def _(s, d):
    return crosstab.chi_square(order_table(s, d)).drop("p_value")


@query("chi_square_p_value")  # the tail of the distribution has no SQL form; held against fixed values in the tests
def _(s, d):
    return crosstab.chi_square(order_table(s, d))


@query("moe_table", "SELECT l_returnflag AS row, l_linestatus AS col, round(sum(l_extendedprice), 2) AS value, round(sqrt(sum(l_tax * l_extendedprice * l_tax * l_extendedprice)), 4) AS moe FROM lineitem GROUP BY 1, 2")
def _(s, d):
    m = crosstab.moe_table(t(s, d, "lineitem").withColumn("m", F.col("l_tax") * F.col("l_extendedprice")), "l_returnflag", "l_linestatus", "l_extendedprice", "m")
    return m.select("row", "col", F.round("value", 2).alias("value"), F.round("moe", 4).alias("moe"))


@query("null_table", "SELECT k, count(*) FILTER (k IS NULL) AS null_count, count(*) FILTER (k IS NOT NULL) AS not_null_count FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) GROUP BY 1")
def _(s, d):
    return crosstab.null_table(t(s, d, "customer").select(F.expr("nullif(c_nationkey, 3)").alias("k")), "k")


@query("null_totals", "SELECT count(*) FILTER (c_nationkey = 3) AS null_count, count(*) FILTER (c_nationkey <> 3) AS not_null_count FROM customer")
def _(s, d):
    return crosstab.null_totals(t(s, d, "customer").select(F.expr("nullif(c_nationkey, 3)").alias("k")), "k")


FLAGS = "SELECT count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS back FROM lineitem"


@query("flag_summary", f"SELECT 'Count' AS metric, CAST(big AS DOUBLE) AS big, CAST(back AS DOUBLE) AS back FROM ({FLAGS}) UNION ALL SELECT 'Percentage (%)', round(big * 100.0 / n, 6), round(back * 100.0 / n, 6) FROM ({FLAGS}) UNION ALL SELECT 'Total', n, n FROM ({FLAGS})")
def _(s, d):
    return rounded(crosstab.flag_summary(t(s, d, "lineitem").select((F.col("l_quantity") > 25).alias("big"), (F.col("l_returnflag") == "R").alias("back")), ["big", "back"]))


GROUPED = "SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"


@query(
    "group_metrics",
    f"""SELECT g AS o_orderpriority, 'Count' AS metric, CAST(f AS DOUBLE) AS F, CAST(o AS DOUBLE) AS O, CAST(p AS DOUBLE) AS P FROM ({GROUPED})
    UNION ALL SELECT g, 'Percentage (%)', round(f * 100.0 / (f + o + p), 2), round(o * 100.0 / (f + o + p), 2), round(p * 100.0 / (f + o + p), 2) FROM ({GROUPED}) UNION ALL SELECT g, 'Total', f + o + p, f + o + p, f + o + p FROM ({GROUPED})""",
)
def _(s, d):
    return crosstab.group_metrics(t(s, d, "orders"), "o_orderpriority", "o_orderstatus", STATUSES)


@query("pair_matrix", """WITH c AS (SELECT p_brand, p_type, CAST(sum(p_size) AS DOUBLE) AS p_size FROM part GROUP BY ALL), a AS (SELECT p_brand FROM c GROUP BY 1 ORDER BY sum(p_size) DESC, 1 LIMIT 4), b AS (SELECT p_type FROM c GROUP BY 1 ORDER BY sum(p_size) DESC, 1 LIMIT 3)
    SELECT * FROM c WHERE p_brand IN (SELECT * FROM a) AND p_type IN (SELECT * FROM b)""")
def _(s, d):
    return crosstab.pair_matrix(t(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_brand", "p_type", "p_size", 4).filter("true").join(
        relational.top_k(t(s, d, "part").groupBy("p_type").agg(F.sum("p_size").alias("v")), "v", 3, ties=["p_type"]).select("p_type"), "p_type", "left_semi"
    ).select("p_brand", "p_type", "p_size")


@query("heat", "WITH c AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round(v, 6) AS value, round(coalesce((v - (SELECT min(v) FROM c)) / nullif((SELECT max(v) - min(v) FROM c), 0), 0), 6) AS level FROM c")
def _(s, d):
    return rounded(crosstab.heat(t(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"))


@query("correlation", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', round(corr(l_quantity, l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(corr(l_extendedprice, l_extendedprice), 6) FROM lineitem")
def _(s, d):
    return rounded(crosstab.correlation(t(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("describe", "SELECT 'l_quantity' AS \"column\", count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS min, max(l_quantity) AS max, count(*) - count(l_quantity) AS nulls FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 4), round(stddev_samp(l_tax), 4), min(l_tax), max(l_tax), count(*) - count(l_tax) FROM lineitem")
def _(s, d):
    return rounded(crosstab.describe(t(s, d, "lineitem"), ["l_quantity", "l_tax"]).drop("distinct"), 4)


# Survey: customers answer their segment, regions are breaks, and weights follow from keys


def respondents(s, d):
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), (1 + F.col("c_custkey") % 5).cast("double").alias("weight"), F.lit(1.0).alias("value"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 3).cast("string").alias("wave"))


RESP = "SELECT c_custkey, c_mktsegment AS segment, r_name AS region, CAST(1 + c_custkey % 5 AS DOUBLE) AS weight, c_acctbal AS balance, CAST(c_custkey % 3 AS VARCHAR) AS wave FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SURVEY = f"SELECT 'region=' || region AS break_key, segment AS category, sum(weight) AS count, sum(sum(weight)) OVER (PARTITION BY region) AS base FROM ({RESP}) GROUP BY region, segment"


def cells(df: DataFrame) -> DataFrame:
    return rounded(df.select("break_key", "category", "base", "count", "pct"))


@query("survey_cross_tab", f"SELECT break_key, category, base, count, round(count / base, 6) AS pct FROM ({SURVEY})")
def _(s, d):
    return cells(survey.chain(respondents(s, d), "segment", ["region"], weight="weight", kind="cross_tab"))


@query("survey_single_response_top", f"SELECT break_key, category, base, count, round(count / sum(count) OVER (PARTITION BY break_key), 6) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY break_key ORDER BY count DESC, category) AS r FROM ({SURVEY})) WHERE r <= 2")
def _(s, d):
    return cells(survey.chain(respondents(s, d), "segment", ["region"], weight="weight", kind="single_response", top_n=2))


@query("survey_multiple_response", f"SELECT break_key, category, base, count, round(count / base, 6) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY break_key ORDER BY count DESC, category) AS r FROM ({SURVEY})) WHERE r <= 3")
def _(s, d):
    return cells(survey.chain(respondents(s, d), "segment", ["region"], weight="weight", kind="multiple_response", top_n=3))


@query("survey_ranking", f"SELECT break_key, category, count, CAST(row_number() OVER (PARTITION BY break_key ORDER BY count DESC, category) AS INTEGER) AS rank FROM ({SURVEY})")
def _(s, d):
    return survey.chain(respondents(s, d), "segment", ["region"], weight="weight", kind="ranking").select("break_key", "category", "count", "rank")


@query("survey_banner", f"SELECT break_key, category, count FROM ({SURVEY}) UNION ALL SELECT 'wave=' || wave, segment, sum(weight) FROM ({RESP}) GROUP BY 1, 2")
def _(s, d):
    return survey.chain(respondents(s, d), "segment", ["region", "wave"], weight="weight", kind="banner").select("break_key", "category", "count")


@query("survey_mean_scale", f"SELECT 'region=' || region AS break_key, segment AS category, round(avg(balance), 6) AS count, round(coalesce(1.96 * stddev_samp(balance) / sqrt(count(*)), 0), 6) AS ci FROM ({RESP}) GROUP BY region, segment")
def _(s, d):
    return rounded(survey.chain(respondents(s, d), "segment", ["region"], metric="balance", kind="mean_scale").select("break_key", "category", "count", "ci"))


@query("survey_longitudinal", f"WITH c AS (SELECT wave AS break_key, segment AS category, CAST(count(*) AS DOUBLE) AS count FROM ({RESP}) GROUP BY 1, 2) SELECT * FROM c UNION ALL SELECT 'Δ (change)', category, sum(CASE break_key WHEN '2' THEN count WHEN '0' THEN -count ELSE 0 END) FROM c GROUP BY category")
def _(s, d):
    return survey.chain(respondents(s, d), "segment", ["wave"], kind="longitudinal").select("break_key", "category", "count")


@query("survey_table", f"SELECT category, round(sum(CASE WHEN break_key = 'region=ASIA' THEN count / base * 100 END), 6) AS \"region=ASIA\", round(sum(CASE WHEN break_key = 'region=EUROPE' THEN count / base * 100 END), 6) AS \"region=EUROPE\" FROM ({SURVEY}) GROUP BY 1")
def _(s, d):
    return rounded(survey.table(survey.chain(respondents(s, d), "segment", ["region"], weight="weight"), ["region=ASIA", "region=EUROPE"]))


@query("compare_waves", f"WITH c AS (SELECT 'W' || wave AS break_key, segment AS category, CAST(count(*) AS DOUBLE) AS count FROM ({RESP}) GROUP BY 1, 2) SELECT break_key, category, count, round(count / sum(count) OVER (PARTITION BY break_key), 6) AS pct FROM c UNION ALL SELECT 'Δ (last − first)', a.category, b.count - a.count, round(b.count / (SELECT sum(count) FROM c WHERE break_key = 'W2') - a.count / (SELECT sum(count) FROM c WHERE break_key = 'W0'), 6) FROM c a JOIN c b ON a.category = b.category AND a.break_key = 'W0' AND b.break_key = 'W2'")
def _(s, d):
    r = respondents(s, d)
    return rounded(survey.compare_waves([(f"W{k}", r.filter(F.col("wave") == str(k))) for k in range(3)], "segment").select("break_key", "category", "count", "pct"))


@query("column_significance", f"""WITH c AS (SELECT break_key, category, base AS n, count / base AS p FROM ({SURVEY})), k AS (SELECT break_key, row_number() OVER (ORDER BY break_key) AS i FROM (SELECT DISTINCT break_key FROM c)),
    x AS (SELECT c.*, k.i FROM c JOIN k USING (break_key)), h AS (SELECT a.break_key, a.category, b.i FROM x a JOIN x b ON a.category = b.category AND a.i <> b.i AND a.p > b.p
    WHERE (a.p - b.p) / sqrt((a.p * a.n + b.p * b.n) / (a.n + b.n) * (1 - (a.p * a.n + b.p * b.n) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) > 1.96)
    SELECT c.break_key, c.category, (SELECT string_agg(chr(CAST(64 + h.i AS INTEGER)), '' ORDER BY h.i) FROM h WHERE h.break_key = c.break_key AND h.category = c.category) AS sig_flag FROM c""")
def _(s, d):
    return survey.column_significance(survey.chain(respondents(s, d), "segment", ["region"], weight="weight")).select("break_key", "category", "sig_flag")


@query("raked_margins", "SELECT 'AUTOMOBILE' AS segment, 0.3::DOUBLE AS share UNION ALL SELECT 'BUILDING', 0.1 UNION ALL SELECT 'FURNITURE', 0.2 UNION ALL SELECT 'HOUSEHOLD', 0.25 UNION ALL SELECT 'MACHINERY', 0.15")
def _(s, d):
    targets = {"segment": {"AUTOMOBILE": 0.3, "BUILDING": 0.1, "FURNITURE": 0.2, "HOUSEHOLD": 0.25, "MACHINERY": 0.15}, "region": {"AFRICA": 0.2, "AMERICA": 0.2, "ASIA": 0.3, "EUROPE": 0.2, "MIDDLE EAST": 0.1}}
    w = survey.rake(respondents(s, d).drop("weight"), targets)
    total = w.agg(F.sum("weight").alias("t"))
    return w.groupBy("segment").agg(F.sum("weight").alias("v")).crossJoin(F.broadcast(total)).select("segment", F.round(F.col("v") / F.col("t"), 4).alias("share"))


# Longitudinal


@query("change_summary", f"SELECT round(avg(pct), 6) AS pct_change_mean, round(quantile_cont(pct, 0.5), 6) AS pct_change_median, round(stddev_samp(pct), 6) AS pct_change_std, count(*) FILTER (change > 0) AS increased, count(*) FILTER (change < 0) AS decreased, count(change) AS n FROM ({CHANGE})")
def _(s, d):
    return rounded(longitudinal.change_summary(wide_revenue(s, d), "rev", 1996, 2000).select("pct_change_mean", "pct_change_median", "pct_change_std", "increased", "decreased", "n"))


@query("multi_period", f"SELECT nation, round(rev_1998 - rev_1996, 4) AS a, round((rev_2000 - rev_1998) * 100 / rev_1998, 6) AS b FROM ({WIDE})")
def _(s, d):
    m = longitudinal.multi_period(wide_revenue(s, d), "rev")
    return m.select("nation", F.round("rev_change_1996_1998", 4).alias("a"), F.round("rev_pct_change_1998_2000", 6).alias("b"))


@query("changes_long", f"SELECT nation, year, prev_year, round((value - p) * 100 / p, 6) AS pct_change FROM (SELECT *, lag(year) OVER w AS prev_year, lag(value) OVER w AS p FROM ({REVENUE}) WINDOW w AS (PARTITION BY nation ORDER BY year)) WHERE p IS NOT NULL")
def _(s, d):
    return rounded(longitudinal.changes_long(revenue(s, d), ["nation"]).select("nation", "year", "prev_year", "pct_change"))


@query("index_to_base", f"SELECT nation, round(rev_1998 * 100 / rev_1996, 6) AS i98, round(rev_2000 * 100 / rev_1996, 6) AS i00 FROM ({WIDE})")
def _(s, d):
    i = longitudinal.index_to(wide_revenue(s, d), "rev", 1996)
    return i.select("nation", F.round("rev_index_1998", 6).alias("i98"), F.round("rev_index_2000", 6).alias("i00"))


@query("classify_zscore", "SELECT c_custkey, round(z, 6) AS zscore, CASE WHEN z >= 2 THEN 'extreme_positive' WHEN z >= 1 THEN 'high_positive' WHEN z <= -2 THEN 'extreme_negative' WHEN z <= -1 THEN 'high_negative' ELSE 'average' END AS trend FROM (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer)")
def _(s, d):
    return rounded(longitudinal.classify_zscore(t(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "zscore", "trend"))


QUINTILE = "CAST((v > e[2])::INT + (v > e[3])::INT + (v > e[4])::INT + (v > e[5])::INT AS INTEGER)"


@query("classify_quantiles", f"SELECT o_orderkey, ['lowest', 'low', 'middle', 'high', 'highest'][{QUINTILE} + 1] AS trend FROM (SELECT o_orderkey, o_totalprice AS v, (SELECT quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) FROM orders) AS e FROM orders)")
def _(s, d):
    return longitudinal.classify_quantiles(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "trend")


@query("bivariate_crosstab", "WITH e AS (SELECT quantile_cont(l_quantity, [0, 1/3, 2/3, 1]) AS q, quantile_cont(l_extendedprice, [0, 1/3, 2/3, 1]) AS p FROM lineitem) SELECT CAST((l_quantity > q[2])::INT + (l_quantity > q[3])::INT AS INTEGER) AS bin_a, CAST((l_extendedprice > p[2])::INT + (l_extendedprice > p[3])::INT AS INTEGER) AS bin_b, count(*) AS count FROM lineitem, e GROUP BY 1, 2")
def _(s, d):
    return longitudinal.bivariate_crosstab(t(s, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").filter("count > 0")


@query("outliers_iqr", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT outlier, count(*) AS n FROM (SELECT CASE WHEN l_extendedprice < a - 0.5 * (b - a) THEN 'low_outlier' WHEN l_extendedprice > b + 0.5 * (b - a) THEN 'high_outlier' ELSE 'normal' END AS outlier FROM lineitem, q) GROUP BY 1")
def _(s, d):
    return longitudinal.outliers(t(s, d, "lineitem").select("l_extendedprice"), "l_extendedprice", threshold=0.5).groupBy("outlier").agg(F.count("*").alias("n"))


@query("outliers_zscore", "WITH q AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) SELECT outlier, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < m - 1.5 * s THEN 'low_outlier' WHEN c_acctbal > m + 1.5 * s THEN 'high_outlier' ELSE 'normal' END AS outlier FROM customer, q) GROUP BY 1")
def _(s, d):
    return longitudinal.outliers(t(s, d, "customer").select("c_acctbal"), "c_acctbal", "zscore", 1.5).groupBy("outlier").agg(F.count("*").alias("n"))


@query("trend_summary", f"SELECT trend, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM (SELECT {TREND} AS trend FROM ({CHANGE})) GROUP BY 1")
def _(s, d):
    return longitudinal.trend_summary(flagship(s, d))


TREND98 = TREND.replace("pct", "(rev_1998 - rev_1996) * 100 / rev_1996")


@query("compare_trends", f"SELECT nation, {TREND98} AS trend_1, {TREND} AS trend_2, {TREND98} <> {TREND} AS trend_changed, {TREND98} || ' -> ' || {TREND} AS transition FROM ({CHANGE})")
def _(s, d):
    a = longitudinal.classify_trends(longitudinal.change(wide_revenue(s, d), "rev", 1996, 1998), "rev_pct_change_1996_1998")
    return longitudinal.compare_trends(a, flagship(s, d), "nation")


@query("change_detection", "WITH a AS (SELECT o_orderpriority AS k, sum(o_totalprice) FILTER (year(o_orderdate) = 1999) AS c, sum(o_totalprice) FILTER (year(o_orderdate) = 1998) AS h FROM orders GROUP BY 1) SELECT k AS o_orderpriority, round(c, 2) AS current, round(h, 2) AS historical, round((c - h) * 100 / h, 6) AS pct_change, CASE WHEN c > h THEN 'growth' WHEN c < h THEN 'decline' ELSE 'stable' END AS direction FROM a")
def _(s, d):
    o = t(s, d, "orders")
    c = longitudinal.change_detection(o.filter(F.year("o_orderdate") == 1999), o.filter(F.year("o_orderdate") == 1998), "o_orderpriority", "o_totalprice")
    return c.select("o_orderpriority", F.round("current", 2).alias("current"), F.round("historical", 2).alias("historical"), F.round("pct_change", 6).alias("pct_change"), "direction")


for _p, _u in (("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter")):
    query(f"by_period_{_p}", f"SELECT CAST(date_trunc('{_u}', o_orderdate) AS DATE) AS period, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")(
        lambda s, d, p=_p: rounded(longitudinal.by_period(t(s, d, "orders"), "o_orderdate", ["o_orderstatus"], "o_totalprice", p), 2)
    )


@query("time_series", f"WITH v AS ({REVENUE}), g AS (SELECT nation, list(value ORDER BY year) AS l, min(year) AS start_year, max(year) AS end_year, avg(value) AS m, stddev_pop(value) AS sd FROM v GROUP BY 1) SELECT nation, start_year, end_year, round(m, 2) AS mean_value, round(sd, 2) AS std_dev, round(pow(l[len(l)] / l[1], 1.0 / (end_year - start_year)) - 1, 8) AS cagr FROM g")
def _(s, d):
    x = longitudinal.series(revenue(s, d), ["nation"])
    return x.select("nation", "start_year", "end_year", F.round("mean_value", 2).alias("mean_value"), F.round("std_dev", 2).alias("std_dev"), F.round("cagr", 8).alias("cagr"))


@query("adjust_inflation", "SELECT p_partkey, round(p_retailprice * 258.8 / 218.1, 4) AS p_retailprice FROM part")
def _(s, d):
    return rounded(longitudinal.adjust_inflation(t(s, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], 2010, 2020), 4)


# Crosswalks: each supplier's code splits in two, .6 and .4

XWALK = """SELECT s AS source_geoid, t AS target_geoid, sum(w) AS area_weight FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS s, lpad(CAST(s_suppkey % 10 AS VARCHAR), 5, '0') AS t, 0.6::DOUBLE AS w FROM supplier WHERE s_suppkey % 4 <> 3
    UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), lpad(CAST((s_suppkey * 7) % 10 AS VARCHAR), 5, '0'), 0.4::DOUBLE FROM supplier WHERE s_suppkey % 4 <> 3) GROUP BY 1, 2"""


def xwalk(s, d):
    k = t(s, d, "supplier").filter("s_suppkey % 4 <> 3")
    code = lambda c: text.pad(c, 5)
    a = k.select(code(F.col("s_suppkey")).alias("source_geoid"), code(F.col("s_suppkey") % 10).alias("target_geoid"), F.lit(0.6).alias("w"))
    b = k.select(code(F.col("s_suppkey")).alias("source_geoid"), code((F.col("s_suppkey") * 7) % 10).alias("target_geoid"), F.lit(0.4).alias("w"))
    return a.unionByName(b).groupBy("source_geoid", "target_geoid").agg(F.sum("w").alias("area_weight"))


def balances(s, d):
    return t(s, d, "supplier").select(text.pad(F.col("s_suppkey"), 5).alias("geoid"), F.col("s_acctbal").alias("v"))


BAL = "SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS geoid, s_acctbal AS v FROM supplier"


@query("crosswalk_apply", f"SELECT coalesce(target_geoid, geoid) AS geoid, round(sum(v * coalesce(area_weight, 1)), 4) AS v FROM ({BAL}) LEFT JOIN ({XWALK}) ON geoid = source_geoid GROUP BY 1")
def _(s, d):
    return rounded(crosswalk.apply(balances(s, d), xwalk(s, d), "geoid", ["v"]), 4)


@query("crosswalk_mean", f"SELECT coalesce(target_geoid, geoid) AS geoid, round(avg(v * coalesce(area_weight, 1)), 4) AS v FROM ({BAL}) LEFT JOIN ({XWALK}) ON geoid = source_geoid GROUP BY 1")
def _(s, d):
    return rounded(crosswalk.apply(balances(s, d), xwalk(s, d), "geoid", ["v"], how="mean"), 4)


@query("crosswalk_chain", f"WITH x AS ({XWALK}), a AS (SELECT coalesce(target_geoid, geoid) AS geoid, sum(v * coalesce(area_weight, 1)) AS v FROM ({BAL}) LEFT JOIN x ON geoid = source_geoid GROUP BY 1) SELECT coalesce(target_geoid, geoid) AS geoid, round(sum(v * coalesce(area_weight, 1)), 4) AS v FROM a LEFT JOIN x ON geoid = source_geoid GROUP BY 1")
def _(s, d):
    return rounded(crosswalk.apply_chain(balances(s, d), [xwalk(s, d), xwalk(s, d)], "geoid", ["v"]), 4)


@query("crosswalk_sources", f"SELECT source_geoid, count(DISTINCT target_geoid) AS n_targets, round(max(area_weight), 6) AS max_weight, string_agg(target_geoid, ',' ORDER BY target_geoid) AS targets FROM ({XWALK}) GROUP BY 1")
def _(s, d):
    return rounded(crosswalk.per_source(xwalk(s, d)).drop("weights"))


@query("crosswalk_relationship", f"WITH x AS ({XWALK}), t AS (SELECT target_geoid, count(DISTINCT source_geoid) AS n FROM x GROUP BY 1) SELECT source_geoid, CASE WHEN count(DISTINCT target_geoid) > 1 THEN 'SPLIT' WHEN max(n) > 1 THEN 'MERGED' ELSE 'ONE_TO_ONE' END AS relationship FROM x JOIN t USING (target_geoid) GROUP BY 1")
def _(s, d):
    return crosswalk.relationship(xwalk(s, d)).select("source_geoid", "relationship")


@query("crosswalk_labels", f"SELECT source_geoid, target_geoid, CASE WHEN area_weight >= 0.9999 AND source_geoid = target_geoid THEN 'IDENTICAL' WHEN area_weight >= 0.9999 THEN 'RENAMED' WHEN count(*) OVER (PARTITION BY source_geoid) > 1 THEN 'SPLIT' ELSE 'PARTIAL' END AS relationship FROM ({XWALK})")
def _(s, d):
    return crosswalk.labels(xwalk(s, d)).select("source_geoid", "target_geoid", "relationship")


@query("crosswalk_stability", f"WITH x AS ({XWALK}), s AS (SELECT source_geoid, count(DISTINCT target_geoid) AS n, max(area_weight) AS w FROM x GROUP BY 1), t AS (SELECT target_geoid, count(DISTINCT source_geoid) AS n FROM x GROUP BY 1) SELECT (SELECT count(*) FROM s) AS total_source, (SELECT count(*) FROM t) AS total_target, (SELECT count(*) FROM s WHERE n = 1 AND w >= 0.999) AS unchanged, (SELECT count(*) FROM s WHERE n > 1) AS split, (SELECT count(*) FROM t WHERE n > 1) AS merged")
def _(s, d):
    return crosswalk.stability(xwalk(s, d)).drop("churn_rate")


@query("crosswalk_allocation", f"SELECT round(avg(area_weight), 6) AS mean_weight, round(quantile_cont(area_weight, 0.5), 6) AS median_weight, round(stddev_samp(area_weight), 6) AS std_weight, round(avg((area_weight > 0.5)::INT), 6) AS share_above_50 FROM ({XWALK})")
def _(s, d):
    return rounded(crosswalk.allocation(xwalk(s, d)).select("mean_weight", "median_weight", "std_weight", "share_above_50"))


@query("crosswalk_volatile", f"SELECT source_geoid, count(DISTINCT target_geoid) AS n_targets, round(max(area_weight), 6) AS max_weight FROM ({XWALK}) GROUP BY 1 HAVING max(area_weight) < 0.9 ORDER BY 2 DESC, 3, 1 LIMIT 20")
def _(s, d):
    return rounded(crosswalk.volatile(xwalk(s, d)))


@query("crosswalk_reallocation", f"WITH x AS ({XWALK}), a AS (SELECT source_geoid AS origin, target_geoid AS mid, area_weight AS w FROM x WHERE area_weight >= 0.01) SELECT origin, coalesce(x.target_geoid, mid) AS final, round(sum(w * coalesce(x.area_weight, 1)), 6) AS weight FROM a LEFT JOIN x ON mid = x.source_geoid WHERE w * coalesce(x.area_weight, 1) >= 0.01 GROUP BY 1, 2")
def _(s, d):
    return rounded(crosswalk.reallocation([xwalk(s, d), xwalk(s, d)]))


CODES = "SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS geoid, c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN CAST(1 + c_custkey % 9 AS DOUBLE) END AS pop FROM customer"


def coded(s, d):
    return t(s, d, "customer").select(geoid.construct("county", state=F.col("c_nationkey"), county=F.col("c_custkey") % 1000).alias("geoid"), "c_acctbal", F.when(F.col("c_custkey") % 11 != 0, (1 + F.col("c_custkey") % 9).cast("double")).alias("pop"))


@query("rollup_sum", f"SELECT substr(geoid, 1, 2) AS geoid, count(*) AS n_children, round(sum(c_acctbal), 2) AS c_acctbal, 1.0::DOUBLE AS c_acctbal_coverage FROM ({CODES}) GROUP BY 1")
def _(s, d):
    return rounded(crosswalk.rollup(coded(s, d), "geoid", 2, ["c_acctbal"]), 2)


@query("rollup_weighted", f"SELECT substr(geoid, 1, 2) AS geoid, round(CASE WHEN count(*) FILTER (pop IS NULL) = 0 THEN sum(c_acctbal * pop) / sum(pop) ELSE avg(c_acctbal) END, 4) AS c_acctbal FROM ({CODES}) GROUP BY 1")
def _(s, d):
    return rounded(crosswalk.rollup(coded(s, d), "geoid", 2, ["c_acctbal"], "weighted_avg", "pop").select("geoid", "c_acctbal"), 4)


# Scalar functions


@query("geoid_parts", f"SELECT geoid, substr(geoid, 1, 2) AS state, substr(geoid, 3, 3) AS county, lpad(geoid, 11, '0') AS tract_padded, length(geoid) = 5 AS is_county, false AS is_tract FROM ({CODES})")
def _(s, d):
    c = coded(s, d)
    p = geoid.parse("geoid", "county")
    return c.select("geoid", p["state"].alias("state"), p["county"].alias("county"), geoid.normalize("geoid", "tract").alias("tract_padded"), geoid.validate("geoid", "county").alias("is_county"), geoid.validate("geoid", "tract").alias("is_tract"))


SLUGS = "CASE substr(geoid, 1, 2) WHEN '01' THEN 'al' WHEN '02' THEN 'ak' WHEN '04' THEN 'az' WHEN '05' THEN 'ar' WHEN '06' THEN 'ca' WHEN '08' THEN 'co' WHEN '09' THEN 'ct' WHEN '10' THEN 'de' WHEN '11' THEN 'dc' WHEN '12' THEN 'fl' WHEN '13' THEN 'ga' WHEN '15' THEN 'hi' WHEN '16' THEN 'id' WHEN '17' THEN 'il' WHEN '18' THEN 'in' WHEN '19' THEN 'ia' WHEN '20' THEN 'ks' WHEN '21' THEN 'ky' WHEN '22' THEN 'la' WHEN '23' THEN 'me' WHEN '24' THEN 'md' END"


@query("geoid_slugs_whole", f"SELECT geoid, coalesce(st, substr(geoid, 1, 2)) || '-county-' || substr(geoid, 3, 3) AS slug, CASE WHEN st IS NOT NULL THEN geoid END AS back FROM (SELECT geoid, {SLUGS} AS st FROM ({CODES}))")
def _(s, d):
    c = coded(s, d).withColumn("slug", geoid.slug("geoid", "county"))
    return c.select("geoid", "slug", geoid.from_slug("slug").alias("back"))


@query("text_functions", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS squeezed, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS plain, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS n FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", text.squeeze("text").alias("squeezed"), text.alphanumeric("text").alias("plain")).withColumn("n", F.length("plain").cast("long"))


@query("address_hash", "SELECT c_custkey, sha256(lower(c_name || ', ' || c_mktsegment)) AS h FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", text.address_hash(text.address("c_name", "c_mktsegment")).alias("h"))


@query("uuid5", "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || c_name::BLOB) AS h FROM customer)")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", text.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", "c_name").alias("id"))


@query("naics_codes_whole", "SELECT p_partkey, CASE substr(c, 1, 2) WHEN '11' THEN 'Agriculture, Forestry, Fishing and Hunting' WHEN '21' THEN 'Mining, Quarrying, and Oil and Gas Extraction' WHEN '22' THEN 'Utilities' WHEN '23' THEN 'Construction' WHEN '31' THEN 'Manufacturing' WHEN '32' THEN 'Manufacturing' WHEN '33' THEN 'Manufacturing' WHEN '42' THEN 'Wholesale Trade' WHEN '44' THEN 'Retail Trade' WHEN '45' THEN 'Retail Trade' WHEN '48' THEN 'Transportation and Warehousing' WHEN '49' THEN 'Transportation and Warehousing' WHEN '51' THEN 'Information' WHEN '61' THEN 'Educational Services' WHEN '71' THEN 'Arts, Entertainment, and Recreation' WHEN '81' THEN 'Other Services (except Public Administration)' ELSE 'Unknown Sector' END AS title, CAST(length(c) AS INTEGER) AS level, CASE WHEN length(c) > 2 THEN substr(c, 1, length(c) - 1) END AS parent_code FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || '1' AS c FROM part)")
def _(s, d):
    p = t(s, d, "part").withColumn("n", codes.naics(F.concat(F.col("p_size").cast("string"), F.lit("1"))))
    return p.select("p_partkey", "n.title", "n.level", "n.parent_code")


@query("urbanicity", "SELECT o_orderkey, CASE WHEN p >= 250000 THEN CASE WHEN m <= 5 THEN 'city_large' ELSE 'suburb_large' END WHEN p >= 100000 THEN CASE WHEN m <= 5 THEN 'city_midsize' ELSE 'suburb_midsize' END WHEN p >= 25000 THEN CASE WHEN m <= 5 THEN 'city_small' ELSE 'suburb_small' END WHEN p >= 2500 THEN CASE WHEN m <= 5 THEN 'town_fringe' WHEN m <= 25 THEN 'town_distant' ELSE 'town_remote' END ELSE CASE WHEN m <= 5 THEN 'rural_fringe' WHEN m <= 25 THEN 'rural_distant' ELSE 'rural_remote' END END AS locale FROM (SELECT o_orderkey, o_totalprice AS p, o_orderkey % 40 AS m FROM orders)")
def _(s, d):
    return t(s, d, "orders").select("o_orderkey", codes.urbanicity("o_totalprice", F.col("o_orderkey") % 40).alias("locale"))


@query("walkability", "SELECT o_orderkey, CASE WHEN m < 100 THEN 'Trivial' WHEN m < 250 THEN 'Tolerable' WHEN m < 400 THEN 'Moderate' WHEN m < 500 THEN 'Borderline' ELSE 'Outside' END AS grade FROM (SELECT o_orderkey, o_orderkey % 600 AS m FROM orders)")
def _(s, d):
    return t(s, d, "orders").select("o_orderkey", codes.walkability(F.col("o_orderkey") % 600)["grade"].alias("grade"))


@query("moe_functions", "SELECT l_orderkey, l_linenumber, round(m / 1.645, 6) AS se, round(m / 1.645 / v, 6) AS cv, m / 1.645 / v < 0.4 AS reliable, round(v - m, 4) AS lower, round(sqrt(m * m + 100), 6) AS diff_moe FROM (SELECT *, l_extendedprice AS v, l_tax * l_extendedprice AS m FROM lineitem)")
def _(s, d):
    l = t(s, d, "lineitem").withColumn("v", F.col("l_extendedprice")).withColumn("m", F.col("l_tax") * F.col("l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", F.round(moe.se("m"), 6).alias("se"), F.round(moe.cv("v", "m"), 6).alias("cv"), moe.reliable("v", "m").alias("reliable"), F.round(moe.interval("v", "m")["lower"], 4).alias("lower"), F.round(moe.difference(F.col("v"), F.col("m"), F.lit(1.0), F.lit(10.0))["moe"], 6).alias("diff_moe"))


@query("moe_proportion", "SELECT l_orderkey, l_linenumber, round(least(1, p), 6) AS value, round(CASE WHEN a * a - p * p * b * b >= 0 THEN sqrt(a * a - p * p * b * b) ELSE sqrt(a * a + p * p * b * b) END / l_extendedprice * 1.645, 8) AS moe FROM (SELECT *, l_quantity / l_extendedprice AS p, l_tax * 10 / 1.645 AS a, l_discount * 1000 / 1.645 AS b FROM lineitem)")
def _(s, d):
    m = moe.proportion(F.col("l_quantity"), F.col("l_tax") * 10, F.col("l_extendedprice"), F.col("l_discount") * 1000)
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(m["value"], 6).alias("value"), F.round(m["moe"], 8).alias("moe"))


@query("json_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, false AS props_corrupt FROM events")
def _(s, d):
    return json.flatten(t(s, d, "events").select("event_id", "props"), "props", "k bigint")


@query("export_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(s, d):
    return json.for_export(t(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"))


# Places: customers lie on a plane of five by five square districts, one for each nation


def places(s, d):
    c = F.col("c_custkey")
    return t(s, d, "customer").select("c_custkey", ((c * 7 % 4999) / 100 + 0.003).alias("x"), ((c * 13 % 4999) / 100 + 0.003).alias("y"), "c_acctbal")


def districts(s, d):
    n = F.col("n_nationkey")
    x, y = (n % 5 * 10).cast("double"), (F.floor(n / 5) * 10).cast("double")
    return t(s, d, "nation").select("n_name", geometry.box(x, y, x + 10, y + 10).alias("shape"))


PLACES = "SELECT c_custkey, (c_custkey * 7 % 4999) / 100 + 0.003 AS x, (c_custkey * 13 % 4999) / 100 + 0.003 AS y, c_acctbal FROM customer"
INSIDE = f"({PLACES}) JOIN nation ON floor(x / 10) = n_nationkey % 5 AND floor(y / 10) = n_nationkey // 5"


@query("points_in_polygons", f"SELECT c_custkey, n_name FROM {INSIDE}")
def _(s, d):
    return spatial.points_in_polygons(places(s, d), districts(s, d), "x", "y", "shape", size=10.0).select("c_custkey", "n_name")


@query("assign_layers", f"SELECT c_custkey, n_name AS nation_n_name, CASE WHEN x < 25 THEN 'west' END AS half_side FROM {INSIDE}")
def _(s, d):
    half = s.createDataFrame([("west", "POLYGON ((0 0, 25 0, 25 50, 0 50, 0 0))")], "side string, shape string")
    return spatial.assign(places(s, d), {"nation": (districts(s, d), "shape", ["n_name"]), "half": (half, "shape", ["side"])}, "x", "y", 10.0).select("c_custkey", "nation_n_name", "half_side")


@query("district_profile", f"SELECT n_name, round(sum(c_acctbal), 2) AS c_acctbal FROM {INSIDE} GROUP BY 1")
def _(s, d):
    return rounded(spatial.profile(districts(s, d), places(s, d), "n_name", "shape", "x", "y", ["c_acctbal"], 10.0), 2)


def shifted(s, d):
    n = F.col("n_nationkey")
    x, y = (n % 5 * 10 + 4).cast("double"), (F.floor(n / 5) * 10).cast("double")
    return t(s, d, "nation").select(F.col("n_name").alias("target"), geometry.box(x, y, x + 10, y + 10).alias("area"))


SHIFT = "nation a JOIN nation b ON a.n_nationkey // 5 = b.n_nationkey // 5 AND (a.n_nationkey = b.n_nationkey OR a.n_nationkey = b.n_nationkey + 1)"


@query("polygon_overlaps", f"SELECT a.n_name, b.n_name AS target, CASE WHEN a.n_nationkey = b.n_nationkey THEN 60.0 ELSE 40.0 END::DOUBLE AS shared_area FROM {SHIFT}")
def _(s, d):
    return rounded(spatial.polygon_pairs(districts(s, d), shifted(s, d), "shape", "area", "overlaps", 10.0).select("n_name", "target", "shared_area"))


# a line of each supplier, level or upright, against the squares of the districts: intervals say how they lie
BARS = "SELECT s_suppkey, s_suppkey % 2 = 0 AS level, CAST(s_suppkey * 7 % 50 AS DOUBLE) AS u, CAST(s_suppkey * 7 % 50 + 1 + s_suppkey % 13 AS DOUBLE) AS v, CAST(s_suppkey * 3 % 101 AS DOUBLE) / 2 AS w FROM supplier"
LAID = f"SELECT s_suppkey, n_name, u, v, w, CAST(CASE WHEN level THEN n_nationkey % 5 ELSE n_nationkey // 5 END * 10 AS DOUBLE) AS lo, CAST(CASE WHEN level THEN n_nationkey // 5 ELSE n_nationkey % 5 END * 10 AS DOUBLE) AS l2 FROM ({BARS}), nation"
MEETS = "u <= lo + 10 AND v >= lo AND w BETWEEN l2 AND l2 + 10"
INNER = "u < lo + 10 AND v > lo AND w > l2 AND w < l2 + 10"
BAR_SQL = {"intersects": MEETS, "within": f"{INNER} AND u >= lo AND v <= lo + 10", "crosses": f"{INNER} AND (u < lo OR v > lo + 10)", "touches": f"{MEETS} AND NOT ({INNER})"}


def bars(s, d):
    k = F.col("s_suppkey")
    u, w = (k * 7 % 50).cast("double"), (k * 3 % 101).cast("double") / 2
    v = (k * 7 % 50 + 1 + k % 13).cast("double")
    end = lambda a, b: F.concat_ws(" ", F.when(k % 2 == 0, a).otherwise(b).cast("string"), F.when(k % 2 == 0, b).otherwise(a).cast("string"))
    return t(s, d, "supplier").select("s_suppkey", F.concat(F.lit("LINESTRING ("), end(u, w), F.lit(", "), end(v, w), F.lit(")")).alias("bar"))


def _bar_query(name: str, where: str):
    @query(f"lines_{name}", f"SELECT s_suppkey, n_name FROM ({LAID}) WHERE {where}")
    def _(s, d):
        return spatial.spatial_join(bars(s, d), districts(s, d), "bar", "shape", name).select("s_suppkey", "n_name")


for _name, _where in BAR_SQL.items():
    _bar_query(_name, _where)


@query("spatial_join_left", f"SELECT s_suppkey, n_name FROM ({BARS}) LEFT JOIN (SELECT s_suppkey, n_name FROM ({LAID}) WHERE {BAR_SQL['within']}) USING (s_suppkey)")
def _(s, d):
    return spatial.spatial_join(bars(s, d), districts(s, d), "bar", "shape", "within", "left").select("s_suppkey", "n_name")


@query("spatial_join_outer", f"SELECT s_suppkey, n_name FROM (SELECT s_suppkey, n_name FROM ({LAID}) WHERE {BAR_SQL['crosses']}) FULL JOIN supplier USING (s_suppkey) FULL JOIN nation USING (n_name)")
def _(s, d):
    return spatial.spatial_join(districts(s, d), bars(s, d), "shape", "bar", "crosses", "outer").select("s_suppkey", "n_name")


@query("spatial_join_right", f"SELECT b.n_name, c_custkey FROM ({PLACES}) p LEFT JOIN nation b ON floor(x / 10) = n_nationkey % 5 AND floor(y / 10) = n_nationkey // 5 AND n_nationkey < 7")
def _(s, d):
    # the others have no shape, and meet nothing
    some = districts(s, d).join(t(s, d, "nation"), "n_name").select("n_name", F.when(F.col("n_nationkey") < 7, F.col("shape")).alias("shape"))
    return spatial.spatial_join(some, places(s, d).withColumn("at", geometry.point("x", "y")), "shape", "at", "contains", "right").select("n_name", "c_custkey")


@query("distances", f"SELECT c_custkey, round(sqrt(power(x - 25, 2) + power(y - 25, 2)), 6) AS to_place, round(sqrt(power(greatest(20 - x, x - 30, 0), 2) + power(greatest(20 - y, y - 30, 0), 2)), 6) AS to_square, round(abs(y - x) / sqrt(2), 6) AS to_line FROM ({PLACES})")
def _(s, d):
    x, y = F.col("x"), F.col("y")
    square, line = F.lit("POLYGON ((20 20, 30 20, 30 30, 20 30, 20 20))"), F.lit("LINESTRING (-10 -10, 90 90)")
    return rounded(places(s, d).select("c_custkey", geometry.distance(x, y, F.lit(25.0), F.lit(25.0)).alias("to_place"), geometry.distance_from(square, x, y).alias("to_square"), geometry.distance_from(line, x, y).alias("to_line")))


def degrees(s, d):
    """Places of the customers in the middle of North America."""
    return places(s, d).select("c_custkey", (F.col("x") - 120).alias("lon"), (F.col("y") / 2 + 25).alias("lat"))


LONLAT = f"SELECT c_custkey, x - 120 AS lon, y / 2 + 25 AS lat FROM ({PLACES})"
AXIS = "6378137.0"


@query("mercator_points", f"SELECT c_custkey, round(radians(lon) * {AXIS}, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * {AXIS}, 2) AS y FROM ({LONLAT})")
def _(s, d):
    p = degrees(s, d).select("c_custkey", geometry.point("lon", "lat").alias("at"))
    return rounded(projection.reproject(p, ["at"], "EPSG:4326", "EPSG:3857").select("c_custkey", geometry.xy("at").alias("p")).select("c_custkey", "p.x", "p.y"), 2)


# the conic projection of equal areas, by its definition
E2 = "(2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE / 298.257222101)"
Q = f"((1 - {E2}) * (sin(radians({{0}})) / (1 - {E2} * power(sin(radians({{0}})), 2)) - ln((1 - sqrt({E2}) * sin(radians({{0}}))) / (1 + sqrt({E2}) * sin(radians({{0}})))) / (2 * sqrt({E2}))))"
M = f"(cos(radians({{0}})) / sqrt(1 - {E2} * power(sin(radians({{0}})), 2)))"
CONE = f"SELECT *, power({M.format(29.5)}, 2) + n * {Q.format(29.5)} AS c FROM (SELECT (power({M.format(29.5)}, 2) - power({M.format(45.5)}, 2)) / ({Q.format(45.5)} - {Q.format(29.5)}) AS n)"


@query("albers_points", f"SELECT c_custkey, round(rho * sin(n * radians(lon + 96)), 2) AS x, round({AXIS} * sqrt(c - n * {Q.format(23)}) / n - rho * cos(n * radians(lon + 96)), 2) AS y FROM (SELECT *, {AXIS} * sqrt(c - n * {Q.format('lat')}) / n AS rho FROM ({LONLAT}), ({CONE}))")
def _(s, d):
    return rounded(degrees(s, d).select("c_custkey", projection.project(F.col("lon"), F.col("lat"), "EPSG:5070").alias("p")).select("c_custkey", "p.x", "p.y"), 2)


@query("projected_and_back", f"SELECT c_custkey, code, round(lon, 6) AS x, round(lat, 6) AS y FROM ({LONLAT}), (VALUES ('EPSG:32614'), ('EPSG:26915'), ('EPSG:5070'), ('EPSG:3857')) v(code)")
def _(s, d):
    p = degrees(s, d).select("c_custkey", geometry.point("lon", "lat").alias("at"))
    there = lambda c: projection.reproject(projection.reproject(p, ["at"], "EPSG:4326", c), ["at"], c, "EPSG:4326")
    back = relational.union_all(*(there(c).withColumn("code", F.lit(c)) for c in ("EPSG:32614", "EPSG:26915", "EPSG:5070", "EPSG:3857")))
    return rounded(back.select("c_custkey", "code", geometry.xy("at").alias("p")).select("c_custkey", "code", "p.x", "p.y"))


@query("geometry_kinds", "SELECT 'POLYGON' AS kind, CAST(NULL AS INTEGER) AS srid, count(*) AS rows FROM nation UNION ALL SELECT 'LINESTRING', 4326, count(*) FROM supplier")
def _(s, d):
    both = districts(s, d).select(F.col("shape").alias("g")).unionByName(bars(s, d).select(F.concat(F.lit("SRID=4326;"), "bar").alias("g")))
    return projection.kinds(both, "g")


@query("apportion", f"SELECT b.n_name AS target, round(sum(a.n_regionkey * CASE WHEN a.n_nationkey = b.n_nationkey THEN 0.6 ELSE 0.4 END::DOUBLE), 6) AS v, round(sum(a.n_nationkey * CASE WHEN a.n_nationkey = b.n_nationkey THEN 60.0 ELSE 40.0 END) / sum(CASE WHEN a.n_nationkey = b.n_nationkey THEN 60.0 ELSE 40.0 END), 6) AS k FROM {SHIFT} GROUP BY 1")
def _(s, d):
    source = districts(s, d).join(t(s, d, "nation").select("n_name", F.col("n_regionkey").alias("v"), F.col("n_nationkey").alias("k")), "n_name")
    return rounded(spatial.apportion(source, shifted(s, d), "shape", "area", "target", ["v"], ["k"], 10.0))


@query("area_weights", f"SELECT a.n_name AS source_geoid, b.n_name AS target_geoid, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0.6 ELSE 0.4 END::DOUBLE AS area_weight FROM {SHIFT}")
def _(s, d):
    return rounded(spatial.area_weights(districts(s, d), shifted(s, d).select(F.col("target").alias("n_name"), F.col("area").alias("shape")), "n_name", "n_name", "shape", 10.0).select("source_geoid", "target_geoid", "area_weight"))


@query("nearest", f"WITH p AS ({PLACES}), s AS (SELECT s_suppkey, CAST(s_suppkey * 11 % 50 AS DOUBLE) AS tx, CAST(s_suppkey * 17 % 50 AS DOUBLE) AS ty FROM supplier) SELECT c_custkey, s_suppkey AS target, CAST(r AS INTEGER) AS rank, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, s_suppkey) AS r FROM (SELECT c_custkey, s_suppkey, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS dist FROM p, s) WHERE dist <= 5) WHERE r <= 2")
def _(s, d):
    k = F.col("s_suppkey")
    targets = t(s, d, "supplier").select("s_suppkey", (k * 11 % 50).cast("double").alias("tx"), (k * 17 % 50).cast("double").alias("ty"))
    return rounded(spatial.nearest(places(s, d), targets, "x", "y", "tx", "ty", "s_suppkey", 2, 5.0, "c_custkey").select("c_custkey", "target", "rank", "distance"))


@query("compactness", "SELECT n_name, round(pi() / 4, 6) AS polsby_popper, round(2 * sqrt(pi() * 100) / 40, 6) AS schwartzberg, 1.0::DOUBLE AS convex_hull_ratio, round(100 / (pi() * 50), 6) AS reock_mrr FROM nation")
def _(s, d):
    return rounded(spatial.compactness(districts(s, d), "shape").drop("shape"))


@query("plan_facts", "SELECT n_regionkey, count(*) AS n_districts, round((max(p) - avg(p)) * 100 / avg(p), 2) AS max_deviation_pct, round(stddev_samp(p), 1) AS std_population FROM (SELECT n_regionkey, 1000 + n_nationkey * 10.0 AS p FROM nation) GROUP BY 1")
def _(s, d):
    return spatial.plan_facts(t(s, d, "nation").withColumn("p", 1000 + F.col("n_nationkey") * 10.0), "n_regionkey", "p").select("n_regionkey", "n_districts", "max_deviation_pct", "std_population")


@query("within_metres", "SELECT s_suppkey, round(dist, 3) AS distance_m FROM (SELECT s_suppkey, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(s_suppkey * 0.01) / 2), 2))) AS dist FROM supplier) WHERE dist <= 50000")
def _(s, d):
    p = t(s, d, "supplier").select("s_suppkey", (F.lit(40.0) + F.col("s_suppkey") * 0.01).alias("lat"), F.lit(7.0).alias("lon"))
    return rounded(spatial.within_metres(p, "lat", "lon", (40.0, 7.0), 50_000).select("s_suppkey", "distance_m"), 3)


@query("valid_positions", "SELECT c_custkey, coalesce(c_acctbal / 100 BETWEEN -90 AND 90, false) AS ok FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", geometry.valid_position(F.col("c_acctbal") / 100, F.lit(5.0)).alias("ok"))


@query("grid_cells")  # positions on the curve have no SQL form; tests hold them against published cells
def _(s, d):
    c = places(s, d).withColumn("cell", grid.point_cell("y", "x", 12))
    return c.select("c_custkey", grid.token("cell").alias("token"), grid.cell_level("cell").alias("level"), grid.token(grid.parent("cell", 6)).alias("parent"), (grid.from_token(grid.token("cell")) == F.col("cell")).alias("same"))


# Events


@query("windowed_events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return rounded(windows.windowed(t(s, d, "events"), "ts", ["event_type"], "value"), 4)


@query("session_events", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def _(s, d):
    return windows.sessions(t(s, d, "events"), "ts", ["user_id"], "1 day").select("user_id", "session_start", "n")


@query("sum_of_all", "SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS total FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").agg(F.round(safe_sum("l_extendedprice"), 2).alias("total"))


# Territories


@query("dissolve", "SELECT n_regionkey, CAST(count(*) * 100 AS DOUBLE) AS area, CAST(sum(n_nationkey) AS DOUBLE) AS keys FROM nation GROUP BY 1")
def _(s, d):
    own = districts(s, d).join(t(s, d, "nation").select("n_name", "n_regionkey", F.col("n_nationkey").cast("double").alias("keys")), "n_name")
    return rounded(territory.dissolve(own, "n_regionkey", "shape", ["keys"]).select("n_regionkey", geometry.area("shape").alias("area"), "keys"))


@query("locales", f"""SELECT c_custkey, CASE WHEN x BETWEEN 10 AND 20 AND y BETWEEN 10 AND 20 THEN CASE WHEN x <= 14 AND y <= 14 THEN 12 ELSE 21 END WHEN x BETWEEN 30 AND 40 AND y BETWEEN 30 AND 40 THEN CASE WHEN d <= 10 THEN 31 WHEN d <= 35 THEN 32 ELSE 33 END
    WHEN d <= 5 OR c <= 2.5 THEN 41 WHEN d <= 25 OR c <= 10 THEN 42 ELSE 43 END AS locale_code FROM (SELECT *, sqrt(pow(greatest(10 - x, x - 20, 0), 2) + pow(greatest(10 - y, y - 20, 0), 2)) AS d, sqrt(pow(greatest(30 - x, x - 40, 0), 2) + pow(greatest(30 - y, y - 40, 0), 2)) AS c FROM ({PLACES}))""")
def _(s, d):
    m = territory.MILE
    p = places(s, d).select("c_custkey", (F.col("x") * m).alias("x"), (F.col("y") * m).alias("y"))

    def layer(x0, y0, x1, y1, n):
        return s.range(1).select(geometry.box(F.lit(x0 * m), F.lit(y0 * m), F.lit(x1 * m), F.lit(y1 * m)).alias("geometry"), F.lit(n).alias("population"))

    return territory.locale(p, layer(10, 10, 20, 20, 300_000), layer(30, 30, 40, 40, 9_000), layer(10, 10, 14, 14, 120_000), "x", "y").select("c_custkey", "locale_code")


@query("locale_shares", "SELECT n_name, 21 AS locale_code, 0.5::DOUBLE AS share FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_name, 43, CASE n_nationkey WHEN 0 THEN 0.5 ELSE 1 END::DOUBLE FROM nation WHERE n_nationkey <> 6 UNION ALL SELECT n_name, 31, 1.0 FROM nation WHERE n_nationkey = 6")
def _(s, d):
    box = lambda *c: s.range(1).select(geometry.box(*map(F.lit, map(float, c))).alias("geometry"))
    return rounded(territory.locale_shares(districts(s, d).withColumnRenamed("shape", "geometry"), box(0, 0, 5, 10), box(10, 10, 20, 20), "n_name", size=10.0))


@query("in_relation", f"SELECT c_custkey FROM ({PLACES}) WHERE x > 20 AND y > 30")
def _(s, d):
    return territory.in_relation(places(s, d), "x", "y", (20.0, 30.0), "northeast of", "halfplane").select("c_custkey")


@query("plan_at", f"SELECT o_custkey, max(valid_from) AS valid_from FROM ({INTERVALS}) WHERE valid_from <= DATE '1999-06-15' AND (valid_to IS NULL OR valid_to >= DATE '1999-06-15') GROUP BY 1")
def _(s, d):
    return territory.plan_at(intervals(s, d), ["o_custkey"], "1999-06-15", "valid_from", "valid_to").select("o_custkey", "valid_from")


@query("link_parents", f"SELECT geoid, CASE WHEN CAST(substr(geoid, 1, 2) AS INTEGER) % 2 = 0 THEN substr(geoid, 1, 2) END AS parent_geoid FROM ({CODES})")
def _(s, d):
    p = t(s, d, "nation").filter("n_nationkey % 2 = 0").select(text.pad(F.col("n_nationkey"), 2).alias("g"), F.lit(2020).alias("vintage_year"))
    return territory.link_parents(coded(s, d).select("geoid", F.lit(2020).alias("vintage_year")), p, "geoid", "g", 2).select("geoid", "parent_geoid")


@query("demographics_join", "SELECT n_name, n_nationkey, CAST(count(c_custkey) AS BIGINT) AS people FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey < 20 GROUP BY ALL")
def _(s, d):
    n = t(s, d, "nation").select("n_name", "n_nationkey", text.pad(F.col("n_nationkey"), 2).alias("GEOID"))
    data = t(s, d, "customer").filter("c_nationkey < 20").groupBy(F.concat(F.lit("0400000US"), text.pad(F.col("c_nationkey"), 2)).alias("GEO_ID")).agg(F.count("*").alias("people"))
    return territory.demographics(n, data, "GEOID", "GEO_ID").select("n_name", "n_nationkey", F.coalesce("people", F.lit(0)).alias("people"))


@query("wide_years", f"SELECT nation, round(max(CASE WHEN year = 1997 THEN value END), 4) AS value_1997, round(max(CASE WHEN year = 1999 THEN value END), 4) AS value_1999 FROM ({REVENUE}) WHERE year IN (1997, 1999) GROUP BY 1")
def _(s, d):
    r = revenue(s, d)
    return rounded(territory.wide_years({y: r.filter(F.col("year") == y) for y in (1997, 1999)}, "nation", ["value"], None), 4)


@query("hexagons", f"SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM ({PLACES}))")
def _(s, d):
    return territory.hexagons(places(s, d), "x", "y", 2.0).agg(F.sum("n").alias("n"))


@query("snapshot_maps", "SELECT l_orderkey, l_linenumber, l_quantity AS estimate, CASE WHEN l_tax > 0 THEN l_tax END AS margin FROM lineitem")
def _(s, d):
    l = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("B1_001E"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("B1_001M"))
    m = l.select("l_orderkey", "l_linenumber", moe.snapshot(l, ["B1_001E"]).alias("v"), moe.snapshot(l, ["B1_001M"]).alias("m"))
    return m.select("l_orderkey", "l_linenumber", F.try_element_at("v", F.lit("B1_001E")).alias("estimate"), moe.moe_of("m", F.lit("B1_001E")).alias("margin"))


@query("fuzzy_match", "WITH w AS (SELECT p_partkey, p_name, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), c AS (SELECT * FROM (VALUES ('red widget'), ('small ring'), ('big gear')) AS v(title)), x AS (SELECT title, unnest(string_split(title, ' ')) AS w FROM c) SELECT p_partkey, title, round(count(*) / greatest(len(list_distinct(string_split(lower(any_value(p_name)), ' '))), 2), 3) AS score FROM w JOIN x USING (w) GROUP BY p_partkey, title")
def _(s, d):
    c = s.createDataFrame([("red widget",), ("small ring",), ("big gear",)], "title string")
    return text.fuzzy_match(t(s, d, "part").select("p_partkey", "p_name"), "p_name", c, "title").select("p_partkey", "title", "score")


@query("adjacent_components", "SELECT n_name, (SELECT min(n_name) FROM nation b WHERE b.n_nationkey // 5 = nation.n_nationkey // 5) AS component FROM nation")
def _(s, d):
    n = F.col("n_nationkey")
    x, y = (n % 5 * 10).cast("double"), (F.floor(n / 5) * 20).cast("double")
    rows_ = t(s, d, "nation").select("n_name", geometry.box(x, y, x + 10, y + 10).alias("shape"))
    return spatial.adjacent_components(rows_, "n_name", "shape", 10.0)


@query("covering", "SELECT n_name FROM nation WHERE n_nationkey = 12")
def _(s, d):
    return spatial.covering(districts(s, d), "shape", 23.5, 27.25).select("n_name")


@query("buffered_area", "SELECT n_name, round(100 + 40 * 2 + 16 * 4 * sin(pi() / 16), 6) AS area FROM nation")
def _(s, d):
    return rounded(districts(s, d).select("n_name", geometry.area(geometry.buffer(F.col("shape"), F.lit(2.0))).alias("area")))


@query("named_codes", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Houses' ELSE c_mktsegment END AS name FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", text.named("c_mktsegment", {"building": "Houses"}).alias("name"))
