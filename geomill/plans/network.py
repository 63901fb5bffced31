"""Road-network queries: orders as junctions, their lines as the roads that meet there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import network
from geomill.plans.registry import query
from geomill.session import table

#: Added before rounding: moves values that lie exactly between two results off the edge, where engines differ.
_OFF = 0.0000137
_M = "SELECT l_orderkey, l_partkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS road, l_extendedprice AS v, l_quantity AS p, l_discount * 100 AS d, l_tax * 1000 + 1 AS len, CAST(l_partkey * 37 % 360 AS DOUBLE) AS angle, l_linenumber = 1 AS thru FROM lineitem"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 100000 + n).alias("road"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("p"), (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 1000 + 1).alias("len"), (F.col("l_partkey") * 37 % 360).cast("double").alias("angle"), (F.col("l_linenumber") == 1).alias("thru")
    )


@query(f"SELECT l_orderkey, round(sum(v * p / (d + 0.1)) / sum(p / (d + 0.1)) + {_OFF}, 4) AS level FROM ({_M}) GROUP BY 1")
def junction_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.junction_levels(_members(spark, sf_dir), "l_orderkey", "v", "p", "d").select("l_orderkey", F.round(F.col("level") + _OFF, 4).alias("level"))


@query(f"SELECT l_orderkey, round(sum(v * p * p) / sum(p * p) + {_OFF}, 4) AS level FROM ({_M}) GROUP BY 1")
def crossing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.crossing_levels(_members(spark, sf_dir), "l_orderkey", "v", "p").select("l_orderkey", F.round(F.col("level") + _OFF, 4).alias("level"))


_GAPS = f"SELECT * REPLACE (CASE WHEN l_linenumber % 3 > 0 THEN v END AS v) FROM (SELECT m.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY road) AS l_linenumber FROM ({_M}) m)"


@query(
    f"""SELECT l_orderkey, round(sum(v * p / (d + 0.1)) / sum(p / (d + 0.1)) FILTER (v IS NOT NULL) + {_OFF}, 4) AS junction, round(sum(v * p * p) / sum(p * p) FILTER (v IS NOT NULL) + {_OFF}, 4) AS crossing FROM ({_GAPS}) GROUP BY 1"""
)
def levels_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third road of a junction has no elevation."""
    from pyspark.sql import Window as W

    members = _members(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("l_orderkey").orderBy("road")))
    gaps = members.withColumn("v", F.when(F.col("i") % 3 > 0, F.col("v")))
    junction = network.junction_levels(gaps, "l_orderkey", "v", "p", "d").select("l_orderkey", F.round(F.col("level") + _OFF, 4).alias("junction"))
    crossing = network.crossing_levels(gaps, "l_orderkey", "v", "p").select("l_orderkey", F.round(F.col("level") + _OFF, 4).alias("crossing"))
    return junction.join(crossing, "l_orderkey")


@query(
    f"""WITH m AS ({_M}), r AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY len DESC, road) AS r FROM m),
    s AS (SELECT l_orderkey, max(n) AS n, max(CASE WHEN r = 1 THEN v END) AS v1, max(CASE WHEN r = 2 THEN v END) AS v2, max(CASE WHEN r = 1 THEN len END) AS l1, max(CASE WHEN r = 2 THEN len END) AS l2, sum(v * len) / sum(len) AS bl FROM r GROUP BY 1),
    p AS (SELECT a.l_orderkey, a.road AS ra, b.road AS rb, (a.v + b.v) / 2 AS pv, CASE WHEN abs(a.angle - b.angle) % 360 > 180 THEN 360 - abs(a.angle - b.angle) % 360 ELSE abs(a.angle - b.angle) % 360 END AS apart FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.road < b.road),
    q AS (SELECT l_orderkey, pv FROM p WHERE apart >= 140 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY apart DESC, ra, rb) = 1)
    SELECT s.l_orderkey, round(CASE WHEN n = 1 THEN v1 WHEN n = 2 THEN CASE WHEN l2 > 0.8 * l1 THEN (v1 + v2) / 2 ELSE v1 END ELSE coalesce(pv, bl) END + {_OFF}, 4) AS level FROM s LEFT JOIN q ON s.l_orderkey = q.l_orderkey"""
)
def equal_priority_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.equal_priority_levels(_members(spark, sf_dir), "l_orderkey", "road", "v", "len", "angle").select("l_orderkey", F.round(F.col("level") + _OFF, 4).alias("level"))


@query(
    f"""WITH g AS (SELECT l_orderkey, arg_max(v, (p, -road)) FILTER (thru) AS top, sum(CASE WHEN NOT thru THEN v * p END) / nullif(sum(CASE WHEN NOT thru THEN p END), 0) AS ending, sum(v * p) / sum(p) AS al FROM ({_M}) GROUP BY 1)
    SELECT l_orderkey, round(CASE WHEN top IS NULL OR (ending IS NOT NULL AND abs(top - ending) < 500) THEN al ELSE top END + {_OFF}, 4) AS level FROM g"""
)
def t_junction_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.t_junction_levels(_members(spark, sf_dir), "l_orderkey", "road", "v", "p", "thru", 500.0).select("l_orderkey", F.round(F.col("level") + _OFF, 4).alias("level"))


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS roads, CASE WHEN count(DISTINCT l_partkey) = 1 THEN 'Endpoint' WHEN bool_or(l_linenumber = 1) THEN 'T' WHEN count(DISTINCT l_partkey) = 2 THEN 'Y' WHEN count(DISTINCT l_partkey) <= 4 THEN 'X' ELSE 'Complex' END AS kind FROM lineitem GROUP BY 1")
def junction_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("thru", F.col("l_linenumber") == 1)
    return network.junction_kinds(rows, "l_orderkey", "l_partkey", "thru")


@query(
    """WITH i AS (SELECT o_custkey, o_totalprice AS level, CAST(o_orderkey % 120 AS DOUBLE) AS d FROM orders),
    n AS (SELECT o_custkey, sum(level * (1 - (1 - cos(d / 50 * pi())) / 2)) AS vw, sum(1 - (1 - cos(d / 50 * pi())) / 2) AS w FROM i WHERE d < 50 GROUP BY 1)
    SELECT c_custkey, round(CASE WHEN w > 0 THEN c_acctbal * (1 - least(w, 1)) + vw / w * least(w, 1) ELSE c_acctbal END, 4) AS spread FROM customer LEFT JOIN n ON c_custkey = o_custkey"""
)
def spread_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    influences = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("level"), (F.col("o_orderkey") % 120).cast("double").alias("d"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return network.spread(rows, ["c_custkey"], "c_acctbal", influences, "level", "d", 50.0).select("c_custkey", F.round("spread", 4).alias("spread"))


@query(
    f"""WITH t AS (SELECT *, greatest(10, least(50, l_tax * 400)) AS reach FROM lineitem), u AS (SELECT *, greatest(0, least(1, l_quantity / reach)) AS t FROM t)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < reach THEN l_discount * 1000 * (1 - t*t*t*(t*(t*6-15)+10)) + l_extendedprice * t*t*t*(t*(t*6-15)+10) ELSE l_extendedprice END + {_OFF}, 4) AS tapered FROM u"""
)
def tapered_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ground", F.col("l_discount") * 1000).withColumn("width", F.col("l_tax") * 100)
    return rows.select("l_orderkey", "l_linenumber", F.round(network.taper("l_extendedprice", "ground", "l_quantity", "width") + _OFF, 4).alias("tapered"))


@query("SELECT l_orderkey, round(greatest(2 * avg(l_quantity) + 0.5 * avg(l_quantity) * (count(*) - 2), 40), 6) AS radius FROM lineitem GROUP BY 1")
def plateau_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("w"), F.count("*").alias("n"))
    return roads.select("l_orderkey", F.round(network.plateau_radius("w", "n", 80.0), 6).alias("radius"))


@query(
    """WITH m AS (SELECT o_custkey, o_totalprice AS g, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 1.1 END AS v, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS p FROM orders),
    a AS (SELECT o_custkey, avg(g) AS g, sum(v * p) / sum(CASE WHEN v IS NOT NULL THEN p END) AS c, sqrt(sum(CASE WHEN v IS NOT NULL THEN p END) / nullif(count(v), 0)) AS w FROM m GROUP BY 1)
    SELECT o_custkey, round(coalesce((g + c * w) / (1 + w), g), 3) AS level FROM a"""
)
def roundabout_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("g"), F.when(k % 3 == 0, F.col("o_totalprice") * 1.1).alias("v"), (k % 7 + 1).cast("double").alias("p"))
    return network.roundabout_level(rows, "o_custkey", "g", "v", "p").select("o_custkey", F.round("level", 3).alias("level"))


@query(
    """SELECT 'l_returnflag' AS dimension, l_returnflag AS name, count(*) AS n, round(sum(l_quantity), 3) AS length FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), round(sum(l_quantity), 3) FROM lineitem GROUP BY 2"""
)
def network_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = network.network_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return got.select("dimension", "name", "n", F.round("length", 3).alias("length"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey % 500 AS at, o_totalprice AS level FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    i AS (SELECT o.o_custkey, o.o_orderkey, c.level, abs(o.o_orderkey % 500 - c.at) AS d, o.o_totalprice AS v FROM orders o JOIN c ON o.o_custkey = c.o_custkey)
    SELECT o_orderkey, round(CASE WHEN d < 100 THEN v * (1 - (1 - (1 - cos(d / 100 * pi())) / 2)) + level * (1 - (1 - cos(d / 100 * pi())) / 2) ELSE v END, 3) AS height FROM i"""
)
def influenced_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 500).alias("at0"), F.col("o_totalprice").alias("v"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("n = 1")
    near = network.influences_along(rows, ["o_custkey", "o_orderkey"], "at0", rows.select("o_custkey", "o_orderkey").join(first.select("o_custkey", F.col("at0").alias("at"), F.col("v").alias("level")), "o_custkey"), "at", "level")
    return network.spread(rows, ["o_custkey", "o_orderkey"], "v", near, "level", "distance", 100.0).select("o_orderkey", F.round("spread", 3).alias("height"))


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v, l_quantity AS p, l_partkey % 4 AS road, CAST(l_suppkey % 90 AS DOUBLE) AS d, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 4 ORDER BY abs(l_suppkey % 90 - 60), l_suppkey % 90, l_extendedprice) AS n FROM lineitem),
    a AS (SELECT l_orderkey, v, p, road, d FROM r WHERE n = 1), g AS (SELECT l_orderkey, sum(v * p) / sum(p) AS level FROM a GROUP BY 1)
    SELECT a.l_orderkey, a.road, round(CASE WHEN d < 40 THEN level * (1 - (1 - cos(d / 40 * pi())) / 2) + v * (1 - cos(d / 40 * pi())) / 2 ELSE v END + {_OFF}, 3) AS flat FROM a JOIN g ON a.l_orderkey = g.l_orderkey"""
)
def flattened_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    d = F.col("l_suppkey") % 90
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("p"), (F.col("l_partkey") % 4).alias("road"), d.cast("double").alias("d"), F.lit(40.0).alias("r"))
    one = rows.withColumn("n", F.row_number().over(W.partitionBy("l_orderkey", "road").orderBy(F.abs(F.col("d") - 60), "d", "v"))).filter("n = 1").drop("n")
    return network.plateaus(one, "l_orderkey", "v", "p", "d", "r", 60.0).select("l_orderkey", "road", F.round(F.col("flat") + _OFF, 3).alias("flat"))
