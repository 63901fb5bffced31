"""Cross-sections, structures, crossings and rings: an embedding's first components as places, its label as the road."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomill.operators import structures
from geomill.plans.registry import query
from geomill.plans.spatial import _P, _points
from geomill.session import table

_OFF = 0.0000137
_S = f"""p AS ({_P}), i AS (SELECT label AS spline, vec_id, x, y, row_number() OVER w - 1 AS local_index, count(*) OVER (PARTITION BY label) AS n, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    u AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE -dy / sqrt(dx * dx + dy * dy) END AS ux, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx / sqrt(dx * dx + dy * dy) END AS uy FROM i),
    m AS (SELECT *, CASE WHEN n >= 5 THEN sum(ux) OVER v ELSE ux END AS mx, CASE WHEN n >= 5 THEN sum(uy) OVER v ELSE uy END AS my FROM u WINDOW v AS (PARTITION BY spline ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _points(spark, sf_dir).withColumnRenamed("label", "spline").withColumn("priority", F.col("spline") % 3)
    return structures.cross_sections(samples, "spline", "vec_id", "x", "y", "priority")


@query(
    f"""WITH {_S} SELECT spline, vec_id, local_index, row_number() OVER (ORDER BY spline % 3 DESC, spline, vec_id) - 1 AS section_index, local_index = 0 AS is_start, local_index = n - 1 AS is_end,
    round(mx / sqrt(mx * mx + my * my) + {_OFF}, 6) AS nx, round(my / sqrt(mx * mx + my * my) + {_OFF}, 6) AS ny FROM m"""
)
def cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("spline", "vec_id", "local_index", "section_index", "is_start", "is_end", *[F.round(F.col(c) + _OFF, 6).alias(c) for c in ("nx", "ny")])


_ENDS = f"""p AS ({_P}), i AS (SELECT label AS spline, x, y, x * 100 AS target, y * 100 AS ground, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM p),
    t AS (SELECT spline, tip, x, y, ground FROM i, (VALUES ('s'), ('e')) v(tip) WHERE spline % 4 = 0 AND ((tip = 's' AND k = 0) OR (tip = 'e' AND k = n - 1))),
    r AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = n - 1 THEN 1 ELSE 2 END AS place FROM i WHERE spline % 4 <> 0),
    q AS (SELECT t.spline, t.tip, r.target, row_number() OVER (PARTITION BY t.spline, t.tip ORDER BY sqrt((t.x-r.x)**2 + (t.y-r.y)**2), r.spline, r.place, r.k) AS o FROM t JOIN r ON sqrt((t.x-r.x)**2 + (t.y-r.y)**2) <= 0.02),
    e AS (SELECT t.spline, max(CASE WHEN t.tip = 's' THEN coalesce(q.target, ground) END) AS entry, max(CASE WHEN t.tip = 'e' THEN coalesce(q.target, ground) END) AS exit FROM t LEFT JOIN q ON t.spline = q.spline AND t.tip = q.tip AND o = 1 GROUP BY 1)"""


def _elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir).withColumn("target", F.col("x") * 100).withColumn("ground", F.col("y") * 100)
    return rows.withColumn("structure", F.col("spline") % 4 == 0).withColumn("tunnel", F.col("spline") % 8 == 0)


@query(f"WITH {_ENDS} SELECT spline, round(entry + {_OFF}, 6) AS entry, round(exit + {_OFF}, 6) AS exit FROM e")
def structure_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structures.structure_ends(_elevations(spark, sf_dir), "structure", "target", "ground", 0.02)
    return got.select("spline", *[F.round(F.col(c) + _OFF, 6).alias(c) for c in ("entry", "exit")])


@query(
    f"""WITH {_ENDS}, g AS (SELECT spline, max(k) AS length, min(ground) - 5 AS low FROM i GROUP BY 1), a AS (SELECT i.spline, i.k, i.target, e.entry, e.exit, coalesce(k / nullif(g.length, 0), 0) AS t, CASE WHEN low < least(entry, exit) AND i.spline % 8 = 0 THEN low END AS low FROM i JOIN g ON i.spline = g.spline LEFT JOIN e ON i.spline = e.spline)
    SELECT spline, k AS local_index, round(CASE WHEN entry IS NULL THEN target WHEN low IS NULL THEN entry + (exit - entry) * t WHEN t < 0.5 THEN entry + (low - entry) * (4 * t * t * (3 - 4 * t)) ELSE low + (exit - low) * ((2 * t - 1) * (2 * t - 1) * (3 - 2 * (2 * t - 1))) END + {_OFF}, 6) AS elevation FROM a"""
)
def structure_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structures.integrate_structures(_elevations(spark, sf_dir), "structure", "tunnel", "local_index", "target", "ground", 0.02)
    return got.select("spline", "local_index", F.round(F.col("elevation") + _OFF, 6).alias("elevation"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice - 900 ELSE least(l_extendedprice, l_quantity) END AS low, greatest(l_extendedprice, l_quantity) AS high, CASE WHEN l_linenumber % 2 = 0 THEN greatest(l_extendedprice, l_quantity) - (l_extendedprice - 900) ELSE 0 END AS depth FROM lineitem")
def structure_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("lowest", F.col("l_extendedprice") - 900).withColumn("tunnel", F.col("l_linenumber") % 2 == 0)
    low, high, depth = structures.profile("l_extendedprice", "l_quantity", "lowest", "tunnel")
    return rows.select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"), depth.alias("depth"))


@query()
def mid_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _points(spark, sf_dir).select(F.col("label").alias("road"), F.col("vec_id").alias("place"), "x", "y")
    return structures.mid_crossings(samples, 0.03).select("a", "b", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("along") * 0.17453
    labels = _points(spark, sf_dir).select("label").distinct().withColumn("along", F.explode(F.sequence(F.lit(0), F.lit(35))))
    return labels.select("label", "along", (F.cos(turn) * 0.2 + F.col("label") % 7 * 0.01).alias("sx"), (F.sin(turn) * 0.2).alias("sy"))


_R = "r AS (SELECT label, along, cos(along * 0.17453) * 0.2 + label % 7 * 0.01 AS sx, sin(along * 0.17453) * 0.2 AS sy FROM (SELECT DISTINCT label FROM embeddings), range(0, 36) t(along))"


@query(f"WITH p AS ({_P}), {_R} SELECT vec_id, p.label, arg_min(along, (sqrt((x - sx)**2 + (y - sy)**2), along)) AS along, round(min(sqrt((x - sx)**2 + (y - sy)**2)), 9) AS distance FROM p JOIN r ON p.label = r.label GROUP BY 1, 2")
def nearest_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = structures.nearest_along(_points(spark, sf_dir), _ring(spark, sf_dir), "vec_id", "label")
    return got.select("vec_id", "label", F.col("along").cast("long").alias("along"), F.round("distance", 9).alias("distance"))


@query(f"WITH p AS ({_P}), {_R} SELECT r.label AS ring, p.label AS road, vec_id AS tip, arg_min(along, (sqrt((x - sx)**2 + (y - sy)**2), along)) AS along, round(min(sqrt((x - sx)**2 + (y - sy)**2)), 9) AS distance FROM p, r WHERE sqrt((x - sx)**2 + (y - sy)**2) <= 0.01 GROUP BY 1, 2, 3")
def ring_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _points(spark, sf_dir).select(F.col("label").alias("road"), F.col("vec_id").alias("tip"), "x", "y")
    got = structures.ring_junctions(ends, _ring(spark, sf_dir).withColumnRenamed("label", "ring"), 0.01)
    return got.select("ring", "road", "tip", F.col("along").cast("long").alias("along"), F.round("distance", 9).alias("distance"))


@query(
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 1000 END AS level, l_quantity AS d, (1 - cos(l_quantity / 30 * pi())) / 2 AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN level IS NOT NULL AND d < 30 THEN level * (1 - t) + v * t ELSE v END + {_OFF}, 4) AS elevation, level IS NOT NULL AND d < 30 AS skipped FROM b"""
)
def ring_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("level", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 1000))
    elevation, skipped = structures.blended_from_ring("l_extendedprice", "level", "l_quantity", 30.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(elevation + _OFF, 4).alias("elevation"), skipped.alias("skipped"))


_ROLES = """o AS (SELECT l_orderkey, l_suppkey AS road, max(CAST(floor(l_quantity / 20) AS INT)) AS p, min(l_returnflag) AS m FROM lineitem GROUP BY 1, 2),
    t AS (SELECT *, p = max(p) OVER w AS top, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY l_orderkey)),
    k AS (SELECT l_orderkey, count(*) AS k, min(road) AS leader, count(DISTINCT m) AS ms FROM t WHERE top GROUP BY 1),
    x AS (SELECT t.l_orderkey, road, leader, CASE WHEN n = 1 THEN 'fade' WHEN k > 1 AND ms = 1 THEN 'keep' WHEN top AND k > 1 THEN 'suppress' WHEN top THEN 'keep' ELSE 'adapt' END AS role FROM t JOIN k ON t.l_orderkey = k.l_orderkey)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("road"), F.floor(F.col("l_quantity") / 20).cast("int").alias("p"), "l_returnflag")
    return structures.banking_roles(rows, "l_orderkey", "road", "p", "l_returnflag")


@query(f"WITH {_ROLES} SELECT l_orderkey, road, role, CASE WHEN role = 'adapt' THEN leader END AS leader FROM x")
def banking_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)


@query(f"WITH {_ROLES} SELECT role, count(*) AS n FROM x GROUP BY 1")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.role_histogram(_roles(spark, sf_dir))


@query()
def merged_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.struct(F.round(F.col("embedding")[i].cast("double") * 100, 0).alias("x"), F.round(F.col("embedding")[i + 1].cast("double") * 100, 0).alias("y"))
    curves = table(spark, sf_dir, "embeddings").select("vec_id", F.array(at(0), at(2), at(4)).alias("line"))
    mask = _points(spark, sf_dir).select(F.floor(F.col("x") * 100).alias("x"), F.floor(F.col("y") * 100).alias("y"))
    return structures.merged_curves(curves, "vec_id", "line", 2.0, 45.0, mask)


@query()
def edge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of five lines or more as roads through their block's place; each ends at the first order of its block."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    block = F.floor(F.col("l_orderkey") / 32)
    turn = F.col("l_orderkey") % 32 * 0.19634954084936207
    rows = lines.withColumn("along", (F.row_number().over(w) - 1) * 4.0)
    sections = rows.select(F.col("l_orderkey").alias("spline"), "along", (block * 1000.0 + F.cos(turn) * (F.col("along") + 1)).alias("x"), (F.sin(turn) * (F.col("along") + 1)).alias("y"), F.sin(turn).alias("nx"), (-F.cos(turn)).alias("ny"), F.cos(turn).alias("tx"), F.sin(turn).alias("ty"), F.col("l_quantity").cast("double").alias("target"), ((F.col("l_discount") - 0.05) * 1.0).cast("double").alias("bank"), F.lit(6.0).alias("width"))
    roads = lines.select("l_orderkey", block.alias("block")).distinct()
    first = roads.groupBy("block").agg(F.min("l_orderkey").alias("primary"))
    junctions = roads.join(first, "block").filter("l_orderkey <> primary").select(F.col("l_orderkey").alias("junction"), F.col("l_orderkey").alias("road"), F.lit(True).alias("at_start"), "primary", F.lit(10.0).alias("reach"))
    found = structures.edge_constraints(sections, junctions).filter("left_edge IS NOT NULL")
    return found.select("spline", "along", *[F.round(c, 9).alias(c) for c in ("level", "left_edge", "right_edge")])
