"""Path queries: an embedding's first components as lines, orders as ways between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import paths
from geomill.plans.registry import query
from geomill.plans.spatial import _points
from geomill.session import table

_P = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings"


@query(
    """WITH RECURSIVE w AS (SELECT o_orderkey AS w, o_custkey AS s, o_custkey * 31 % 4001 + 100000 AS e FROM orders),
    t AS (SELECT w, s AS n FROM w UNION SELECT w, e FROM w), l AS (SELECT DISTINCT a.w AS a, b.w AS b FROM t a JOIN t b ON a.n = b.n),
    r(k, c) AS (SELECT a, b FROM l UNION SELECT r.k, l.b FROM r JOIN l ON r.c = l.a) SELECT k AS o_orderkey, min(c) AS "group" FROM r GROUP BY 1"""
)
def roundabout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("s"), (F.col("o_custkey") * 31 % 4001 + 100000).alias("e"))
    return paths.shared_end_groups(ways, "o_orderkey", "s", "e")


@query(
    f"""WITH p AS ({_P}), n AS (SELECT a.vec_id AS e, a.label AS road, b.label AS other, b.vec_id AS r, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS d FROM p a, p b WHERE a.label <> b.label AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= 0.05)
    SELECT e, other, arg_min(r, (d, r)) AS "row", round(min(d), 9) AS distance FROM n GROUP BY 1, 2"""
)
def t_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    ends = p.select(F.col("label").alias("road"), "x", "y", F.col("vec_id").alias("e"))
    rows = p.select(F.col("label").alias("other"), F.col("vec_id").alias("row"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return paths.t_junctions(ends, rows, 0.05).join(ends.select("road", "x", "y", "e"), ["road", "x", "y"]).select("e", "other", "row", F.round("distance", 9).alias("distance"))


@query(
    f"""WITH p AS (SELECT label, x * 100 + 50 AS px, y * 100 + 50 AS py FROM ({_P})),
    c AS (SELECT label, unnest(range(CAST(floor(px - 2) AS BIGINT), CAST(ceil(px + 2) AS BIGINT) + 1)) AS x, px, py FROM p), d AS (SELECT label, x, unnest(range(CAST(floor(py - 2) AS BIGINT), CAST(ceil(py + 2) AS BIGINT) + 1)) AS y, px, py FROM c)
    SELECT DISTINCT label, x, y FROM d WHERE sqrt((x + 0.5 - px)**2 + (y + 0.5 - py)**2) <= 2"""
)
def painted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select("label", (F.col("x") * 100 + 50).alias("px"), (F.col("y") * 100 + 50).alias("py"))
    return paths.painted(p, "label", "px", "py", 2.0).select("label", "x", "y")


@query()
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.struct(F.round(F.col("embedding")[i].cast("double"), 1).alias("x"), F.round(F.col("embedding")[i + 1].cast("double"), 1).alias("y"))
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.array(at(0), at(2), at(4)).alias("line"))
    return paths.joined_paths(lines, "vec_id", "line", 0.05)


@query(
    """WITH c AS (SELECT c_custkey AS id, floor(c_acctbal) AS x, c_custkey % 100 AS y FROM customer), o AS (SELECT * FROM c WHERE id % 3 = 0), p AS (SELECT id, x + 1.5 AS px, y + 1.5 AS py FROM c WHERE id % 3 > 0),
    g AS (SELECT p.id, min(o.id) AS building FROM p JOIN o ON px >= x AND px < x + 25 AND py >= y AND py < y + 25 GROUP BY 1), s AS (SELECT building, 9.0 * count(*) AS covered FROM g GROUP BY 1)
    SELECT id, id AS building, false AS is_part FROM o LEFT JOIN s ON id = building WHERE coalesce(covered, 0) < 0.9 * 625 UNION ALL SELECT id, building, true FROM g UNION ALL SELECT id, id, true FROM p WHERE id NOT IN (SELECT id FROM g)"""
)
def building_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("c_custkey"), F.floor("c_acctbal")
    box = lambda w: F.array(*[F.struct((x + i * w).cast("double").alias("x"), (k % 100 + j * w).cast("double").alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    rings = lambda part, w: table(spark, sf_dir, "customer").filter(part).select(k.alias("id"), box(w).alias("ring"))
    return paths.building_parts(rings("c_custkey % 3 = 0", 25), rings("c_custkey % 3 > 0", 3), 50.0)
