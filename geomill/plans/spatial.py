"""Spatial queries: the first two components of an embedding, or a customer's balance and key, as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import projection, spatial
from geomill.plans.registry import query
from geomill.session import table

_P = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings"
_C = "SELECT c_custkey, c_acctbal AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y, c_mktsegment, c_nationkey FROM customer"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"), "c_mktsegment", "c_nationkey")


@query(f"SELECT vec_id FROM ({_P}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0 AND 0.2")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).filter(spatial.in_box("x", "y", (-0.1, 0.0, 0.1, 0.2))).select("vec_id")


_BOXES = f"b AS (SELECT c_nationkey AS k, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ({_C}) WHERE c_mktsegment = 'BUILDING' GROUP BY 1)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir).filter("c_mktsegment = 'BUILDING'")
    return c.groupBy("c_nationkey").agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).alias("box"))


@query(f"WITH {_BOXES} SELECT a.k AS a, b.k AS b, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS contains FROM b a, b WHERE a.k = b.k - 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def meeting_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    a = boxes.select(F.col("c_nationkey").alias("a"), F.col("box").alias("p"), (F.col("c_nationkey") + 1).alias("b"))
    pairs = a.join(boxes.select(F.col("c_nationkey").alias("b"), F.col("box").alias("q")), "b").filter(spatial.boxes_meet("p", "q"))
    return pairs.select("a", "b", spatial.box_contains("p", "q").alias("contains"))


@query(
    """WITH b AS (SELECT r_regionkey AS k, CAST(r_regionkey AS DOUBLE) AS x0, 45.0 AS y0, r_regionkey + 0.05 AS x1, 45.03 AS y1 FROM region),
    n AS (SELECT *, CAST(greatest(ceil((y1 - y0) * 111320 / 1000), 1) AS BIGINT) AS nr, CAST(greatest(ceil((x1 - x0) * 111320 * cos(radians((y0 + y1) / 2)) / 1000), 1) AS BIGINT) AS nc FROM b)
    SELECT k, r AS row, c AS col, round(x0 + (x1 - x0) * c / nc, 9) AS x0, round(y0 + (y1 - y0) * r / nr, 9) AS y0 FROM n, range(0, 20) t(r), range(0, 20) u(c) WHERE r < nr AND c < nc"""
)
def box_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey").cast("double")
    boxes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.struct(k.alias("x0"), F.lit(45.0).alias("y0"), (k + 0.05).alias("x1"), F.lit(45.03).alias("y1")).alias("box"))
    return spatial.split_box(boxes, "box", 1000.0).select("k", F.col("chunk.row").alias("row"), F.col("chunk.col").alias("col"), F.round("chunk.x0", 9).alias("x0"), F.round("chunk.y0", 9).alias("y0"))


_LINES = "l AS (SELECT vec_id, list_transform(range(1, 9), lambda i: {x: CAST(embedding[2*i-1] AS DOUBLE), y: CAST(embedding[2*i] AS DOUBLE)}) AS line FROM embeddings)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", line.alias("line"))


@query(
    f"""WITH {_LINES}, s AS (SELECT vec_id, unnest(range(1, 9)) AS i, line FROM l)
    SELECT vec_id FROM s GROUP BY vec_id HAVING bool_or(line[i].x BETWEEN 0.2 AND 0.25 AND line[i].y BETWEEN 0.2 AND 0.25)
    OR bool_or(i < 8 AND NOT ((line[i].x < 0.2 AND line[i+1].x < 0.2) OR (line[i].x > 0.25 AND line[i+1].x > 0.25) OR (line[i].y < 0.2 AND line[i+1].y < 0.2) OR (line[i].y > 0.25 AND line[i+1].y > 0.25)))"""
)
def lines_meeting_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter(spatial.line_meets_box("line", (0.2, 0.2, 0.25, 0.25))).select("vec_id")


@query(f"WITH {_LINES}, s AS (SELECT vec_id, unnest(range(1, 8)) AS i, line FROM l) SELECT vec_id, round(sum(sqrt((line[i].x - line[i+1].x)**2 + (line[i].y - line[i+1].y)**2)), 9) AS length FROM s GROUP BY 1")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("vec_id", F.round(spatial.path_length("line"), 9).alias("length"))


@query(
    f"""WITH RECURSIVE {_LINES}, f(vec_id, i, last, n) AS (SELECT vec_id, 1, line[1], 1 FROM l UNION ALL
    SELECT f.vec_id, f.i + 1, CASE WHEN sqrt((line[f.i+1].x - last.x)**2 + (line[f.i+1].y - last.y)**2) > 0.15 THEN line[f.i+1] ELSE last END, n + CASE WHEN sqrt((line[f.i+1].x - last.x)**2 + (line[f.i+1].y - last.y)**2) > 0.15 THEN 1 ELSE 0 END
    FROM f JOIN l ON f.vec_id = l.vec_id WHERE f.i < 8) SELECT vec_id, n FROM f WHERE i = 8"""
)
def close_points_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("vec_id", F.size(spatial.drop_close_points("line", 0.15)).alias("n"))


@query(f"SELECT vec_id, round((x + 0.5) * 1024, 6) AS px, round((1 - (y + 0.5)) * 1024, 6) AS py FROM ({_P})")
def pixel_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = spatial.to_pixels("x", "y", (-0.5, -0.5, 0.5, 0.5), 1024, from_top=True)
    return _points(spark, sf_dir).select("vec_id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"WITH p AS ({_P}) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2), 9) AS distance FROM p a, p b WHERE a.vec_id < b.vec_id AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= 0.03")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    a, b = (p.select(F.col("vec_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in "ab")
    return spatial.within(a, b, 0.03, ("ax", "ay"), ("bx", "by")).filter("a < b").select("a", "b", F.round("distance", 9).alias("distance"))


@query(
    f"""WITH p AS ({_P}) SELECT a.vec_id AS a, arg_min(b.vec_id, (sqrt((a.x-b.x)**2 + (a.y-b.y)**2), b.vec_id)) AS b, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)), 9) AS distance
    FROM p a, p b WHERE a.label < 5 AND b.label >= 5 AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= 0.1 GROUP BY 1"""
)
def nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    a = p.filter("label < 5").select(F.col("vec_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.filter("label >= 5").select(F.col("vec_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return spatial.nearest(a, b, 0.1, ("ax", "ay"), ("bx", "by"), ["a"], "b").select("a", "b", F.round("distance", 9).alias("distance"))


@query(
    f"""WITH RECURSIVE p AS ({_P}), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= 0.012),
    r(k, c) AS (SELECT a, b FROM e UNION SELECT r.k, e.b FROM r JOIN e ON r.c = e.a)
    SELECT k AS vec_id, min(c) AS cluster FROM r GROUP BY 1"""
)
def endpoint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cluster(_points(spark, sf_dir), "vec_id", "x", "y", 0.012)


@query(f"SELECT CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy, count(*) AS n FROM ({_C}) GROUP BY ALL")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).groupBy(spatial.cell("x", 500.0).alias("cx"), spatial.cell("y", 100.0).alias("cy")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(trunc(x / 500) AS BIGINT) AS cx, count(*) AS n FROM ({_C}) GROUP BY 1")
def truncated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).groupBy(spatial.cell("x", 500.0, floor=False).alias("cx")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM ({_P}) GROUP BY ALL")
def clustered_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grid_clusters(_points(spark, sf_dir), "x", "y", 0.05).select("cx", "cy", "n", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'highway' WHEN o_orderkey % 5 = 0 THEN 'building' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tunnel' WHEN 2 THEN 'none' ELSE 'none' END AS structure FROM orders")
def tag_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    entry = lambda name, value: F.map_from_arrays(F.array(F.lit(name)), F.array(value))
    none = F.create_map().cast("map<string,string>")
    tags = F.map_concat(F.when(k % 3 == 0, entry("highway", F.col("o_orderstatus"))).otherwise(none), F.when(k % 5 == 0, entry("building", F.col("o_orderpriority"))).otherwise(none), F.when(k % 4 == 0, entry("bridge", F.lit("yes"))).when(k % 4 == 1, entry("tunnel", F.lit("yes"))).when(k % 4 == 2, entry("bridge", F.lit("no"))).otherwise(none))
    category, value = spatial.primary_tag("tags")
    return table(spark, sf_dir, "orders").withColumn("tags", tags).select("o_orderkey", category.alias("category"), value.alias("value"), spatial.structure_type("tags").alias("structure"))


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 20.0 WHEN 'MACHINERY' THEN 2.0 ELSE 8.0 END WHEN 1 THEN CASE c_mktsegment WHEN 'MACHINERY' THEN 15.0 ELSE 6.0 END ELSE 6.0 END AS width FROM customer")
def default_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("c_nationkey") % 3, F.col("c_mktsegment")
    category = F.when(n == 0, "highway").when(n == 1, "waterway").otherwise("barrier")
    value = F.when((n == 0) & (m == "BUILDING"), "motorway").when((n == 0) & (m == "MACHINERY"), "steps").when((n == 1) & (m == "MACHINERY"), "canal").otherwise("x")
    rows = table(spark, sf_dir, "customer").select("c_custkey", category.alias("category"), value.alias("value"))
    return rows.select("c_custkey", spatial.default_width("category", "value").alias("width"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merge_chunks(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT node, count(*) AS valence, count(*) >= 3 AS is_junction FROM (SELECT o_custkey AS node FROM orders UNION ALL SELECT o_custkey * 7 % 1500 FROM orders) GROUP BY 1")
def node_valences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.node_valence(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s"), (F.col("o_custkey") * 7 % 1500).alias("e")), "s", "e")


@query("SELECT l_partkey AS way, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS relations FROM lineitem GROUP BY 1")
def ways_in_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("ways"))
    return spatial.way_relations(relations, "l_suppkey", "ways").select("way", F.array_join(F.col("relations").cast("array<string>"), ",").alias("relations"))


@query("SELECT p_partkey, regexp_replace(trim(p_type), '[^A-Za-z0-9_-]+', '_', 'g') || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(trim(p_type), '[^A-Za-z0-9_-]+', '_', 'g')) ORDER BY p_partkey) AS n FROM part)")
def unique_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.unique_names(table(spark, sf_dir, "part"), "p_type", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT c_nationkey, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 6) AS angle FROM (SELECT c_nationkey, degrees(atan2(avg(sin(radians(c_custkey % 90))), avg(cos(radians(c_custkey % 90))))) AS m FROM customer GROUP BY 1)")
def circular_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("a", F.col("c_custkey") % 90)
    return rows.groupBy("c_nationkey").agg(F.round(spatial.angular_mean("a"), 6).alias("angle"))


@query(
    f"""WITH p AS (SELECT DISTINCT label, x, y FROM ({_P})), c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1)
    SELECT label, round(avg(sqrt(((x - cx) * 111320 * cos(radians(cy)))**2 + ((y - cy) * 110574)**2)), 3) AS radius FROM p JOIN c USING (label) GROUP BY 1"""
)
def ring_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mean_radius(_points(spark, sf_dir), ["label"], "x", "y").select("label", F.round("radius", 3).alias("radius"))


@query(
    """WITH r AS (SELECT user_id, event_id, value > 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    i AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r WHERE ok GROUP BY user_id, g HAVING count(*) >= 2)
    SELECT user_id, first, last, n FROM i QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1"""
)
def longest_off_ring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.longest_run(table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 30), ["user_id"], "event_id", "ok")


@query("SELECT label, CAST(0 AS INT) AS ring, CAST(count(*) + 1 AS INT) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 2")
def assembled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's points by angle as a ring, cut into segments and put together again."""
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy("a", "vec_id")
    p = _points(spark, sf_dir).withColumn("a", F.atan2("y", "x"))
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    n = p.withColumn("i", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead(F.struct("x", "y")).over(w), first))
    flip = F.col("i") % 2 == 0
    segments = n.select("label", (F.col("i") * 7 % 11 * 1000 + F.col("i")).alias("o"), *[F.when(flip, F.array(f"next.{c}", c)).otherwise(F.array(c, f"next.{c}")).alias(f"{c}s") for c in "xy"])
    return spatial.relation_rings(segments, "label", "o", "xs", "ys").select("label", "ring", F.size("xs").alias("n"))


def _edge(d: str, a: str, enters: bool) -> str:
    """How far along a step of ``d`` from ``a`` it enters or leaves the strip from 0 to 0.2; a step along the strip does so everywhere or never."""
    near, far = ("0", "0.2") if enters else ("0.2", "0")
    return f"CASE WHEN abs({d}) < 1e-12 THEN CASE WHEN {a} >= 0 AND {a} <= 0.2 THEN {0 if enters else 1} ELSE {2 if enters else -1} END WHEN {d} > 0 THEN ({near} - {a}) / {d} ELSE ({far} - {a}) / {d} END"


@query(
    f"""WITH p AS (SELECT vec_id, i, CAST(embedding[2 * i - 1] AS DOUBLE) + 0.1 AS x, CAST(embedding[2 * i] AS DOUBLE) + 0.1 AS y FROM embeddings, range(1, 9) r(i)),
    s AS (SELECT a.vec_id, a.i, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = a.i + 1),
    t AS (SELECT *, greatest(0, {_edge('dx', 'ax', True)}, {_edge('dy', 'ay', True)}) AS t0, least(1, {_edge('dx', 'ax', False)}, {_edge('dy', 'ay', False)}) AS t1 FROM s),
    o AS (SELECT vec_id, 2 * i + k AS o, ax + CASE k WHEN 0 THEN t0 ELSE t1 END * dx AS x, ay + CASE k WHEN 0 THEN t0 ELSE t1 END * dy AS y FROM t, range(0, 2) r(k) WHERE t0 <= t1),
    m AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM o WINDOW w AS (PARTITION BY vec_id ORDER BY o))
    SELECT vec_id, CAST(count(*) AS INT) AS n FROM m WHERE lx IS NULL OR sqrt((x - lx)**2 + (y - ly)**2) > 1e-9 GROUP BY 1 HAVING count(*) > 1"""
)
def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("vec_id", F.transform("line", lambda p: p.x + 0.1).alias("xs"), F.transform("line", lambda p: p.y + 0.1).alias("ys"))
    return spatial.clip_lines(lines, "vec_id", "xs", "ys", 0.2).select("vec_id", F.size("xs").alias("n"))


@query(
    f"""WITH p AS ({_P}), d AS (SELECT vec_id, x + 1 AS u, y - 1 AS v, 0.01 * -0.012 - 0.002 * -0.003 AS det FROM p)
    SELECT vec_id, round((u * -0.012 - v * 0.002) / det * 512 / 300, 6) AS px, round(511 - (v * 0.01 - u * -0.003) / det * 512 / 400, 6) AS py FROM d"""
)
def affine_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = spatial.affine_pixels("x", "y", (-1.0, 0.01, 0.002, 1.0, -0.003, -0.012), 300, 400, 512)
    return _points(spark, sf_dir).select("vec_id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def features_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return spatial.of_ids(table(spark, sf_dir, "orders"), "o_custkey", ids, "c_custkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_acctbal AS width FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def spline_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("width"))
    return spatial.with_parameters(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", parameters)


def _series(c: list[float], form: str) -> str:
    return " + ".join(f"{v!r} * {form.format(k=2 * j)}" for j, v in enumerate(c, 1))


def _utm_sql() -> str:
    zone = projection.zone_of(25832)
    e, a = zone.ellipsoid.e, zone.scale * zone.ellipsoid.radius
    fore = [v for v in projection._forward(zone.ellipsoid.n)]
    return f"""WITH g AS (SELECT c_custkey, 6 + c_custkey % 600 / 100.0 AS lon, 47 + c_acctbal / 1000 AS lat FROM customer),
    t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - 9) AS d FROM g),
    q AS (SELECT *, atan2(t, cos(d)) AS p, atanh(sin(d) / sqrt(1 + t * t)) AS q FROM t)
    SELECT c_custkey, round(500000 + {a!r} * (q + {_series(fore, 'cos({k} * p) * sinh({k} * q)')}), 5) AS x, round({a!r} * (p + {_series(fore, 'sin({k} * p) * cosh({k} * q)')}), 5) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM q"""


@query(_utm_sql())
def zone_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places in zone 32, there and back."""
    zone = projection.zone_of(25832)
    c = table(spark, sf_dir, "customer").select("c_custkey", (6 + F.col("c_custkey") % 600 / 100.0).alias("lon"), (47 + F.col("c_acctbal").cast("double") / 1000).alias("lat"))
    x, y = projection.to_plane("lon", "lat", zone)
    there = c.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = projection.to_degrees("x", "y", zone)
    return there.select("c_custkey", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))
