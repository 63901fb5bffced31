"""Road queries: orders as ways over nodes that their parts name, in blocks of sixteen; embeddings as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import rings, roads, splines
from geomill.plans.registry import query
from geomill.session import cut, table

#: The terrain that the ways lie on: longitudes and latitudes, pixels, metres of a pixel.
BOX, SIZE, PIXEL = (10.0, 50.0, 11.0, 51.0), 4096, 2.0


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a way: its lines' parts name nodes of a block of eight orders, which lie on a ring of 20 metres about the block's place."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(F.col("l_orderkey") / 32) * 16 + F.col("l_partkey") % 16).alias("node"))
    orders = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "node"))).alias("_n"))
    own = table(spark, sf_dir, "orders").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    nodes = F.transform("_n", lambda n: n.node)
    block = lambda n: F.floor(n / 16)
    turn = lambda n: F.lit(2 * 3.141592653589793) * (n % 16) / 16
    lons = F.transform("nodes", lambda n: F.round(10.0005 + (block(n) % 1000) / 1000.0 + F.cos(turn(n)) * 0.00028, 7))
    lats = F.transform("nodes", lambda n: F.round(50.0005 + (F.floor(block(n) / 1000) % 1000) / 1000.0 + F.sin(turn(n)) * 0.00018, 7))
    kind = F.element_at(F.array(*map(F.lit, ("residential", "residential", "tertiary", "tertiary_link", "service"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    tags = own.select(F.col("o_orderkey").alias("way"), F.array("o_orderkey").alias("ord"), nodes.alias("nodes"), kind.alias("highway"), F.when(F.col("o_orderstatus") == "P", "roundabout").alias("junction"), F.when(F.col("o_custkey") % 4 == 0, "yes").alias("oneway"), (F.col("o_custkey") % 7 == 0).alias("bridge"), "o_custkey")
    return tags.withColumn("lons", lons).withColumn("lats", lats)


def _members(ways: DataFrame) -> DataFrame:
    """The ways of a block, eight at most, as a relation in order."""
    block = F.floor(F.col("way") / 32)
    return ways.select(block.alias("relation"), block.alias("relation_order"), F.col("way").alias("member_order"), "way", F.lit("").alias("role"))


def _road_ways(ways: DataFrame) -> DataFrame:
    return ways.select("way", "ord", "lons", "lats", "nodes", "highway", "junction", "oneway", "bridge")


_KNOTS = """p AS (SELECT vec_id, i, 100 * CAST(embedding[2 * i - 1] AS DOUBLE) AS x, 100 * CAST(embedding[2 * i] AS DOUBLE) AS y FROM embeddings, range(1, 33) g(i)),
    s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS step FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    t AS (SELECT *, sum(step) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM s)"""
_SLOPE = """CASE WHEN {v}2 IS NULL OR {v}1 IS NULL OR {v}_1 IS NULL OR {v}_2 IS NULL THEN
      CASE WHEN {v}_1 IS NULL THEN {f0} WHEN {v}_2 IS NULL THEN {f1} WHEN {v}1 IS NULL THEN {l2} ELSE {l1} END
    WHEN abs({d_1} - {d_2}) + abs({d1} - {d0}) < 1e-14 THEN ({d_1} + {d0}) / 2
    ELSE (abs({d1} - {d0}) * {d_1} + abs({d_1} - {d_2}) * {d0}) / (abs({d1} - {d0}) + abs({d_1} - {d_2})) END"""


def _slope(v: str) -> str:
    """Slope of the curve at a knot from the two knots to each side; at the first two and last two that of a parabola."""
    d = {"d_2": f"(({v}_1 - {v}_2) / (t_1 - t_2))", "d_1": f"(({v}0 - {v}_1) / (t0 - t_1))", "d0": f"(({v}1 - {v}0) / (t1 - t0))", "d1": f"(({v}2 - {v}1) / (t2 - t1))"}

    def bend(a: str, b: str, at: str) -> str:
        """Slope at knot ``at`` of the parabola with the slopes ``a`` and ``b`` of two neighbouring steps."""
        first, middle, last = at
        return f"({a} + ({b} - {a}) / ({last} - {first}) * (2 * t0 - {first} - {middle}))"

    return _SLOPE.format(v=v, **d, f0=bend(d["d0"], d["d1"], ("t0", "t1", "t2")), f1=bend(d["d_1"], d["d0"], ("t_1", "t0", "t1")), l2=bend(d["d_2"], d["d_1"], ("t_2", "t_1", "t0")), l1=bend(d["d_1"], d["d0"], ("t_1", "t0", "t1")))


_NEAR = ", ".join(f"{f}({c}, {n}) OVER w AS {c}{'_' if f == 'lag' else ''}{n}" for c in "txy" for f in ("lag", "lead") for n in (1, 2))


@query(
    f"""WITH {_KNOTS}, n AS (SELECT vec_id, i, t AS t0, x AS x0, y AS y0, {_NEAR} FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    m AS (SELECT vec_id, t0 AS a, x0, y0, {_slope('x')} AS mx, {_slope('y')} AS my FROM n),
    g AS (SELECT *, lead(a) OVER w AS b, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, lead(mx) OVER w AS nx, lead(my) OVER w AS ny FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY a)),
    e AS (SELECT vec_id, max(a) AS whole FROM m GROUP BY 1),
    q AS (SELECT vec_id, k AS step, 25.0 * k AS pos FROM e, range(0, 10000) r(k) WHERE 25.0 * k <= whole UNION ALL SELECT vec_id, CAST(floor(whole / 25) AS BIGINT) + 1, whole FROM e WHERE whole - 25 * floor(whole / 25) > 0.01),
    u AS (SELECT q.vec_id, step, pos, pos - a AS s, b - a AS h, g.* EXCLUDE (vec_id), row_number() OVER (PARTITION BY q.vec_id, step ORDER BY a DESC) AS o FROM q JOIN g ON q.vec_id = g.vec_id AND a <= pos AND b IS NOT NULL)
    SELECT vec_id, step, round(pos, 6) AS distance, round(x0 + s * (mx + s * ((3 * (x1 - x0) / h - 2 * mx - nx) / h + s * (mx + nx - 2 * (x1 - x0) / h) / h / h)), 6) AS x, round(y0 + s * (my + s * ((3 * (y1 - y0) / h - 2 * my - ny) / h + s * (my + ny - 2 * (y1 - y0) / h) / h / h)), 6) AS y FROM u WHERE o = 1"""
)
def spline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda first: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get("embedding", 2 * i + first).cast("double") * 100)
    lines = table(spark, sf_dir, "embeddings").select("vec_id", axis(0).alias("xs"), axis(1).alias("ys"))
    found = splines.spline_samples(lines, 25.0, tolerance=0.0, least=0.0, key="vec_id")
    return found.select("vec_id", "step", F.round("distance", 6).alias("distance"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_OWNERS = "m AS (SELECT o_orderkey AS way, o_custkey % 50 + o_orderkey // 32 AS r FROM orders UNION ALL SELECT o_orderkey, o_custkey % 7 + o_orderkey // 32 FROM orders), f AS (SELECT way, min(r) AS r FROM m GROUP BY 1)"


@query(f"WITH {_OWNERS} SELECT o_orderkey AS path, r AS relation_order FROM orders JOIN f ON o_orderkey = way WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) >= 2")
def relation_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several relations assembles a way; each way ends in exactly one chain."""
    ways = _ways(spark, sf_dir)
    lines = roads.terrain_lines(ways.select("way", "ord", "lons", "lats", "nodes", "highway", "junction", "oneway"), BOX, SIZE, PIXEL, -1.0).withColumn("path", F.col("way"))
    listed = ways.select("way", F.explode(F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 7)).alias("r")).select("way", (F.col("r") + F.floor(F.col("way") / 32)).alias("relation"))
    members = listed.select("relation", F.col("relation").alias("relation_order"), F.col("way").alias("member_order"), "way", F.lit("").alias("role")).distinct()
    return roads.relation_chains(lines, members).select("path", "relation_order")


@query()
def road_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways cut to the terrain, assembled, joined and sampled, bridges apart."""
    ways = _ways(spark, sf_dir)
    samples = roads.road_splines(_road_ways(ways), BOX, SIZE, PIXEL, 5.0, members=_members(ways), apart=F.col("bridge"))
    return samples.groupBy("path").agg(F.count("*").alias("n"), F.round(F.max("distance"), 6).alias("length"))


@query()
def connected_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = _ways(spark, sf_dir)
    lines = cut(roads.terrain_lines(_road_ways(ways), BOX, SIZE, PIXEL).withColumn("path", F.col("way")))  # read by every step of the joining
    return roads.connected(lines, 1.0, _members(ways)).select("path", "joined", "position", "reversed")


@query()
def ring_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = cut(_ways(spark, sf_dir))
    return rings.connections(ways, rings.rings(ways)).withColumn("angle", F.round("angle", 6))


_ORDERS = """n AS (SELECT l_orderkey AS way, l_linenumber AS l, l_orderkey // 32 * 16 + l_partkey % 16 AS node FROM lineitem),
    w AS (SELECT way, list(node ORDER BY l, node) AS nodes FROM n GROUP BY 1)"""


@query(
    f"""WITH {_ORDERS}, c AS (SELECT way, unnest(range(1, len(nodes) + 1)) AS i, unnest(nodes) AS node FROM w JOIN orders ON o_orderkey = way WHERE o_orderstatus <> 'P'),
    r AS (SELECT node // 16 AS b, node FROM (SELECT way, unnest(nodes) AS node FROM w JOIN orders ON o_orderkey = way WHERE o_orderstatus = 'P' AND len(nodes) >= 3))
    SELECT DISTINCT way, i - 1 AS i FROM c WHERE node IN (SELECT node FROM r)"""
)
def places_on_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of roads at a node of a roundabout of one way."""
    ways = _ways(spark, sf_dir)
    found = ways.filter(rings.is_ring() & (F.size("nodes") >= 3)).select(F.col("way").alias("ring"), "lons", "lats", F.element_at("lons", 1).alias("lon"), F.element_at("lats", 1).alias("lat"), F.lit(-10.0).alias("radius"))
    return rings.on_rings(ways, found).select("way", "i").distinct()


@query()
def trimmed_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = cut(_ways(spark, sf_dir))
    plan = rings.trims(ways, rings.rings(ways))
    return rings.trimmed(ways, plan).select("way", F.size("nodes").alias("n_nodes"), F.get("nodes", F.lit(0)).alias("first_node"), F.element_at("nodes", -1).alias("last_node"))


@query()
def ring_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = rings.ring_splines(rings.rings(_ways(spark, sf_dir)), BOX, SIZE, PIXEL, 5.0)
    return samples.groupBy("ring").agg(F.count("*").alias("n"), F.round(F.max("distance"), 6).alias("length"))


@query()
def stub_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-noded one-way orders as cycleways: those that end at a roundabout, and the roads that take their place."""
    ways = cut(_ways(spark, sf_dir).withColumn("highway", F.when((F.col("oneway") == "yes") & (F.size("nodes") <= 3), "cycleway").otherwise(F.col("highway"))))
    plan = rings.stub_parents(ways, rings.rings(ways))
    return plan.select("ring", "node", F.size("stubs").alias("n_stubs"), "parent", "at_start", "ring_node")
