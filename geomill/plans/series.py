"""Series queries: a customer's orders by date as the rows of a road, the price as elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import series
from geomill.plans.registry import query
from geomill.session import table

KEY, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_XY = "SELECT *, CAST(o_orderkey % 1000 AS DOUBLE) AS x, CAST(o_totalprice % 977 AS DOUBLE) AS y FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).withColumn("x", (F.col("o_orderkey") % 1000).cast("double")).withColumn("y", F.col("o_totalprice") % 977)


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM orders")
def box_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.round(series.box_filter("o_totalprice", series.along(KEY, ORDER), 7), 4).alias("smooth"))


@query(
    f"""WITH i AS (SELECT *, row_number() OVER ({_W}) AS i FROM orders)
    SELECT a.o_orderkey, round(min(b.o_totalprice + 5000.0 * abs(a.i - b.i)), 4) AS limited FROM i a JOIN i b ON a.o_custkey = b.o_custkey GROUP BY ALL"""
)
def slope_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.limit_slope(_orders(spark, sf_dir), "o_totalprice", KEY, ORDER, 5000.0).select("o_orderkey", F.round("limited", 4).alias("limited"))


@query("SELECT o_orderkey, round(o_totalprice * 0.75 + avg(o_totalprice) OVER () * 0.25, 2) AS levelled FROM orders")
def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.level(_orders(spark, sf_dir), "o_totalprice", 0.25).select("o_orderkey", F.round("levelled", 2).alias("levelled"))


@query(f"SELECT o_orderkey, coalesce(last_value(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 100) AS filled FROM orders")
def filled_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _orders(spark, sf_dir).withColumn("v", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).otherwise(float("nan")))
    return gaps.select("o_orderkey", series.fill_forward("v", series.along(KEY, ORDER)).alias("filled"))


@query(
    f"""WITH p AS ({_XY}), d AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM p WINDOW w AS ({_W})),
    c AS (SELECT *, CASE WHEN sqrt(ax*ax+ay*ay) < 1e-6 OR sqrt(bx*bx+by_*by_) < 1e-6 THEN 0 ELSE CASE WHEN ax*by_-ay*bx < 0 THEN -1.0 ELSE 1.0 END
      * acos(greatest(-1.0, least(1.0, (ax*bx+ay*by_) / (sqrt(ax*ax+ay*ay)*sqrt(bx*bx+by_*by_))))) / ((sqrt(ax*ax+ay*ay)+sqrt(bx*bx+by_*by_))/2) END AS c FROM d)
    SELECT o_orderkey, round(coalesce(c, lead(c) OVER w, lag(c) OVER w, 0.0), 7) AS curvature FROM c WINDOW w AS ({_W})"""
)
def curvatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_curvature(_points(spark, sf_dir), "x", "y", KEY, ORDER).select("o_orderkey", F.round("curvature", 7).alias("curvature"))


@query(
    f"""WITH i AS (SELECT *, row_number() OVER ({_W}) AS i FROM orders)
    SELECT a.o_orderkey, round(sum(b.o_totalprice * exp(-(a.i-b.i)*(a.i-b.i) / 4.5)) / sum(exp(-(a.i-b.i)*(a.i-b.i) / 4.5)), 4) AS smooth
    FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND abs(a.i - b.i) <= 2 GROUP BY ALL"""
)
def gaussian_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.round(series.gaussian("o_totalprice", series.along(KEY, ORDER), 5, 1.5), 4).alias("smooth"))


@query(
    f"""WITH n AS (SELECT o_orderkey, o_custkey, o_orderdate, cos(o_orderkey) AS x, sin(o_orderkey) AS y FROM orders),
    m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM n WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT o_orderkey, round(CASE WHEN sqrt(mx*mx+my*my) > 1e-6 THEN mx / sqrt(mx*mx+my*my) ELSE x END, 6) AS nx, round(CASE WHEN sqrt(mx*mx+my*my) > 1e-6 THEN my / sqrt(mx*mx+my*my) ELSE y END, 6) AS ny FROM m"""
)
def smoothed_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _orders(spark, sf_dir).withColumn("x", F.cos("o_orderkey")).withColumn("y", F.sin("o_orderkey"))
    nx, ny = series.smooth_direction("x", "y", series.along(KEY, ORDER))
    return n.select("o_orderkey", F.round(nx, 6).alias("nx"), F.round(ny, 6).alias("ny"))


_DIST = f"""p AS ({_XY}), s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS step FROM p WINDOW w AS ({_W})),
    d AS (SELECT *, sum(step) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS fs, coalesce(sum(step) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS te FROM s)"""


@query(f"WITH {_DIST} SELECT o_orderkey, round(fs, 4) AS from_start, round(te, 4) AS to_end FROM d")
def distances_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_distance(_points(spark, sf_dir), "x", "y", KEY, ORDER).select("o_orderkey", F.round("from_start", 4).alias("from_start"), F.round("to_end", 4).alias("to_end"))


@query(
    f"""WITH {_DIST}, b AS (SELECT o_orderkey, last_value(o_totalprice) OVER w - first_value(o_totalprice) OVER w AS rise, last_value(fs) OVER w - first_value(fs) OVER w AS run FROM d WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT o_orderkey, round(CASE WHEN abs(run) < 1e-6 THEN 0 ELSE rise / run END, 5) AS slope FROM b"""
)
def local_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.with_distance(_points(spark, sf_dir), "x", "y", KEY, ORDER)
    return d.select("o_orderkey", F.round(series.local_slope("o_totalprice", "from_start", series.along(KEY, ORDER)), 5).alias("slope"))


@query(f"SELECT o_custkey, o_orderkey, lag(1) OVER ({_W}) IS NULL AS is_start, lead(1) OVER ({_W}) IS NULL AS is_end FROM orders QUALIFY lag(1) OVER ({_W}) IS NULL OR lead(1) OVER ({_W}) IS NULL")
def series_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.endpoints(_orders(spark, sf_dir), KEY, ORDER).select("o_custkey", "o_orderkey", "is_start", "is_end")


@query(f"WITH {_DIST} SELECT o_custkey, round(max(fs), 3) AS length FROM d GROUP BY 1 HAVING floor(max(fs) / 250) >= 10")
def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = series.with_distance(_points(spark, sf_dir), "x", "y", KEY, ORDER).groupBy("o_custkey").agg(F.max("from_start").alias("length"))
    return series.long_enough(lengths, "length", 250.0).select("o_custkey", F.round("length", 3).alias("length"))


@query(
    f"""WITH n AS (SELECT o_custkey, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS i, lag(1) OVER w IS NULL AS f FROM ({_XY}) WINDOW w AS ({_W}))
    SELECT o_custkey, 3 * i AS i, round(x, 5) AS x, round(y, 5) AS y FROM n WHERE f OR nx IS NULL
    UNION ALL SELECT o_custkey, 3 * i + 1, round(x * 0.75 + nx * 0.25, 5), round(y * 0.75 + ny * 0.25, 5) FROM n WHERE nx IS NOT NULL
    UNION ALL SELECT o_custkey, 3 * i + 2, round(x * 0.25 + nx * 0.75, 5), round(y * 0.25 + ny * 0.75, 5) FROM n WHERE nx IS NOT NULL"""
)
def chaikin_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _points(spark, sf_dir).withColumn("i", F.row_number().over(series.along(KEY, ORDER)))
    return series.chaikin(numbered, "x", "y", KEY, "i").select("o_custkey", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    f"""WITH {_DIST}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(fs) OVER w AS nd FROM d WINDOW w AS ({_W})),
    u AS (SELECT *, unnest(CASE WHEN nd IS NULL THEN [NULL] ELSE range(CAST(ceil(fs / 300) AS BIGINT), CAST(ceil(nd / 300) AS BIGINT)) END) AS k FROM n),
    t AS (SELECT *, coalesce(k * 300.0, fs) AS distance, coalesce((coalesce(k * 300.0, fs) - fs) / (nd - fs), 0) AS t FROM u)
    SELECT o_custkey, coalesce(k, CAST(ceil(fs / 300) AS BIGINT)) AS step, round(distance, 3) AS distance, round(x + t * (coalesce(nx, x) - x), 3) AS x, round(y + t * (coalesce(ny, y) - y), 3) AS y FROM t"""
)
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.resample(_points(spark, sf_dir), "x", "y", KEY, ORDER, 300.0)
    return got.select("o_custkey", "step", *[F.round(c, 3).alias(c) for c in ("distance", "x", "y")])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN CAST(greatest(10, least(100, (o_orderkey % 25) * 5)) AS INT)
    ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 75 WHEN '3-MEDIUM' THEN 20 ELSE 35 END END * 100 + o_orderkey % 5 AS priority FROM orders"""
)
def road_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderpriority")
    named = F.when(kind == "1-URGENT", "motorway").when(kind == "2-HIGH", "Secondary").when(kind == "3-MEDIUM", "cycleway").otherwise("lane")
    rows = _orders(spark, sf_dir).withColumn("c", F.when(F.col("o_orderkey") % 11 != 0, named)).withColumn("p", F.col("o_orderkey") % 5).withColumn("w", (F.col("o_orderkey") % 25).cast("double"))
    return rows.select("o_orderkey", series.effective_priority("c", "p", "w").cast("long").alias("priority"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(1.0, l_quantity / 40)) AS t FROM lineitem)
    SELECT round(sum(t), 2) AS linear, round(sum((1 - cos(t * pi())) / 2), 2) AS cosine, round(sum(t*t*(3-2*t)), 2) AS cubic, round(sum(t*t*t*(t*(t*6-15)+10)), 2) AS quintic FROM t"""
)
def blend_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("l_quantity") / 40
    return table(spark, sf_dir, "lineitem").agg(*[F.round(F.sum(series.blend(t, k)), 2).alias(k) for k in ("linear", "cosine", "cubic", "quintic")])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * sin(l_discount), 4) AS left_edge, round(l_extendedprice + l_quantity * sin(l_discount), 4) AS right_edge FROM lineitem")
def banked_edge_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = series.banked_edges("l_extendedprice", "l_quantity", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(left, 4).alias("left_edge"), F.round(right, 4).alias("right_edge"))


@query(
    f"""WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY o_custkey) // 2 AS half_at FROM orders)
    SELECT o_custkey, o_orderkey, 'a' AS half FROM i WHERE i <= half_at UNION ALL SELECT o_custkey, o_orderkey, 'b' FROM i WHERE i >= half_at"""
)
def split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = _orders(spark, sf_dir).withColumn("i", F.row_number().over(series.along(KEY, ORDER))).withColumn("at", F.floor(F.count("*").over(W.partitionBy(*KEY)) / 2))
    return series.split_at(rows, "i", "at").select("o_custkey", "o_orderkey", "half")


@query()
def butterworth_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.low_pass(_orders(spark, sf_dir), "o_totalprice", KEY, ORDER, 5, 3).select("o_orderkey", F.round("filtered", 4).alias("filtered"))


@query()
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.keep_points(_points(spark, sf_dir), "x", "y", KEY, ORDER, "simplify", 150.0).select("o_custkey", "o_orderkey")


@query(
    f"""WITH RECURSIVE p AS (SELECT o_custkey, o_orderkey, x, y, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM ({_XY})),
    t AS (SELECT o_custkey, o_orderkey, i, n, x AS lx, y AS ly, true AS kept FROM p WHERE i = 1
    UNION ALL SELECT p.o_custkey, p.o_orderkey, p.i, p.n, CASE WHEN sqrt((x - lx)**2 + (y - ly)**2) >= 400 THEN x ELSE lx END, CASE WHEN sqrt((x - lx)**2 + (y - ly)**2) >= 400 THEN y ELSE ly END, sqrt((x - lx)**2 + (y - ly)**2) >= 400 OR p.i = p.n FROM t JOIN p ON p.o_custkey = t.o_custkey AND p.i = t.i + 1)
    SELECT o_custkey, o_orderkey FROM t WHERE kept"""
)
def thinned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.keep_points(_points(spark, sf_dir), "x", "y", KEY, ORDER, "thin", 400.0).select("o_custkey", "o_orderkey")


@query(
    f"""WITH s AS (SELECT o_orderkey, o_custkey, avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s, row_number() OVER ({_W}) AS i FROM orders),
    l AS (SELECT *, s * 0.75 + avg(s) OVER () * 0.25 AS v FROM s)
    SELECT a.o_orderkey, round(min(b.v + 4000.0 * abs(a.i - b.i)), 2) AS target FROM l a JOIN l b ON a.o_custkey = b.o_custkey GROUP BY ALL"""
)
def target_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.target_elevations(_orders(spark, sf_dir), "o_totalprice", KEY, ORDER, 5, 0.25, 4000.0)
    return got.select("o_orderkey", F.round("target", 2).alias("target"))


@query(
    """WITH c AS (SELECT l_suppkey, (l_discount - 0.05) / 100 AS c FROM lineitem), a AS (SELECT l_suppkey, min(c) AS lowest, max(c) AS highest, avg(c) AS mean, max(abs(c)) AS most, avg(abs(c)) AS mean_bend, count(*) FILTER (abs(c) < 0.001) AS straight, count(*) AS n FROM c GROUP BY 1)
    SELECT l_suppkey, round(lowest, 9) AS lowest, round(highest, 9) AS highest, round(mean, 9) AS mean, round(most, 9) AS most, round(mean_bend, 9) AS mean_bend, straight, n, round(CASE WHEN most > 0.0001 THEN 1 / most END, 3) AS tightest FROM a"""
)
def curvature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_discount") - 0.05) / 100)
    got = series.curvature_statistics(rows, ["l_suppkey"], "c")
    return got.select("l_suppkey", *[F.round(c, 9).alias(c) for c in ("lowest", "highest", "mean", "most", "mean_bend")], "straight", "n", F.when(F.col("tightest") < float("inf"), F.round("tightest", 3)).alias("tightest"))
