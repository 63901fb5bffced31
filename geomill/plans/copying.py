"""Copy and merge queries: parts as materials, suppliers and customers as the two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import copying
from geomill.plans.registry import query
from geomill.session import table


@query("SELECT CASE WHEN p_size > 40 THEN 'terrain' WHEN p_type LIKE '%STEEL%' THEN 'decal' ELSE 'other' END AS route, count(*) AS n FROM part GROUP BY 1")
def routed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copying.route(table(spark, sf_dir, "part"), {"terrain": F.col("p_size") > 40, "decal": F.col("p_type").like("%STEEL%")})
    return rows.groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%L' THEN p_type ELSE p_type || 'L' END AS name FROM part")
def renamed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", copying.renamed("p_type", "L").alias("name"))


@query(
    """WITH f AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)
    SELECT s_suppkey, s_nationkey, CASE WHEN a.c_custkey IS NOT NULL AND (b.c_custkey IS NULL OR a.c_custkey <= b.c_custkey) THEN a.c_acctbal WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE s_acctbal END AS balance
    FROM supplier LEFT JOIN f a ON s_nationkey = a.c_nationkey AND a.c_nationkey % 3 > 0 LEFT JOIN f b ON CAST(s_suppkey % 25 AS INT) = b.c_nationkey AND b.c_nationkey % 3 > 0"""
)
def replaced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 25).cast("int").alias("other"), F.col("s_acctbal").alias("balance"))
    sources = table(spark, sf_dir, "customer").filter("c_nationkey % 3 > 0").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("balance"))
    got = copying.replace_records(targets, sources, ["s_nationkey", "other"], "c_nationkey", "c_custkey", ["s_suppkey", "s_nationkey", "other"])
    return got.select("s_suppkey", "s_nationkey", "balance")


_COVERS = "c AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 50)) AS layers FROM lineitem GROUP BY 1)"


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_partkey") % 50).cast("string"))).alias("layers"))


@query(f"WITH {_COVERS} SELECT l_orderkey, len(layers) AS n FROM c WHERE list_has_any(layers, [3, 17])")
def covers_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("3",), ("17",)], "name string")
    return copying.covers_of(_covers(spark, sf_dir), "layers", wanted, "name").select("l_orderkey", F.size("layers").cast("long").alias("n"))


@query(f"WITH {_COVERS} SELECT l_orderkey, len(list_filter(layers, lambda x: x NOT IN (3, 17))) AS n FROM c WHERE len(list_filter(layers, lambda x: x NOT IN (3, 17))) > 0")
def covers_without_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copying.without_layers(_covers(spark, sf_dir), "layers", ["3", "17"]).select("l_orderkey", F.size("layers").cast("long").alias("n"))


@query(f"WITH {_COVERS} SELECT l_orderkey, array_to_string(list_sort(list_transform(layers, lambda x: CASE x WHEN 3 THEN 'rock' ELSE CAST(x AS VARCHAR) END)), ',') AS layers FROM c")
def remapped_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covers(spark, sf_dir).select("l_orderkey", F.array_join(F.array_sort(copying.remap("layers", {"3": "rock"})), ",").alias("layers"))


@query("SELECT DISTINCT name, p_brand AS target FROM (SELECT p_type AS name, p_brand FROM part UNION ALL SELECT p_brand, p_brand FROM part)")
def internal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copying.name_map(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_brand")


@query(
    """WITH ch AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT c_custkey AS k, coalesce(v, c_acctbal) AS v FROM customer LEFT JOIN ch ON k = c_custkey UNION ALL SELECT k, v FROM ch WHERE k NOT IN (SELECT c_custkey FROM customer)"""
)
def upserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    changes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return copying.upsert(target, changes, ["k"], "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size < 25 AND p_brand || p_type NOT IN (SELECT p_brand || p_type FROM part WHERE p_size > 45) AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45)")
def new_brushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("kind", F.concat("p_brand", "p_type"))
    return copying.missing_in(part.filter("p_size > 45"), part.filter("p_size < 25"), ["kind", "p_name"]).select("p_partkey")


@query("WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT l_suppkey, count(p_size) AS n_items, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total FROM r LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1")
def brush_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brushes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_partkey").alias("items"))
    return copying.brush_sizes(brushes, "l_suppkey", "items", table(spark, sf_dir, "part").filter("p_size > 10"), "p_partkey", "p_size")


@query(
    """SELECT p_type, arg_min(p_partkey, (CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 1 END, p_partkey)) AS p_partkey, bool_or(p_brand = 'Brand#11') AND bool_or(p_brand <> 'Brand#11') AS in_both FROM part GROUP BY 1"""
)
def material_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_brand")
    return copying.material_lookup(rows, "p_type", "p_brand", "p_partkey", "BRAND#11").select("p_type", "p_partkey", "in_both")


@query(
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE replace(url, '/', '\\') || '\\LEVELS\\Art\\P' || page_id || '.Dae.link' END AS f FROM pages), c AS (SELECT page_id, lower(replace(regexp_replace(f, '(?i)\\.link$', ''), '\\', '/')) AS f FROM p)
    SELECT page_id, CASE WHEN NOT contains(f, '/levels/') THEN '' ELSE regexp_replace('levels/' || list_last(string_split(f, '/levels/')), '\\.[^./]*$', '') END AS path FROM c"""
)
def level_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    far = F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("\\LEVELS\\Art\\P"), k.cast("string"), F.lit(".Dae.link"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, F.col("url")).otherwise(far).alias("f"))
    return rows.select("page_id", copying.level_path("f").alias("path"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_custkey % 2 = 0 THEN c_mktsegment ELSE 'plain' END AS roof, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE '3' END AS levels
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL"""
)
def inherited_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = lambda *kv: F.create_map(*[F.lit(v) if i % 2 == 0 else v for i, v in enumerate(kv)])
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", tags("roof", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))).alias("own"))
    even = lambda c: F.when(F.col("c_custkey") % 2 == 0, F.col(c)).otherwise(F.lit(" "))
    parent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), tags("roof", even("c_mktsegment"), "levels", even("c_name")).alias("parent"))
    return own.join(parent, "o_custkey").select("o_orderkey", *copying.inherited("own", "parent", {"roof": "plain", "levels": "3"}))


@query("SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL UNION SELECT p_brand FROM part WHERE p_brand IS NOT NULL")
def used_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copying.used_values(table(spark, sf_dir, "part"), ["p_type", "p_brand"])
