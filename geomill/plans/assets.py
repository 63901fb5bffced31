"""Asset-audit queries: part as files and materials, lineitem as the references to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.operators import assets
from geomill.plans.registry import query
from geomill.session import table

_RECENT = "WITH lim AS (SELECT min(l_shipdate) + INTERVAL 30 DAY AS d FROM lineitem), used AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem, lim WHERE l_shipdate < d)"


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the first 30 days."""
    lines = table(spark, sf_dir, "lineitem")
    last = lines.agg((F.min("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("d"))
    return lines.join(F.broadcast(last), F.col("l_shipdate") < F.col("d")).select("l_partkey", "l_suppkey").distinct()  # last: one row


@query(f"{_RECENT} SELECT p_brand, count(*) AS n_orphans, CAST(sum(p_size) AS BIGINT) AS size_sum FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used) GROUP BY p_brand")
def orphans_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _recent(spark, sf_dir).select(F.col("l_partkey").cast("string").alias("key"))
    left = assets.orphans(table(spark, sf_dir, "part").withColumn("key", F.col("p_partkey").cast("string")), "key", used)
    return left.groupBy("p_brand").agg(F.count("*").alias("n_orphans"), F.sum("p_size").alias("size_sum"))


@query(
    f"""{_RECENT}, named AS (SELECT p.p_name AS shape, p.p_brand AS material FROM used JOIN part p ON p.p_partkey = used.l_partkey)
    SELECT DISTINCT key FROM (SELECT upper(shape) || '.DAE' AS key FROM named UNION ALL SELECT upper(shape) || '.CDAE' FROM named
    UNION ALL SELECT upper(p_name) FROM part WHERE upper(p_brand) IN (SELECT upper(material) FROM named) OR upper(p_type) IN (SELECT upper(material) FROM named))"""
)
def used_file_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    named = _recent(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat("p_name", F.lit(".dae")).alias("shape"), F.col("p_brand").alias("material"))
    return assets.used_files(named, part.withColumn("file", F.col("p_name")), ["p_brand", "p_type"])


@query(
    """WITH RECURSIVE uses AS (SELECT DISTINCT o_orderkey AS u, o_custkey * 11 % 15013 AS v FROM orders),
    reached(key) AS (SELECT DISTINCT u FROM uses WHERE u < 400 UNION SELECT v FROM uses JOIN reached ON u = key)
    SELECT key FROM (SELECT u AS key FROM uses UNION SELECT v FROM uses) WHERE key NOT IN (SELECT key FROM reached)"""
)
def unused_after_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("user"), (F.col("o_custkey") * 11 % 15013).alias("used")).distinct()
    return assets.unused_fixpoint(uses, uses.filter("user < 400").select(F.col("user").alias("key")))


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 50 = p_size AND n_nationkey = p_partkey % 25)")
def convention_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    keys = places.select((F.col("s_suppkey") % 50).cast("int").alias("p_size"), F.col("n_nationkey").alias("_n"))
    part = table(spark, sf_dir, "part")
    return part.join(keys, (part.p_size == keys.p_size) & (part.p_partkey % 25 == keys._n), "left_semi").select("p_partkey", "p_name")


@query(
    """WITH want AS (SELECT o_orderkey, 'f' || (o_orderkey % 40) || '.dds' AS path FROM orders), have AS (SELECT DISTINCT 'F' || (c_custkey % 30) || CASE c_custkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.JPG' ELSE '.DDS' END AS p FROM customer),
    tries AS (SELECT DISTINCT path, r, t FROM (SELECT path, 0 AS r, path AS t FROM want UNION ALL SELECT path, 1, replace(path, '.dds', '.png') FROM want UNION ALL SELECT path, 2, replace(path, '.dds', '.jpg') FROM want)),
    best AS (SELECT path, arg_min(t, r) AS found FROM tries JOIN have ON upper(t) = p GROUP BY path)
    SELECT o_orderkey, want.path, found FROM want LEFT JOIN best ON want.path = best.path"""
)
def first_existing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_orderkey") % 40, F.lit(".dds")).alias("path"))
    k = F.col("c_custkey")
    have = table(spark, sf_dir, "customer").select(F.concat(F.lit("F"), k % 30, F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".JPG").otherwise(".DDS")).alias("p"))
    return assets.first_existing(want, "path", have, "p", [".png", ".jpg"])


@query("SELECT p_brand, p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) = 1 OR max(p_retailprice) OVER (PARTITION BY p_brand, p_type) = 0")
def best_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.keep_best(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice", "p_partkey").select("p_brand", "p_type", "p_partkey", "p_retailprice")


@query(
    """WITH k AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS places FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    SELECT s_suppkey, array_to_string(places, ',') AS places, places IS NOT NULL AS is_duplicate FROM supplier LEFT JOIN k ON s_nationkey = c_nationkey"""
)
def flagged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return assets.flag_known(table(spark, sf_dir, "supplier"), "s_nationkey", rich, "c_nationkey", "c_mktsegment").select("s_suppkey", F.array_join("places", ",").alias("places"), "is_duplicate")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.duplicates(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS map_type, unnest([p_name, p_brand, p_type]) AS path FROM part")
def material_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.long_form(table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_brand", "p_type"])


@query("SELECT DISTINCT name FROM (SELECT upper(p_brand) AS name FROM part UNION ALL SELECT upper(p_type) FROM part UNION ALL SELECT upper(unnest(string_split(p_name, ' '))) FROM part)")
def all_material_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.distinct_names(table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " ")), ["p_brand", "p_type"], ["words"])


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) <= 1")
def uniform_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scales = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("scale"), F.count("*").alias("n"))
    return scales.filter(assets.same_values("scale")).select("l_orderkey", "n")


@query(
    """WITH u AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS u FROM part WHERE p_size > 40 GROUP BY 1)
    SELECT s.b AS brand, coalesce(array_to_string(u, '|'), '') AS users FROM (SELECT DISTINCT p_brand AS b FROM part) s LEFT JOIN u ON s.b = u.p_brand"""
)
def forest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return assets.usage(part.select(F.col("p_brand").alias("brand")), "brand", part.filter("p_size > 40"), "p_brand", "p_type").select("brand", F.array_join("users", "|").alias("users"))


@query("SELECT DISTINCT p_brand || p_type AS kind FROM part WHERE p_size < 20 AND p_brand || p_type NOT IN (SELECT p_brand || p_type FROM part WHERE p_size > 45)")
def new_forest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("kind", F.concat("p_brand", "p_type"))
    return part.filter("p_size < 20").join(part.filter("p_size > 45"), "kind", "left_anti").select("kind").distinct()


@query("SELECT page_id, 'levels/' || CASE WHEN page_id % 2 = 0 THEN 'map' ELSE 'art' END || '/' || ltrim(regexp_replace(regexp_replace(url, '^[a-z]+:', ''), '//+', '/', 'g'), '/') AS path FROM pages")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("levels/"), F.when(F.col("page_id") % 2 == 0, "map").otherwise("art"))
    return table(spark, sf_dir, "pages").select("page_id", assets.resolve_path(base, F.regexp_replace("url", "^[a-z]+:", "")).alias("path"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + 10, 6) AS x, round(CAST(embedding[2] AS DOUBLE) - 5, 6) AS y, round(CAST(embedding[3] AS DOUBLE), 6) AS z FROM embeddings")
def offset_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "embeddings").withColumn("v", assets.offset_vector(F.slice("embedding", 1, 3).cast("array<double>"), [10.0, -5.0]))
    return moved.select("vec_id", *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate("xyz")])


@query("SELECT p_partkey, regexp_replace(p_type, 'steel', 'iron', 'gi') AS p_type FROM part")
def replaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", assets.replace_text("p_type", "STEEL", "iron").alias("p_type"))


_TREE = """WITH RECURSIVE links AS (SELECT DISTINCT conv_id * 1000 + turn AS key, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
    t(key, depth, path) AS (SELECT key, 0, CAST(key AS VARCHAR) FROM links WHERE parent IS NULL OR parent NOT IN (SELECT key FROM links)
    UNION ALL SELECT l.key, depth + 1, path || '/' || l.key FROM links l JOIN t ON l.parent = t.key)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    links = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + turn).alias("key"), F.when(turn > 0, F.col("conv_id") * 1000 + turn - 1).alias("parent")).distinct()
    return assets.ancestry(links, "key", "parent")


@query(f"{_TREE} SELECT key, depth, path FROM t")
def ancestry_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("key", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"{_TREE} SELECT key, depth FROM t WHERE path = '1001' OR path LIKE '1001/%' OR path LIKE '%/1001/%' OR path LIKE '%/1001'")
def subtree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.subtree(_tree(spark, sf_dir), 1001).select("key", "depth")


@query("SELECT n_name AS key, 2 * r_regionkey + 0 AS region2, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def adjacency_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("key"), (2 * F.col("r_regionkey")).alias("region2"), F.col("r_name").alias("parent"))


@query(
    """WITH RECURSIVE t(key, path) AS (SELECT r_name, r_name FROM region UNION ALL SELECT n_name, r_name || chr(1) || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name)
    SELECT key, row_number() OVER (ORDER BY path || chr(65535)) AS place FROM t"""
)
def post_order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    children = nation.join(region, nation.n_regionkey == region.r_regionkey).filter("n_name <> r_name").select(F.col("n_name").alias("key"), F.col("r_name").alias("parent"))
    tree = assets.post_order(assets.ancestry(children.union(region.select("r_name", F.lit(None).cast("string"))), "key", "parent"))
    from pyspark.sql import Window as W

    return tree.select("key", F.row_number().over(W.orderBy("place")).cast("long").alias("place"))  # regions and nations: 30 rows at any size


@query("SELECT DISTINCT p_brand AS name, map_type, path FROM (SELECT p_brand, 'Brand' || chr(35) FROM part) s(p_brand, b), (SELECT 'colorMap' AS map_type, '_d' AS suf UNION ALL SELECT 'normalMap', '_n') k, (SELECT DISTINCT 'art/' || lower(p_brand) || CASE p_size % 3 WHEN 0 THEN '_d.color' WHEN 1 THEN '_n' ELSE '_x' END || '.png' AS path FROM part) f WHERE path IN ('art/' || lower(p_brand) || suf || '.png', 'art/' || lower(p_brand) || suf || '.color.png')")
def textures_by_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ending = F.when(F.col("p_size") % 3 == 0, "_d.color").when(F.col("p_size") % 3 == 1, "_n").otherwise("_x")
    files = part.select(F.concat(F.lit("art/"), F.lower("p_brand"), ending, F.lit(".png")).alias("path")).distinct()
    return assets.textures_by_name(part, "p_brand", files, "path", {"_d": "colorMap", "_n": "normalMap"})


@query("SELECT DISTINCT f AS file FROM (SELECT p_name || '.dae' AS f FROM part UNION ALL SELECT p_name || '.terrain.json' FROM part WHERE p_size > 25)")
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array_compact(F.array(F.concat("p_name", F.lit(".dae")), F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(".terrain.json")))))
    return table(spark, sf_dir, "part").select(F.explode(files).alias("file")).distinct()


@query("SELECT p_size || '.' || (p_partkey % 7) || '.' || p_partkey AS version FROM part ORDER BY p_size DESC, p_partkey % 7 DESC, p_partkey DESC LIMIT 1")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_size", F.col("p_partkey") % 7, "p_partkey").alias("version"))
    return assets.newest_version(rows, "version")
