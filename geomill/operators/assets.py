"""Asset tables: which records are used, orphaned, doubled or missing, and rewrites of paths and positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.session import cut


def folded(column: str | Column) -> Column:
    """Key for comparisons that ignore case."""
    return F.upper(F.col(column) if isinstance(column, str) else column)


def any_key_matches(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Distinct rows of ``rows`` of which any of ``keys`` is in ``wanted``, case aside: one equi join a key, never an OR join."""
    names = wanted.select(folded(wanted_key).alias("_k")).distinct()
    parts = [rows.join(names, folded(k) == F.col("_k"), "left_semi") for k in keys]
    return reduce(DataFrame.union, parts).distinct()


def used_files(assets: DataFrame, materials: DataFrame, names: list[str]) -> DataFrame:
    """(key) of used files: shapes of ``assets`` (shape, material), their ``.cdae`` twins, and ``materials``' files of the materials that assets name."""
    shapes = assets.filter("shape IS NOT NULL").select(folded("shape").alias("key"))
    twins = shapes.filter(F.col("key").endswith(".DAE")).select(F.regexp_replace("key", r"\.DAE$", ".CDAE").alias("key"))
    found = any_key_matches(materials, names, assets.filter("material IS NOT NULL"), "material")
    return shapes.union(twins).union(found.select(folded("file").alias("key"))).distinct()


def orphans(files: DataFrame, key: str, used: DataFrame, used_key: str = "key") -> DataFrame:
    """The rows of ``files`` whose key, case aside, is not in ``used``; null keys are orphans."""
    return files.join(used.select(F.col(used_key).alias("_used")), folded(key) == F.col("_used"), "left_anti")


def unused_fixpoint(uses: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys that no root reaches: ``uses`` (user, used) rows, ``roots`` (key).

    Users that are neither a root nor used by any are never reached, so their
    rows are put aside once; the others take one join and one checkpoint a
    round, until a round reaches nothing new.
    """
    start = cut(roots.select("key").distinct())
    able = uses.select(F.col("used").alias("key")).union(start).distinct()
    inner = cut(uses.join(able, uses.user == able.key, "left_semi").select("user", "used").distinct())
    reached = front = start
    while True:
        front = cut(inner.join(front, inner.user == front.key, "left_semi").select(F.col("used").alias("key")).distinct().join(reached, "key", "left_anti"))
        if front.isEmpty():
            break
        reached = cut(reached.union(front))
    keys = uses.select(F.col("user").alias("key")).union(uses.select("used")).distinct()
    return keys.join(reached, "key", "left_anti")


def first_existing(wanted: DataFrame, path: str, existing: DataFrame, existing_path: str, endings: list[str]) -> DataFrame:
    """``wanted`` with ``found``: the first of the path itself and the path under other ``endings`` that exists, case aside, or null."""
    stem = F.regexp_replace("_p", r"\.[^./\\]*$", "")
    tries = F.array(F.col("_p"), *[F.concat(stem, F.lit(e)) for e in endings])
    there = existing.select(folded(existing_path).alias("_e")).distinct()
    ranked = wanted.select(F.col(path).alias("_p")).distinct().select("_p", F.posexplode(tries).alias("_r", "_t"))
    best = ranked.join(there, folded("_t") == F.col("_e")).groupBy("_p").agg(F.min_by("_t", "_r").alias("found"))
    return wanted.join(best, F.col(path) == F.col("_p"), "left").drop("_p")


def keep_best(rows: DataFrame, key: list[str], quality: str, order: str) -> DataFrame:
    """The row of highest quality of each key, ties to the first in ``order``; keys whose best quality is 0 keep all rows."""
    w = W.partitionBy(*key)
    ranked = rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc(quality), order))).withColumn("_best", F.max(quality).over(w))
    return ranked.filter("_n = 1 OR _best = 0").drop("_n", "_best")


def flag_known(rows: DataFrame, key: str, known: DataFrame, known_key: str, place: str) -> DataFrame:
    """``rows`` with ``is_duplicate`` and ``places``, the sorted places of equal keys (case counts) in ``known``."""
    found = known.groupBy(F.col(known_key).alias("_k")).agg(F.array_sort(F.collect_set(place)).alias("places"))
    return rows.join(found, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("is_duplicate", F.col("places").isNotNull())


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of keys with more than one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def long_form(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row for each non-empty value of ``columns``: ids, map_type, path."""
    return rows.unpivot(ids, columns, "map_type", "path").filter("path IS NOT NULL AND path <> ''")


def distinct_names(rows: DataFrame, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """Distinct upper-case ``name`` of scalar ``columns`` and array ``lists``."""
    every = F.concat(F.array(*columns), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    return rows.select(F.explode(F.transform(F.array_compact(every), F.upper)).alias("name")).distinct()


def same_values(values: str) -> Column:
    """True where an array's values are all equal; null counts as equal."""
    return F.coalesce(F.size(F.array_distinct(values)) <= 1, F.lit(True))


def usage(items: DataFrame, key: str, users: DataFrame, user_key: str, user: str) -> DataFrame:
    """Distinct ``items`` with the sorted set of ``user`` values that use their key, empty where none does."""
    by = users.groupBy(F.col(user_key).alias("_k")).agg(F.array_sort(F.collect_set(user)).alias("users"))
    return items.distinct().join(by, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("users", F.coalesce("users", F.array().cast("array<string>")))


def resolve_path(base: str | Column, path: str | Column, distinct_segments: bool = False) -> Column:
    """``path`` under ``base``: doubled slashes become one, drive paths pass as they are; optionally repeated segments of the joined path go."""
    base, path = (F.col(x) if isinstance(x, str) else x for x in (base, path))
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "//+", "/")
    joined = F.concat(F.rtrim(F.replace(base, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"), F.ltrim(clean, F.lit("/")))
    if distinct_segments:
        joined = F.array_join(F.array_distinct(F.split(joined, "/")), "/")
    return F.when(clean.rlike("^[A-Za-z]:/"), clean).otherwise(joined)


def sanitise(path: str | Column) -> Column:
    """Doubled ``levels`` folders of a path become one."""
    path = F.col(path) if isinstance(path, str) else path
    return F.replace(F.replace(path, F.lit("levels\\levels"), F.lit("levels")), F.lit("levels\\game:levels"), F.lit("levels"))


def offset_vector(vector: str | Column, offsets: list[float], first: int = 0) -> Column:
    """An array with ``offsets`` added from index ``first`` on; shorter arrays stay."""
    v = F.col(vector) if isinstance(vector, str) else vector
    add = F.array(*map(F.lit, offsets))
    moved = F.transform(v, lambda x, i: F.when((i >= first) & (i < first + len(offsets)), x + F.coalesce(F.get(add, i - first), F.lit(0.0))).otherwise(x))
    return F.when(F.size(v) >= first + len(offsets), moved).otherwise(v)


def replace_text(column: str, search: str, new: str) -> Column:
    """Every occurrence of ``search``, case aside, replaced by ``new`` as it stands."""
    from re import sub

    quoted = sub(r"([^\w\s])", r"\\\1", search)
    return F.regexp_replace(F.col(column), f"(?i){quoted}", new.replace("\\", "\\\\").replace("$", "\\$"))


#: Results of single rounds that one plan unites; more are cut first.
UNITED = 32


def ancestry(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, depth, path): the chain of keys from each node's root to the node; a node whose parent is missing is a root.

    One join a level over the nodes that found their parent in the level
    before, down to the deepest; nodes in a cycle get no row, and a chain
    ends where it would come back to one of its own keys.
    """
    links = cut(nodes.select(F.col(key).alias("key"), F.col(parent).alias("parent")))
    there = links.select(F.col("key").alias("parent"))
    level = links.join(there, "parent", "left_anti").select("key", F.array("key").alias("path"))
    found, depth = [], 0
    while not (level := cut(level)).isEmpty():
        if len(found) == UNITED:
            found = [cut(reduce(DataFrame.union, found))]
        found.append(level.select("key", F.lit(depth).alias("depth"), "path"))
        level = links.join(level.select(F.col("key").alias("parent"), "path"), "parent").filter(~F.array_contains("path", F.col("key"))).select("key", F.concat("path", F.array("key")).alias("path"))
        depth += 1
    return reduce(DataFrame.union, found) if found else links.select("key", F.lit(0).alias("depth"), F.array("key").alias("path")).limit(0)


def subtree(tree: DataFrame, root) -> DataFrame:
    """The rows of an ``ancestry`` result at or under the node ``root``."""
    return tree.filter(F.array_contains("path", root))


def post_order(tree: DataFrame) -> DataFrame:
    """An ``ancestry`` result with ``place``, a sort key in which children come before their parent; keys are texts without U+FFFF."""
    return tree.withColumn("place", F.concat(F.array_join(F.col("path").cast("array<string>"), "\x01"), F.lit("\uffff")))


#: Image endings tried for textures found by name.
IMAGE_ENDINGS = (".dds", ".png", ".jpg", ".jpeg", ".tga")


def textures_by_name(materials: DataFrame, name: str, files: DataFrame, path: str, suffixes: dict[str, str]) -> DataFrame:
    """(name, map_type, path): files whose stem, with or without ``t_`` before it, is a material's name and one of ``suffixes`` (suffix -> map type); case and a second ending .color, .data or .normal aside."""
    kinds = F.explode(F.map_from_arrays(F.array(*map(F.lit, suffixes)), F.array(*map(F.lit, suffixes.values())))).alias("suffix", "map_type")
    wanted = materials.select(F.col(name).alias("name")).distinct().select("name", kinds)
    wanted = wanted.select("name", "map_type", F.explode(F.array(F.concat("name", "suffix"), F.concat(F.lit("t_"), "name", "suffix"))).alias("stem"))
    base = F.lower(F.element_at(F.split(F.col(path), r"[/\\]"), -1))
    ending = F.regexp_extract(base, r"(\.[a-z]+)$", 1)
    stems = files.filter(ending.isin(*IMAGE_ENDINGS)).select(F.col(path).alias("path"), F.regexp_replace(base, r"(\.(color|data|normal))?\.[a-z]+$", "").alias("_stem"))
    return wanted.join(stems, F.lower("stem") == F.col("_stem")).select("name", "map_type", "path").distinct()


def newest_version(rows: DataFrame, version: str) -> DataFrame:
    """The row of the highest dotted version, compared number by number."""
    return rows.orderBy(F.transform(F.split(version, r"\."), lambda x: x.try_cast("int")).desc_nulls_last()).limit(1)
