"""Files of a level: prefabs, terrain descriptors, level information, hierarchies, decals; and what is written back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.operators.assets import resolve_path


def _local(file: str, name) -> object:
    """A name of a script: without ``./``, and in its file's folder if it names none."""
    path = F.regexp_replace(name, r"^\./", "")
    return F.when(path.contains("/"), path).otherwise(F.concat(F.regexp_replace(file, "[^/]*$", ""), path))


def prefab_assets(texts: DataFrame, prefabs: DataFrame, level: str) -> DataFrame:
    """(prefab, file, kind, value): shapes and decal materials of ``prefabs`` (file) and, one step deep, of the prefabs they hold.

    ``texts`` (file, text) holds scripts and JSON lines; a JSON file ends in
    ``.json``.  Kinds: ``shape`` and ``decal``.  Files that don't exist have no rows.
    """
    lines = texts.select("file", F.explode(F.split("text", "\r\n|\n|\r")).alias("line"))
    is_json = F.lower("file").endswith(".json")
    field = lambda key: F.get_json_object("line", f"$.{key}")
    quoted = lambda key: F.when(F.lower("line").contains(f"{key} ="), F.nullif(F.regexp_extract("line", '"([^"]*)"', 1), F.lit("")))
    found = lines.select(
        "file",
        F.when(is_json, field("shapeName")).otherwise(_local("file", quoted("shapename"))).alias("shape"),
        F.when(~is_json, quoted("material")).alias("decal"),
        F.when(is_json, F.when(field("class") == "Prefab", field("filename"))).otherwise(quoted("filename")).alias("nested"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("shape", "decal", "nested")])
    rows = found.select("file", F.explode(kinds).alias("k")).select("file", "k.*").filter("value IS NOT NULL")
    own = prefabs.select(F.col("file").alias("prefab")).distinct()
    inner = own.join(rows.filter("kind = 'nested'").select(F.col("file").alias("prefab"), resolve_path(F.lit(level), F.col("value")).alias("file")), "prefab")
    reached = own.select("prefab", F.col("prefab").alias("file")).union(inner.select("prefab", "file")).distinct()
    return reached.join(rows.filter("kind <> 'nested'"), "file").select("prefab", "file", "kind", "value")


def terrain_descriptors(texts: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """((file, material), (file, path)): distinct materials of terrain descriptors (file, text), and the data files that belong to them."""
    read = texts.select("file", F.from_json("text", "materials array<string>, datafile string, heightmapImage string").alias("d")).select("file", "d.*")
    materials = read.select("file", F.explode(F.array_distinct("materials")).alias("material"))
    paths = read.select("file", F.explode(F.array_compact(F.array("datafile", "heightmapImage"))).alias("p"))
    return materials, paths.select("file", resolve_path(F.lit(level), F.col("p")).alias("path"))


def level_files(texts: DataFrame, level: str) -> DataFrame:
    """(file, kind, path): previews, spawn points, gas stations and minimaps named by level information (file, text)."""
    point = "array<struct<preview:string>>"
    read = texts.select("file", F.from_json("text", f"previews array<string>, spawnPoints {point}, gasStationPoints {point}, minimap array<struct<file:string>>").alias("d")).select("file", "d.*")
    lists = {"preview": F.col("previews"), "spawn": F.col("spawnPoints.preview"), "gas": F.col("gasStationPoints.preview"), "minimap": F.col("minimap.file")}
    empty = F.array().cast("array<struct<kind:string,p:string>>")
    tagged = lambda k, v: F.coalesce(F.transform(v, lambda p: F.struct(F.lit(k).alias("kind"), p.alias("p"))), empty)
    each = F.concat(*[tagged(k, v) for k, v in lists.items()])
    return read.select("file", F.explode(each).alias("e")).filter("e.p IS NOT NULL").select("file", "e.kind", resolve_path(F.lit(level), F.col("e.p")).alias("path"))


def hierarchy(texts: DataFrame) -> DataFrame:
    """(file, class, name, parent): objects with a class in nested level files (file, text), in the order of the file (``place``).

    The parent is the nearest enclosing object with a name.  A document is
    walked with a stack, so depth has no bound; broken documents have no rows.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"]):
                rows, stack = [], []
                try:
                    stack.append((json.loads(text or "null"), None))
                except (ValueError, RecursionError):
                    continue
                while stack:
                    node, parent = stack.pop()
                    if not isinstance(node, dict):
                        continue
                    name = node.get("name") if isinstance(node.get("name"), str) else None
                    if isinstance(node.get("class"), str):
                        rows.append((file, len(rows), node["class"], name, parent))
                    children = node.get("childs")
                    stack.extend((c, parent if name is None else name) for c in reversed(children if isinstance(children, list) else []))
                yield pd.DataFrame(rows, columns=["file", "place", "class", "name", "parent"])

    return texts.select("file", "text").mapInPandas(walk, "file string, place long, class string, name string, parent string")


def decal_groups(names: DataFrame, decals: DataFrame) -> DataFrame:
    """(name, instances): decals (uid, name_index, rect, size, priority, px to tz) by name, each as 13 numbers in the order of their uid.

    ``names`` is (name_index, name); a group is one name of one decal file.
    """
    numbers = ["rect", "size", "priority", "px", "py", "pz", "nx", "ny", "nz", "tx", "ty", "tz", "uid"]
    rows = decals.join(names, "name_index").select("name", "uid", F.array(*[F.col(c).cast("float") for c in numbers]).alias("v"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("uid", "v"))).alias("i")).select("name", F.col("i.v").alias("instances"))


def texture_sizes(texts: DataFrame) -> DataFrame:
    """(file, base, detail, macro): first texture sizes of the first texture set in each material file (file, text)."""
    kind = "map<string, struct<class:string, baseTexSize:array<int>, detailTexSize:array<int>, macroTexSize:array<int>>>"
    sets = texts.select("file", F.posexplode(F.map_values(F.from_json("text", kind))).alias("i", "s")).filter("s.class = 'TerrainMaterialTextureSet'")
    first = sets.groupBy("file").agg(F.min_by("s", "i").alias("s"))
    return first.select("file", *[F.get(F.col(f"s.{k}TexSize"), F.lit(0)).alias(k) for k in ("base", "detail", "macro")])


def replaced_strings(texts: DataFrame, text: str, replacements: dict[str, str]) -> DataFrame:
    """``texts`` with every string value of the JSON in ``text`` that is a key of ``replacements`` replaced, at any depth; names of properties stay."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(document):
            if document is None:
                return None
            root = [json.loads(document)]
            stack = [root]
            while stack:
                node = stack.pop()
                for key, value in list(node.items() if isinstance(node, dict) else enumerate(node)):
                    if isinstance(value, (dict, list)):
                        stack.append(value)
                    elif isinstance(value, str) and value:
                        node[key] = replacements.get(value, value)
            return json.dumps(root[0], ensure_ascii=False)

        return column.map(one)

    return texts.withColumn(text, run(text))


def spline_documents(nodes: DataFrame, spline: str, order: str, values: list[str]) -> DataFrame:
    """(spline, document): the nodes of each spline in order, as JSON; a group is one spline."""
    rows = nodes.select(spline, F.struct(F.col(order).alias("_o"), F.struct(*values).alias("n")).alias("r"))
    listed = rows.groupBy(spline).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select(spline, F.to_json(F.struct(F.col(spline).alias("id"), F.col("r.n").alias("nodes"))).alias("document"))


def scene_items(buildings: DataFrame, folder: str) -> DataFrame:
    """(line): a scene object for each building (name, x, y, z), as JSON lines."""
    position = F.array(*[F.col(c).cast("double") for c in ("x", "y", "z")])
    shape = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("name"), F.lit(".dae"))
    return buildings.select(F.to_json(F.struct(F.lit("TSStatic").alias("class"), F.col("name"), position.alias("position"), shape.alias("shapeName"))).alias("line"))


def write_cache(features: DataFrame, key: str, box: list[str], path: str) -> DataFrame:
    """Writes ``features`` as gzip JSON in a folder for each ``key`` and returns the index (key, the columns of ``box``, n), read back from ``path``/index.

    Keys that are written again are replaced, others stay.  A hot key is dealt
    over the files of its folder.
    """
    spark = features.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        features.write.mode("overwrite").partitionBy(key).option("compression", "gzip").json(f"{path}/features")
        index = features.groupBy(key, *box).agg(F.count("*").alias("n"))
        index.write.mode("overwrite").partitionBy(key).parquet(f"{path}/index")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return spark.read.parquet(f"{path}/index")


def write_layers(pixels: DataFrame, columns: list[str], path: str) -> None:
    """Pixels (x, y, alpha) of the layers named by ``columns``, as runs (y, x0, x1, alpha), in a folder for each layer."""
    w = W.partitionBy(*columns, "y", "alpha").orderBy("x")
    runs = pixels.withColumn("_g", F.col("x") - F.row_number().over(w)).groupBy(*columns, "y", "alpha", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    runs.write.mode("overwrite").partitionBy(*columns).parquet(path)
