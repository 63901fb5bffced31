"""Readers and writers of text, JSON, XML and binary files of asset trees and map data."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of names of files that are never assets.
SKIPPED_NAMES = (".depth.", ".imposter", "foam", "ripple", "_heightmap", "_minimap")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, directory, name, ending, length) of the files under ``root``, without the skipped names; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("directory"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ending"), "length").filter(~F.lower("name").rlike("|".join(s.replace(".", r"\.") for s in SKIPPED_NAMES)))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of whole text files, lines counted from 1."""
    whole = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), "line")


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` that are objects, parsed: file, line_no and the columns of ``schema``; lines that don't parse go."""
    parsed = lines.withColumn("_r", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowComments": "true"}))
    return parsed.filter("_r IS NOT NULL AND _r._bad IS NULL AND trim(line) <> ''").select("file", "line_no", "_r.*").drop("_bad")


def object_map(texts: DataFrame, text: str, value_schema: str) -> DataFrame:
    """One row for each top-level property of a JSON object: the other columns, key and the value's columns."""
    clean = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    rest = [c for c in texts.columns if c != text]
    parsed = F.from_json(clean, f"map<string, struct<{value_schema}>>", {"allowComments": "true"})
    return texts.select(*rest, F.explode(parsed).alias("key", "value")).select(*rest, "key", "value.*")


def xml_materials(texts: DataFrame, text: str) -> DataFrame:
    """The other columns, id and name of every material element; the name ends at its first space."""
    rest = [c for c in texts.columns if c != text]
    pair = lambda a: F.regexp_extract("tag", rf'\b{a}\s*=\s*"([^"]*)"', 1)
    tags = texts.select(*rest, F.explode(F.regexp_extract_all(text, F.lit(r"(<material\b[^>]*>)"), 1)).alias("tag"))
    return tags.select(*rest, F.nullif(pair("id"), F.lit("")).alias("id"), F.split(pair("name"), " ")[0].alias("name"))


def quoted_paths(lines: DataFrame) -> DataFrame:
    """(file, line_no, path): the first quoted text of each script line; ``./`` goes and bare names get their file's folder."""
    quoted = F.regexp_extract("line", '"([^"]+)"', 1)
    path = F.regexp_replace(quoted, r"^\./", "")
    own = F.concat(F.regexp_replace("file", "[^/]*$", ""), path)
    return lines.filter(quoted != "").select("file", "line_no", F.when(path.contains("/"), path).otherwise(own).alias("path"))


def value_after(lines: DataFrame, mark: str, key: str) -> DataFrame:
    """(file, line_no, value): the first ``key = value`` line after each line that holds ``mark``."""
    w = W.partitionBy("file").orderBy("line_no")
    found = F.col("line").contains(mark)
    value = F.regexp_extract("line", rf"(?i)^\s*{key}\s*=\s*\"?([^\";]*)", 1)
    group = lines.withColumn("_g", F.sum(found.cast("int")).over(w)).withColumn("_v", F.nullif(F.trim(value), F.lit("")))
    first = group.filter("_g > 0 AND _v IS NOT NULL").groupBy("file", "_g").agg(F.min_by("_v", "line_no").alias("value"), F.min("line_no").alias("line_no"))
    return first.select("file", "line_no", "value")


def key_values(lines: DataFrame) -> DataFrame:
    """(file, key, value) of ``key = value`` lines; comments, sections and lines without a sign go, and the last of a key wins."""
    parts = F.split("line", "=", 2)
    rows = lines.filter(~F.trim("line").rlike(r"^([;#\[]|//|$)") & F.col("line").contains("=")).select("file", "line_no", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
    return rows.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))


def log_paths(lines: DataFrame, phrases: list[str], existing: DataFrame, path: str) -> DataFrame:
    """Distinct (path) of existing files named in the log lines that hold any of ``phrases``."""
    held = lines.filter(F.lower("line").rlike("|".join(p.lower() for p in phrases)))
    tokens = held.select(F.explode(F.split("line", r"[\"'|;\s]+")).alias("token")).filter("token <> ''").distinct()
    return tokens.join(existing.select(F.lower(path).alias("_p")).distinct(), F.lower("token") == F.col("_p"), "left_semi").select(F.col("token").alias("path"))


OSM_SCHEMA = "elements array<struct<type string, id bigint, lat double, lon double, tags map<string,string>, nodes array<bigint>, geometry array<struct<lat double, lon double>>, members array<struct<type string, ref bigint, role string, geometry array<struct<lat double, lon double>>>>>>"


def osm_elements(texts: DataFrame, text: str) -> DataFrame:
    """One row an element of map-query answers: the other columns, type, id, tags, nodes, geometry and members.

    Ways with fewer than two points go; node ids go where they don't match the
    geometry in number.
    """
    rest = [c for c in texts.columns if c != text]
    e = texts.select(*rest, F.explode(F.from_json(text, OSM_SCHEMA)["elements"]).alias("e")).select(*rest, "e.*")
    usable = (F.col("type") != "way") | (F.size("geometry") >= 2)
    return e.filter(usable).withColumn("nodes", F.when(F.size("nodes") == F.size("geometry"), F.col("nodes")))


def geometry_type(tags: str, geometry: str, kind: str) -> Column:
    """point, line or polygon of an element: by relation type, the ``area`` tag, tags of areas and of lines, and closed outlines."""
    first, last = F.get(geometry, F.lit(0)), F.try_element_at(F.col(geometry), F.lit(-1))
    closed = F.coalesce((F.size(geometry) > 2) & (F.abs(first.lat - last.lat) < 1e-7) & (F.abs(first.lon - last.lon) < 1e-7), F.lit(False))
    tag = lambda k: F.try_element_at(F.col(tags), F.lit(k))
    relation = F.col(kind) == "relation"
    outline = F.when(relation | closed, "polygon").otherwise("line")
    return (
        F.when(F.col(kind) == "node", "point")
        .when(relation & tag("type").isin("multipolygon", "boundary"), "polygon")
        .when(F.lower(tag("area")) == "yes", "polygon")
        .when(F.lower(tag("area")) == "no", "line")
        .when(F.coalesce(*map(tag, ("building", "landuse", "leisure", "amenity", "boundary"))).isNotNull(), outline)
        .when(tag("natural") == "coastline", "line")
        .when(tag("natural").isNotNull(), outline)
        .when(tag("waterway").isNotNull(), F.when(tag("waterway") == "riverbank", "polygon").otherwise("line"))
        .when(F.coalesce(tag("highway"), tag("railway")).isNotNull(), "line")
        .otherwise(F.when(closed, "polygon").otherwise("line"))
    )


def xyz_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of white-space separated elevation points; other lines go."""
    cols = F.split(F.trim(F.col("value")), r"[\s;,]+")
    rows = spark.read.text(path).filter(F.size(cols) >= 3).select(*[F.get(cols, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")])
    return rows.dropna()


def likely_projection(points: DataFrame) -> DataFrame:
    """One row (epsg): 25832 if all points lie where that projection puts central Europe, else null."""
    span = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return span.select(F.when((F.col("x0") >= 200_000) & (F.col("x1") <= 1_000_000) & (F.col("y0") >= 5_000_000) & (F.col("y1") <= 6_500_000), 25832).alias("epsg"))


#: Version of the terrain format, and the material of a hole.
TERRAIN_VERSION, HOLE = 9, 255


def decode_terrain(data: bytes, most: float) -> tuple[pd.DataFrame, list[str]]:
    """Pixels (x, y, height, material, is_hole) and material names of a version 9 terrain file."""
    version, size = struct.unpack_from("<BI", data)
    if version != TERRAIN_VERSION:
        raise ValueError(f"terrain version {version}, not {TERRAIN_VERSION}")
    n = size * size
    raw = np.frombuffer(data, "<u2", n, 5)
    material = np.frombuffer(data, np.uint8, n, 5 + 2 * n)
    at, names = 5 + 3 * n, []
    (count,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(count):
        width = data[at]
        names.append(data[at + 1 : at + 1 + width].decode())
        at += 1 + width
    hole = material == HOLE
    i = np.arange(n)
    return pd.DataFrame({"x": i % size, "y": i // size, "height": raw / 65535.0 * most, "material": np.where(hole, 0, material).astype(int), "is_hole": hole}), names


def encode_terrain(pixels: pd.DataFrame, names: list[str], most: float) -> bytes:
    """A version 9 terrain file of a square of pixels (x, y, height, material, is_hole); heights are clamped and cut to 16 bits."""
    pixels = pixels.sort_values(["y", "x"])
    size = int(round(len(pixels) ** 0.5))
    raw = np.clip(pixels["height"].to_numpy(float) / most * 65535, 0, 65535).astype("<u2")
    material = np.where(pixels["is_hole"], HOLE, pixels["material"]).astype(np.uint8)
    tail = b"".join(bytes([len(n.encode())]) + n.encode() for n in names)
    return struct.pack("<BI", TERRAIN_VERSION, size) + raw.tobytes() + material.tobytes() + struct.pack("<I", len(names)) + tail


def read_terrain(spark: SparkSession, path: str, most: float) -> DataFrame:
    """(file, x, y, height, material, is_hole) of the terrain files under ``path``."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                pixels, _ = decode_terrain(data.as_py(), most)
                for lo in range(0, len(pixels), 1 << 16):
                    part = pixels.iloc[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), *(pa.array(part[c].to_numpy()) for c in part.columns)], ["file", *part.columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, x long, y long, height double, material long, is_hole boolean")


def zip_entries(spark: SparkSession, path: str, endings: tuple[str, ...] = ()) -> DataFrame:
    """(file, entry, content) of the files in archives under ``path``, one entry at a time."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for e in z.infolist():
                        if not e.is_dir() and (not endings or e.filename.lower().endswith(endings)):
                            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([e.filename]), pa.array([z.read(e)], pa.binary())], ["file", "entry", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, entry string, content binary")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """``rows`` as one JSON object a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_by(rows: DataFrame, columns: list[str], path: str, form: str = "parquet") -> None:
    """``rows`` in a folder for each value of ``columns``, one file a folder and task that holds it."""
    rows.repartition(*columns).write.mode("overwrite").partitionBy(*columns).format(form).save(path)


def delete_plan(wanted: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """``wanted`` with ``found``: what a deletion would do; nothing is deleted here."""
    return wanted.join(existing.select(F.lower(path).alias("_p")).distinct().withColumn("_f", F.lit(True)), F.lower(path) == F.col("_p"), "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_p", "_f")


def without_lines(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """``lines`` (file, line_no, line) without those named in ``gone`` (file, line_no)."""
    return lines.join(gone.select("file", "line_no").distinct(), ["file", "line_no"], "left_anti")
