"""Copying records between levels: renames, replacements, merges into a target, and nested layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def route(rows: DataFrame, routes: dict[str, Column], default: str = "other") -> DataFrame:
    """``rows`` with ``route``: the first of ``routes`` (name -> condition) that holds."""
    chosen = F.coalesce(*[F.when(c, F.lit(n)) for n, c in routes.items()], F.lit(default))
    return rows.withColumn("route", chosen)


def renamed(name: str, suffix: str) -> Column:
    """A copied record's name: with ``suffix``, once."""
    return F.when(F.endswith(name, F.lit(suffix)), F.col(name)).otherwise(F.concat(name, F.lit(suffix)))


def replace_records(targets: DataFrame, sources: DataFrame, keys: list[str], source_key: str, order: str, kept: list[str]) -> DataFrame:
    """``targets`` with the properties of the first source (in ``order``) whose key equals any of ``keys``, case counting; ``kept`` columns and unmatched rows stay."""
    w = W.partitionBy(source_key).orderBy(order)
    first = sources.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    props = [c for c in targets.columns if c not in kept]
    side = first.select(F.col(source_key).alias("_k"), F.struct(F.col(order).alias("_o"), *props).alias("_s"))
    out = targets
    for i, key in enumerate(keys):
        out = out.join(side.select(F.col("_k").alias(f"_k{i}"), F.col("_s").alias(f"_s{i}")), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = F.array_min(F.array_compact(F.array(*[f"_s{i}" for i in range(len(keys))])))
    out = out.withColumn("_f", found)
    return out.select(*[F.when(F.col("_f").isNotNull(), F.col("_f")[c]).otherwise(F.col(c)).alias(c) if c in props else F.col(c) for c in targets.columns])


def covers_of(covers: DataFrame, layers: str, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose array ``layers`` holds any of ``wanted``'s names."""
    keyed = covers.withColumn("_layer", F.explode(layers))
    hit = keyed.join(wanted.select(F.col(name).alias("_layer")).distinct(), "_layer", "left_semi").drop("_layer")
    return hit.distinct()


def without_layers(covers: DataFrame, layers: str, gone: list[str]) -> DataFrame:
    """``covers`` without the layers in ``gone``; rows left without a layer go, rows that had none stay."""
    kept = F.filter(layers, lambda x: ~x.isin(*gone)) if gone else F.col(layers)
    return covers.withColumn("_before", F.size(layers)).withColumn(layers, kept).filter(f"size({layers}) > 0 OR _before = 0").drop("_before")


def remap(values: str, names: dict[str, str]) -> Column:
    """An array with each value replaced as ``names`` says; others stay."""
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v), v))


def name_map(rows: DataFrame, columns: list[str], to: str) -> DataFrame:
    """Distinct (name, target) from each of ``columns`` to ``to``."""
    return rows.select(F.explode(F.array_compact(F.array(*columns))).alias("name"), F.col(to).alias("target")).filter("target IS NOT NULL").distinct()


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """``target`` with ``changes`` written over it by key, the last in ``order`` winning."""
    last = changes.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)
    return target.join(last.select(*key), key, "left_anti").unionByName(last.select(*target.columns))


def missing_in(target: DataFrame, copies: DataFrame, keys: list[str]) -> DataFrame:
    """``copies`` of which no key in ``keys`` is in ``target``."""
    for key in keys:
        copies = copies.join(target.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return copies


def brush_sizes(brushes: DataFrame, brush: str, items: str, sizes: DataFrame, item: str, size: str) -> DataFrame:
    """(brush, n_items, total): the distinct items of each brush that exist, and their summed size."""
    refs = brushes.select(brush, F.explode_outer(items).alias("_i")).distinct()
    found = refs.join(sizes.select(F.col(item).alias("_i"), F.col(size).alias("_s")), "_i", "left")
    return found.groupBy(brush).agg(F.count("_s").alias("n_items"), F.coalesce(F.sum("_s"), F.lit(0)).alias("total"))


def script_blocks(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, block, name, properties): objects of a script, from a line with ``name(...)`` and ``{`` to the next; ``key = value;`` lines are properties, ``key[i] = value;`` lines gather under their key."""
    w = W.partitionBy(file).orderBy(number)
    head = F.regexp_extract(line, r"^\s*\w+\s*(\w+)\s*\(\s*(\w+)\s*\)", 2)
    starts = F.when(F.length(head) > 0, 1).otherwise(0)
    marked = lines.withColumn("_b", F.sum(starts).over(w)).withColumn("_h", F.nullif(head, F.lit("")))
    key = F.regexp_extract(line, r"^\s*(\w+)\s*(?:\[\d+\])?\s*=", 1)
    value = F.regexp_replace(F.regexp_extract(line, r"=\s*(.*?);?\s*$", 1), '^"|"$', "")
    names = marked.filter("_h IS NOT NULL").select(file, "_b", F.col("_h").alias("name"))
    props = marked.withColumn("_k", key).filter("_b > 0 AND _k <> ''").groupBy(file, "_b", "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), value.alias("v")))), lambda s: s.v).alias("v"))
    maps = props.groupBy(file, "_b").agg(F.map_from_entries(F.collect_list(F.struct("_k", "v"))).alias("properties"))
    return names.join(maps, [file, "_b"], "left").select(file, F.col("_b").alias("block"), "name", "properties")


def material_lookup(materials: DataFrame, name: str, kind: str, order: str, first: str) -> DataFrame:
    """One row a name: the first in ``order`` of the class ``first`` (case does not count), else the first of any other; ``in_both`` tells names of both."""
    is_first = F.coalesce(F.lower(kind) == first.lower(), F.lit(False))
    rows = materials.withColumn("_f", is_first)
    best = rows.groupBy(name).agg(F.min_by(F.struct(*[c for c in materials.columns if c != name]), F.struct((~F.col("_f")).alias("a"), F.col(order).alias("o"))).alias("_b"), (F.max("_f") & ~F.min("_f")).alias("in_both"))
    return best.select(name, "_b.*", "in_both")


def level_path(path: str, keep_ending: bool = False) -> Column:
    """A file's path from ``levels/`` on, in small letters with forward slashes, without its ending; empty where no folder levels is in it."""
    clean = F.lower(F.replace(F.regexp_replace(path, r"(?i)\.link$", ""), F.lit("\\"), F.lit("/")))
    parts = F.split(clean, "/levels/")
    found = F.concat(F.lit("levels/"), F.element_at(parts, -1))
    return F.when(F.size(parts) < 2, F.lit("")).otherwise(found if keep_ending else F.regexp_replace(found, r"\.[^./]*$", ""))


def inherited(tags: str, parent: str, defaults: dict[str, str]) -> list[Column]:
    """A column for each key of ``defaults``: the own tag, else the parent's, else the default; empty tags count as missing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return [F.coalesce(blank(F.col(tags)[k]), blank(F.col(parent)[k]), F.lit(v)).alias(k) for k, v in defaults.items()]


def used_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value): distinct values of several columns."""
    return rows.select(F.explode(F.array(*columns)).alias("value")).filter("value IS NOT NULL").distinct()
