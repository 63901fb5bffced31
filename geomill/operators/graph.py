"""Connected components by alternating star contraction, and what is solved in each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from geomill.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


#: Edges up to which one task finds the components; more go by rounds, whatever their number.
TASK_EDGES = 500_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted nodes on the edges, and the least node reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most ``TASK_EDGES`` edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(*map(np.concatenate, zip(*held)))], ["node", "component"])

    return cut(edges.coalesce(1).mapInArrow(run, "node long, component long"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node on an edge; component is its smallest reachable node.

    ``edges`` holds two long columns; loops, repeats and rows with a null end
    are ignored.  Up to ``TASK_EDGES`` edges are one task's, as rounds of many
    small tasks would cost more than they hold.  Beyond that each round is two
    small shuffles of the edges, and the number of rounds grows with the
    logarithm of the longest path; every round is cut into the shared
    checkpoint folder.  Isolated nodes have no row.
    """
    stars = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(stars)
    if seen[0] <= TASK_EDGES:
        return _in_one_task(stars)
    for _ in range(max_rounds):
        stars = cut(_small_star(_large_star(stars)))
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())


def whole_groups(rows: DataFrame, key: str, solve: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """What ``solve`` makes of tables that hold every group of ``key`` whole, small ones many at a time.

    Groups are cut from batches that are sorted by ``key``, so a small one has
    no call of its own; a task holds its largest group and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, n = batch.column(key), batch.num_rows
            last = names[n - 1]
            begins = n - (pc.sum(pc.equal(names, last)).as_py() or 0) if last.is_valid else n - names.null_count
            if begins or held and not held[0].column(key)[0].equals(last):
                whole = [*held, *([batch.slice(0, begins)] if begins else [])]
                yield from solve(pa.Table.from_batches(whole)).to_batches()
                held = []
            held.append(batch.slice(begins))
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def plain(a: pa.Array) -> list:
    """``a.to_pylist()``, numbers, lists and structs by whole columns."""
    kind, none = a.type, a.is_null().to_numpy(zero_copy_only=False).tolist() if a.null_count else None
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, v)) for v in zip(*map(plain, a.flatten()))]
    elif pa.types.is_list(kind):
        values, stop = plain(a.flatten()), np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy()).tolist()
        out = [values[i:j] for i, j in zip([0, *stop], stop)]
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind):
        out = (pc.fill_null(a, 0) if none else a).to_numpy(zero_copy_only=False).tolist()
    else:
        return a.to_pylist()
    return [None if n else v for n, v in zip(none, out)] if none else out


def each_group(rows: DataFrame, key: str, solve: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """The rows in ``schema`` that ``solve`` makes of each group of ``key``; calls of Spark as in ``whole_groups``."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        rows = (dict(zip(table.column_names, v)) for v in zip(*(plain(c.combine_chunks()) for c in table.columns)))
        out = [r for _, group in groupby(rows, itemgetter(key)) for r in solve(list(group))]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return whole_groups(rows, key, run, schema)


#: Rows of a component that one task solves; larger ones are solved in rounds.
COMPONENT_ROWS = 500_000


def solved(rows: DataFrame, node: str, links: DataFrame, solve: Callable[[pa.Table], pa.Table], rounds: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """What ``solve`` keeps of the rows of each component; ``node`` names a row's node.

    It gets components whole, small ones many at a time, which it need not tell
    apart, as rows of different ones never bear on each other.

    Rows of a component of more than ``COMPONENT_ROWS`` go to ``rounds``
    together, which gives the same result without holding a component; without
    ``rounds`` any component is one task's.
    """
    parts = connected_components(links)
    placed = cut(rows.join(parts, F.col(node) == F.col("node"), "left").withColumn("_component", F.coalesce("component", node)).drop("node", "component"))
    names = placed.columns
    keep = lambda t: solve(t).select(names)
    if rounds is None:
        return whole_groups(placed, "_component", keep, placed.schema).drop("_component")
    large = placed.groupBy("_component").count().filter(F.col("count") > COMPONENT_ROWS).select("_component")
    small = placed.join(large, "_component", "left_anti")
    kept = whole_groups(small, "_component", keep, placed.schema).drop("_component")
    return kept if large.isEmpty() else kept.union(rounds(placed.join(large, "_component", "left_semi").drop("_component")))
