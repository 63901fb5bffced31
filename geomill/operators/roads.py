"""From the ways of a map to roads: lines in metres, relations assembled, lines joined end to end, curves.

A road line is a row (path, ord, way, start_node, end_node, xs, ys, highway,
junction, oneway); ``ord`` is an array by which earlier lines come first, a
node is null where the map has none or the line was cut at the border.
Searches send the lines' ends, never whole lines; the points of the parts of a
joined road meet when it is put together.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.operators import spatial
from geomill.operators.graph import connected_components, each_group
from geomill.operators.series import lookup
from geomill.operators.splines import clip_to_square, flat, spline_samples, without_repeats, without_repeats_each
from geomill.session import cut

#: How far along a line its direction at an end is taken, in metres.
LOOKBACK = 30.0
#: Scores of a join: a common node, a common relation, a line turned round.
SHARED_NODE, SHARED_RELATION, REVERSAL = 0.5, 0.5, 0.001
#: Two one-way roads that meet at a cosine below this turn back.
U_TURN = -0.7

#: Road classes that join with each other, by the name of their group; other classes join with themselves.
CLASS_GROUPS = {
    "motorway_link": "motorway",
    "trunk_link": "trunk",
    "primary_link": "primary",
    "secondary_link": "secondary",
    "tertiary_link": "tertiary",
    "path": "track",
}

_PARTS = "path long, joined long, position long, reversed boolean, skip_first boolean, skip_last boolean"


def terrain_lines(ways: DataFrame, box: tuple[float, float, float, float], size: int, pixel: float, tolerance: float = 0.01) -> DataFrame:
    """``ways`` (way, lons, lats, nodes and others) as lines in metres on a square terrain.

    Longitudes and latitudes give way to xs and ys from the bottom left of the
    box, cut at the border as ``clip_to_square`` does, without points within
    ``tolerance`` of the last kept one; nodes to start_node and end_node, null
    where the line was cut or had no nodes.  Lines of less than two points go.
    """
    others = [f for f in ways.schema if f.name not in ("lons", "lats", "nodes")]
    wide, high = box[2] - box[0], box[3] - box[1]

    names = [*(f.name for f in others), "start_node", "end_node", "xs", "ys"]

    def crossing(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Lines of which a point lies outside, one by one."""
        lon, lat, first = flat(batch, "lons", "lats")
        x, y = (lon - box[0]) / wide * size, (lat - box[1]) / high * size
        nodes = batch.column("nodes").to_pylist()
        rows, xs, ys, ends = [], [], [], []
        for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(x)])):
            if b - a < 2:
                continue
            px, py, cut_start, cut_end = clip_to_square(x[a:b], y[a:b], size)
            px, py = px * pixel, py * pixel
            keep = without_repeats(px, py, tolerance)
            if keep.sum() < 2:
                continue
            own = nodes[i] or [None]
            rows.append(i)
            xs.append(px[keep])
            ys.append(py[keep])
            ends.append((None if cut_start else own[0], None if cut_end else own[-1]))
        kept = batch.take(pa.array(rows, pa.int64()))
        columns = [*(kept.column(f.name) for f in others), *(pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in batches:
            lon, lat, first = flat(batch, "lons", "lats")
            x, y = (lon - box[0]) / wide * size, (lat - box[1]) / high * size
            stop = np.append(first[1:], len(x))
            total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[np.column_stack([first, stop])])[:, 0]
            whole = total((x >= 0) & (x <= size) & (y >= 0) & (y <= size)) == stop - first
            if not whole.all():
                yield crossing(batch.filter(pa.array(~whole)))
            # lines inside the square are done all at once
            x, y = x * pixel, y * pixel
            keep = without_repeats_each(x, y, first, tolerance)
            many = total(keep)
            own = whole & (many >= 2)
            keep &= np.repeat(own, stop - first)
            kept, offsets = batch.filter(pa.array(own)), pa.array(np.append(0, np.cumsum(many[own])).astype(np.int32))
            n = pc.fill_null(pc.list_value_length(kept.column("nodes")), 0).to_numpy().astype(np.int64)
            begin = np.cumsum(n) - n
            ends = [kept.column("nodes").flatten().take(pa.array(at, pa.int64(), mask=n == 0)).cast(pa.int64()) for at in (begin, begin + n - 1)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[keep])) for v in (x, y)]
            yield pa.RecordBatch.from_arrays([*(kept.column(f.name) for f in others), *ends, *lists], names)

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return ways.mapInArrow(run, f"{kinds}start_node long, end_node long, xs array<double>, ys array<double>")


def is_one_way(oneway: str | Column, reverse: bool) -> Column:
    """Tag of a one-way road; with ``reverse`` also of one against the direction of its line."""
    c = F.col(oneway) if isinstance(oneway, str) else oneway
    return F.coalesce(c.isin("yes", "true", "1", *(["-1"] if reverse else [])), F.lit(False))


def _point(i: int) -> Column:
    return F.struct(F.element_at("xs", i).alias("x"), F.element_at("ys", i).alias("y"))


def _turns_back(a: tuple, b: tuple, c: tuple) -> bool:
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    u, v = ux * ux + uy * uy, vx * vx + vy * vy
    return u >= 1e-8 and v >= 1e-8 and (ux * vx + uy * vy) / math.sqrt(u * v) < U_TURN


class _Chain:
    """Consecutive ways of a relation; ends hold (node, last point, the point before it), one at the start and one at the end."""

    def __init__(self, row):
        p = [(row[k]["x"], row[k]["y"]) for k in ("p0", "p1", "q1", "q0")]
        self.one_way, self.parts = row["one_way"], [(row["path"], False)]
        self.ends = [(row["start_node"], p[0], p[1]), (row["end_node"], p[3], p[2])]

    def take(self, other: "_Chain", role: str) -> bool:
        """Joins ``other`` at the first pair of ends, in the order that the role asks for, which share a node and do not turn back."""
        order = [(1, 0), (1, 1)] if role != "backward" else [(1, 1), (1, 0)]
        for own, its in [*order, (0, 1), (0, 0)]:
            a, b = self.ends[own], other.ends[its]
            if a[0] is None or a[0] != b[0]:
                continue
            # the connection is the point of whichever comes first along the result
            back = _turns_back(a[2], a[1], b[2]) if own else _turns_back(b[2], b[1], a[2])
            if self.one_way and other.one_way and back:
                continue
            turned = own == its
            parts = [(p, not r) for p, r in reversed(other.parts)] if turned else other.parts
            self.parts = self.parts + parts if own else parts + self.parts
            self.ends[own] = other.ends[1 - its]
            return True
        return False


def relation_chains(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(path, joined, position, reversed, skip_first, skip_last and the chain's place): lines that relations assemble.

    ``members`` are (relation, relation_order, member_order, way, role).  A way
    belongs to the first relation that lists it.  Along a relation each member
    joins the chain before it if they share a node at their ends, the role
    saying which ends are tried first, and not where both are one-way and
    would turn back; else it begins a new chain.  A chain is named after the
    path of its first member.  Lines of no relation are left out.
    """
    owner = members.groupBy("way").agg(F.min("relation_order").alias("relation_order"))
    ends = lines.select("path", "way", "start_node", "end_node", is_one_way("oneway", True).alias("one_way"), _point(1).alias("p0"), _point(2).alias("p1"), _point(-2).alias("q1"), _point(-1).alias("q0"))
    own = members.join(owner, ["way", "relation_order"]).select("relation_order", "member_order", "way", F.coalesce("role", F.lit("")).alias("role")).join(ends, "way")

    def run(rows: list[dict]) -> list[tuple]:
        chains: list[tuple[int, _Chain]] = []
        for row in sorted(rows, key=lambda r: (r["member_order"], r["path"])):
            new = _Chain(row)
            if not chains or not chains[-1][1].take(new, row["role"]):
                chains.append((row["path"], new))
        return [(path, name, place, turned, place > 0, False, rows[0]["relation_order"], i) for i, (name, c) in enumerate(chains) for place, (path, turned) in enumerate(c.parts)]

    # only the ends of a relation's lines meet in a task
    return each_group(own, "relation_order", run, f"{_PARTS}, relation_order long, chain long")


def put_together(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """(joined, xs, ys, start_node, end_node): the points of the parts (path, joined, position, reversed, skip_first, skip_last) in order; where two meet, one of them skips its point."""
    first, last = F.col("skip_first").cast("int"), F.col("skip_last").cast("int")
    way = lambda c: F.slice(F.when(F.col("reversed"), F.reverse(c)).otherwise(F.col(c)), first + 1, F.size(c) - first - last)
    own = parts.join(lines.select("path", "xs", "ys", "start_node", "end_node"), "path")
    start, end = F.when(F.col("reversed"), F.col("end_node")).otherwise(F.col("start_node")), F.when(F.col("reversed"), F.col("start_node")).otherwise(F.col("end_node"))
    rows = own.select("joined", F.struct("position", way("xs").alias("xs"), way("ys").alias("ys"), start.alias("first"), end.alias("last")).alias("p"))
    lists = rows.groupBy("joined").agg(F.array_sort(F.collect_list("p")).alias("p"))
    rest = lambda c: F.flatten(F.transform("p", lambda q: q[c]))
    return lists.select("joined", rest("xs").alias("xs"), rest("ys").alias("ys"), F.element_at("p", 1)["first"].alias("start_node"), F.element_at("p", -1)["last"].alias("end_node"))


def assembled_by_relations(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Lines with the chains of ``relation_chains`` in place of their parts; a chain has the name and tags of its first member, and chains come before other lines."""
    parts = cut(relation_chains(lines, members))
    whole = put_together(lines, parts).withColumnRenamed("joined", "path")
    place = parts.groupBy("joined").agg(F.min(F.array(F.lit(0).cast("long"), "relation_order", "chain")).alias("_place")).withColumnRenamed("joined", "path")
    tags = lines.drop("xs", "ys", "start_node", "end_node", "ord")
    chains = tags.join(whole, "path").join(place, "path").withColumnRenamed("_place", "ord")
    rest = lines.join(parts.select("path").distinct(), "path", "left_anti").withColumn("ord", F.concat(F.array(F.lit(1).cast("long")), "ord"))
    return chains.select(rest.columns).union(rest)


def _stub(reverse: bool) -> Column:
    """The points of a line from an end on, up to the first that lies ``LOOKBACK`` along it or more."""
    xs, ys = (F.reverse("xs"), F.reverse("ys")) if reverse else (F.col("xs"), F.col("ys"))
    step = F.zip_with(F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.sequence(F.lit(1), F.size("xs")), lambda p, i: p)

    def grow(kept, p):
        last = F.element_at(kept["points"], -1)
        go = kept["length"] + F.sqrt(F.pow(p.x - last.x, 2) + F.pow(p.y - last.y, 2))
        return F.when(kept["length"] >= LOOKBACK, kept).otherwise(F.struct(F.concat(kept["points"], F.array(p)).alias("points"), go.alias("length")))

    start = F.struct(F.slice(step, 1, 1).alias("points"), F.lit(0.0).alias("length"))
    return F.aggregate(F.slice(step, 2, F.greatest(F.size("xs") - 1, F.lit(0))), start, grow, lambda kept: kept["points"])


def direction_point(points: list) -> tuple:
    """The place ``LOOKBACK`` along the points, or their last."""
    run = 0.0
    for a, b in zip(points, points[1:]):
        step = math.dist(a, b)
        run += step
        if run >= LOOKBACK:
            t = (run - LOOKBACK) / step
            return b[0] + (a[0] - b[0]) * t, b[1] + (a[1] - b[1]) * t
    return points[-1]


class _Path:
    """A line being joined: its place in the order, its tags, and for each end (0 start, 1 end) its tip, node and stub.

    A tip is named after the line it was an end of first.  A stub holds the
    points from an end on; it is full where it holds all of the line's.
    """

    __slots__ = ("ord", "way", "one_way", "group", "tips", "nodes", "stubs", "full", "parts", "version")

    def __init__(self, i: int, row: dict):
        self.ord, self.way, self.one_way, self.group = (tuple(row["ord"]), row["path"]), row["way"], row["one_way"], row["grp"]
        self.tips, self.nodes = [(i, 0), (i, 1)], [row["start_node"], row["end_node"]]
        self.stubs = [[(p["x"], p["y"]) for p in row[k]] for k in ("from_start", "from_end")]
        self.full = [len(s) == row["n"] for s in self.stubs]
        self.parts, self.version = [(row["path"], False, False, False)], 0

    def join(self, end: int, other: "_Path", its: int) -> None:
        """Goes on at ``end`` with ``other`` from the end ``its``; the second along the result loses the point at which they meet."""
        parts = [(n, not r, last, first) for n, r, first, last in reversed(other.parts)] if end == its else other.parts
        one, two = (self.parts, parts) if end else (parts, self.parts)
        name, turned, _, last = two[0]
        self.parts = [*one, (name, turned, True, last), *two[1:]]
        mine, theirs = self.stubs[end], other.stubs[its]
        old, new = self.stubs[1 - end], other.stubs[1 - its]
        a = (old, theirs[1:]) if end else (old[:-1], theirs)
        b = (new[:-1], mine) if end else (new, mine[1:])
        full = self.full[end], other.full[its]
        old, old_full = _grown(*a, full[1]) if self.full[1 - end] else (old, False)
        new, new_full = _grown(*b, full[0]) if other.full[1 - its] else (new, False)
        self.stubs[1 - end], self.full[1 - end], self.stubs[end], self.full[end] = old, old_full, new, new_full
        self.tips[end], self.nodes[end] = other.tips[1 - its], other.nodes[1 - its]
        self.version += 1


def _grown(points: list, more: list, full: bool) -> tuple[list, bool]:
    """``points`` and ``more`` up to the first that lies ``LOOKBACK`` along them, and whether that is all there is."""
    run, points = 0.0, points + more
    for n, (a, b) in enumerate(zip(points, points[1:])):
        run += math.dist(a, b)
        if run >= LOOKBACK:
            return points[: n + 2], full and n + 2 == len(points)
    return points, full


def join_greedily(rows: list[dict], valence: dict, relations: dict, tolerance: float) -> list[list[tuple[int, bool, bool, bool]]]:
    """The parts (path, reversed, skip_first, skip_last) of each road, joining the best pair of ends of all each time.

    A pair's score is the cosine of the turn, seen ``LOOKBACK`` along either
    line as joined so far, more for a common node and a common relation, less
    for turning the later line round.  Ends pair by their node, or where one
    has none by nearness.  Of equal scores the pair of the earliest lines
    wins.  One-way lines are not turned round, and at nodes of three ends or
    more roads go on within a right angle.
    """
    paths = {i: _Path(i, r) for i, r in enumerate(rows)}
    owner = {tip: (i, end) for i, p in paths.items() for end, tip in enumerate(p.tips)}
    node = {tip: p.nodes[end] for p in paths.values() for end, tip in enumerate(p.tips)}
    place = {tip: p.stubs[end][0] for p in paths.values() for end, tip in enumerate(p.tips)}
    square = lambda tip: (math.floor(place[tip][0] / tolerance), math.floor(place[tip][1] / tolerance))
    at_node: dict = {}
    cells: dict = {}
    for tip in owner:
        if node[tip] is not None:
            at_node.setdefault(node[tip], []).append(tip)
        cells.setdefault(square(tip), []).append(tip)

    def partners(tip: tuple):
        own = node[tip]
        yield from at_node.get(own, ()) if own is not None else ()
        cx, cy = square(tip)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for other in cells.get((cx + dx, cy + dy), ()):
                    if (own is None or node[other] is None) and math.dist(place[other], place[tip]) <= tolerance:
                        yield other

    heap: list = []

    def offer(a: tuple, b: tuple) -> None:
        (i, s), (j, t) = owner[a], owner[b]
        if i == j:
            return
        if paths[j].ord < paths[i].ord:
            i, s, j, t = j, t, i, s
        p, q = paths[i], paths[j]
        if p.group is not None and q.group is not None and p.group != q.group or s == t and q.one_way:
            return
        # they meet at the end of the line that comes first in the order
        x, y = p.stubs[s][0]
        (ax, ay), (bx, by) = direction_point(p.stubs[s]), direction_point(q.stubs[t])
        ux, uy, vx, vy = x - ax, y - ay, bx - x, by - y
        u, v = ux * ux + uy * uy, vx * vx + vy * vy
        if u < 1e-8 or v < 1e-8:
            return
        cosine, shared = (ux * vx + uy * vy) / math.sqrt(u * v), node[a] is not None and node[a] == node[b]
        if shared and valence[node[a]] >= 3 and cosine <= 0:
            return
        common = bool(relations.get(p.way, frozenset()) & relations.get(q.way, frozenset()))
        score = cosine + SHARED_NODE * shared + SHARED_RELATION * common - REVERSAL * (s == t)
        kind = ((3, 2), (0, 1))[s][t]
        heapq.heappush(heap, (-score, p.ord, q.ord, kind, i, p.version, s, j, q.version, t))

    for tip in owner:
        for other in partners(tip):
            if tip < other:
                offer(tip, other)
    while heap:
        *_, i, v, s, j, w, t = heapq.heappop(heap)
        if i not in paths or j not in paths or paths[i].version != v or paths[j].version != w:
            continue
        p, q = paths[i], paths.pop(j)
        del owner[p.tips[s]], owner[q.tips[t]]
        p.join(s, q, t)
        owner[p.tips[s]] = i, s
        for tip in p.tips:
            for other in partners(tip):
                if other in owner:
                    offer(tip, other)
    return [p.parts for p in paths.values()]


def _components(lines: DataFrame, tolerance: float) -> DataFrame:
    """(node, component) over paths of which an end may join: through common nodes and classes, and through grid cells with an end that has no node."""
    end = lambda i, node: F.struct(F.col(node).alias("node"), F.element_at("xs", i).alias("x"), F.element_at("ys", i).alias("y"))
    tips = lines.select("path", "grp", F.explode(F.array(end(1, "start_node"), end(-1, "end_node"))).alias("t")).select("path", "grp", "t.*")
    named = tips.filter("node IS NOT NULL")
    mixed = named.groupBy("node").agg(F.max(F.col("grp").isNull()).alias("_any"))
    keyed = named.join(mixed, "node").select("path", "node", F.when(F.col("_any"), "").otherwise(F.col("grp")).alias("g"))
    least = keyed.groupBy("node", "g").agg(F.min("path").alias("m"))
    links = keyed.join(least, ["node", "g"]).select(F.col("path").alias("a"), F.col("m").alias("b"))
    at = tips.select("path", F.col("node").isNull().alias("_loose"), spatial.cell("x", tolerance).alias("cx"), spatial.cell("y", tolerance).alias("cy"))
    heads = at.groupBy("cx", "cy").agg(F.min("path").alias("head"), F.max("_loose").alias("loose"))
    inside = at.join(heads.filter("loose"), ["cx", "cy"]).select(F.col("path").alias("a"), F.col("head").alias("b"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    beside = heads.filter("loose").select("cx", "cy", F.col("head").alias("a"), step.alias("d")).select((F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), "a")
    # an end beside one without a node may itself have a node: its cell hangs together then
    other = beside.join(at, ["cx", "cy"]).select("a", F.col("path").alias("b"))
    return connected_components(links.union(inside).union(other))


def connected(lines: DataFrame, tolerance: float, members: DataFrame | None = None) -> DataFrame:
    """(path, joined, position, reversed, skip_first, skip_last): the roads that ``join_greedily`` makes of lines, named after their earliest line.

    Roundabouts never join, nor do classes of different groups.  Lines that
    may hang together are joined in one task, which gets their ends: a few
    points, nodes and tags a line.  Classes and relations keep such parts of
    a network small; ``members`` (relation, way) are relations.
    """
    tag = F.col("highway")
    grp = F.when(tag != "", F.coalesce(lookup(CLASS_GROUPS, tag, None), tag))
    ring = F.coalesce(F.lower("junction") == "roundabout", F.lit(False))
    valence = lines.select(F.explode(F.array("start_node", "end_node")).alias("node")).filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("v"))
    own = lines.filter(~ring).withColumn("grp", grp)
    parts = _components(own, tolerance)
    rows = own.join(parts, F.col("path") == F.col("node")).select("component", "path", "ord", "way", "start_node", "end_node", "grp", is_one_way("oneway", False).alias("one_way"), F.size("xs").alias("n"), _stub(False).alias("from_start"), _stub(True).alias("from_end"))
    for end in ("start", "end"):
        rows = rows.join(valence.select(F.col("node").alias(f"{end}_node"), F.col("v").alias(f"{end}_v")), f"{end}_node", "left")
    if members is not None:
        rows = rows.join(members.groupBy("way").agg(F.collect_set("relation").alias("rels")), "way", "left")
    else:
        rows = rows.withColumn("rels", F.lit(None).cast("array<long>"))

    def run(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r["ord"], r["path"]))
        many = {r[f"{end}_node"]: r[f"{end}_v"] for r in rows for end in ("start", "end")}
        relations = {r["way"]: frozenset(r["rels"]) for r in rows if r["rels"]}
        rank = {r["path"]: i for i, r in enumerate(rows)}
        return [(path, min(road, key=lambda part: rank[part[0]])[0], i, *rest) for road in join_greedily(rows, many, relations, tolerance) for i, (path, *rest) in enumerate(road)]

    found = each_group(rows, "component", run, _PARTS)
    alone = lines.select("path").join(parts.select(F.col("node").alias("path")).join(own.select("path"), "path", "left_semi"), "path", "left_anti")
    return found.union(alone.select("path", F.col("path").alias("joined"), F.lit(0).cast("long").alias("position"), *(F.lit(False).alias(c) for c in ("reversed", "skip_first", "skip_last"))))


def roads_of(ways: DataFrame, box: tuple[float, float, float, float], size: int, pixel: float, members: DataFrame | None = None, apart: Column | None = None, tolerance: float = 0.01, join_tolerance: float = 1.0) -> DataFrame:
    """(path, structure, xs, ys): ways (way, ord, lons, lats, nodes, highway, junction, oneway and what ``apart`` reads) as joined roads on a terrain.

    Ways are cut at the border, relations (relation, relation_order,
    member_order, way, role) assembled, and lines joined end to end; ways for
    which ``apart`` holds, such as bridges, stay as they are.  A road is named
    after the earliest way in it.
    """
    lines = terrain_lines(ways, box, size, pixel, tolerance).withColumn("path", F.col("way"))
    apart = F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))
    kept = lines.withColumn("_apart", apart).select("path", "ord", "way", "start_node", "end_node", "xs", "ys", "highway", "junction", "oneway", "_apart")
    kept = cut(kept)  # read by every step below
    alone, rest = kept.filter("_apart").select("path", F.lit(True).alias("structure"), "xs", "ys"), kept.filter("NOT _apart").drop("_apart")
    if members is not None:
        rest = cut(assembled_by_relations(rest, members))
    parts = cut(connected(rest, join_tolerance, members))
    whole = put_together(rest, parts).select(F.col("joined").alias("path"), F.lit(False).alias("structure"), "xs", "ys")
    return alone.union(whole)


def road_splines(ways: DataFrame, box: tuple[float, float, float, float], size: int, pixel: float, interval: float, smooth: bool = True, least: float = 1.0, **rules) -> DataFrame:
    """Samples along the curves of ``roads_of``; roads shorter than ``least`` have none."""
    return spline_samples(roads_of(ways, box, size, pixel, **rules), interval, smooth, least=least)
