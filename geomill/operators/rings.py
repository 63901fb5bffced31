"""Roundabouts: rings of ways, the roads that meet them, and roads trimmed where they run along a ring.

Ways are rows (way, ord, lons, lats, nodes, highway, junction, oneway); ``ord``
is an array by which earlier ways come first.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.operators.graph import connected_components, each_group
from geomill.operators.series import OTHER_PRIORITY, ROAD_PRIORITY, lookup
from geomill.operators.spatial import DEGREE_METRES
from geomill.operators.splines import clip_to_square, flat, spline_samples, without_repeats
from geomill.session import cut

#: Places closer than this on both axes are one, in degrees.
SAME_PLACE = 1e-6
#: Fixed value: metres in a degree of latitude, as rings are measured.
RING_DEGREE = 110_574.0
#: Road classes that may be stubs at a ring, that are no road a stub belongs to, and that count as any other class there.
STUBS = ("cycleway", "footway", "path")
NO_PARENTS = (*STUBS, "steps", "bridleway", "pedestrian")
UNRANKED = ("busway", "raceway", "proposed")
#: Longest stub, in metres.
STUB_LENGTH = 100.0
#: Side of the grid cells over which rings are spread, in degrees.
RING_CELL = 0.001


def is_ring(junction: str = "junction") -> Column:
    return F.coalesce(F.lower(junction) == "roundabout", F.lit(False))


def _groups(ways: DataFrame) -> DataFrame:
    """(way, group): ring ways linked through ends at one place; each grid cell links its ways to the smallest, neighbouring cells compare their places."""
    end = lambda i: F.struct(F.element_at("lons", i).alias("x"), F.element_at("lats", i).alias("y"))
    tips = ways.filter(F.size("lons") >= 2).select("way", F.explode(F.array(end(1), end(-1))).alias("t")).select("way", "t.*").distinct()
    square = lambda c: F.floor(F.col(c) / SAME_PLACE).cast("long")
    places = tips.groupBy("x", "y").agg(F.min("way").alias("way")).withColumn("cx", square("x")).withColumn("cy", square("y"))
    same = tips.join(places.select("x", "y", F.col("way").alias("head")), ["x", "y"]).select(F.col("way").alias("a"), F.col("head").alias("b"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = places.select(F.explode(F.transform(near, lambda d: F.col("cx") + d)).alias("cx"), "cy", F.col("way").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    around = around.withColumn("cy", F.explode(F.transform(near, lambda d: F.col("cy") + d)))
    beside = around.join(places, ["cx", "cy"]).filter((F.abs(F.col("ax") - F.col("x")) < SAME_PLACE) & (F.abs(F.col("ay") - F.col("y")) < SAME_PLACE)).select("a", F.col("way").alias("b"))
    parts = connected_components(same.union(beside))
    return ways.join(parts, F.col("way") == F.col("node"), "left").withColumn("group", F.coalesce("component", "way")).drop("node", "component")


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    return bool((np.abs(a - b) < SAME_PLACE).all())


class _Ends:
    """Both ends of lines by grid cells of ``SAME_PLACE``; a cell lists its lines, the first one last."""

    def __init__(self, lines: list[np.ndarray]):
        self.tips = [[tuple(p[0].tolist()), tuple(p[-1].tolist())] if len(p) > 1 else [] for p in lines]
        self.gone, self.cells = [False] * len(lines), {}
        for i in range(len(lines) - 1, -1, -1):
            for c in {_cell(t) for t in self.tips[i] if math.isfinite(t[0]) and math.isfinite(t[1])}:
                self.cells.setdefault(c, []).append(i)

    def near(self, place: tuple) -> Iterator[Iterator[int]]:
        """Of each cell about ``place`` the lines not gone with an end there, the first one first."""
        if not (math.isfinite(place[0]) and math.isfinite(place[1])):
            return
        x, y = _cell(place)
        for c in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            own = self.cells.get(c)
            while own and self.gone[own[-1]]:
                own.pop()
            if own:
                yield (i for i in reversed(own) if not self.gone[i] and any(_meet(place, t) for t in self.tips[i]))


def _cell(p: tuple) -> tuple[int, int]:
    return math.floor(p[0] / SAME_PLACE), math.floor(p[1] / SAME_PLACE)


def _meet(a: tuple, b: tuple) -> bool:
    return abs(a[0] - b[0]) < SAME_PLACE and abs(a[1] - b[1]) < SAME_PLACE


def ring_order(lines: list[np.ndarray]) -> list[int]:
    """The order in which ways join the group of the first: pass by pass those that meet a way already in it.

    A way that is met by one before it joins in the same pass, else in the
    next, so a heap of passes and places gives the order without the passes.
    """
    ends, order, heap = _Ends(lines), [], [(0, 0)]
    ends.gone[0] = True
    while heap:
        turn, i = heapq.heappop(heap)
        order.append(i)
        for j in [j for tip in ends.tips[i] for own in ends.near(tip) for j in own]:
            if not ends.gone[j]:
                ends.gone[j] = True
                heapq.heappush(heap, (turn + (j < i), j))
    return order


def assemble_ring(lines: list[np.ndarray]) -> np.ndarray:
    """The first line, extended at either end by the first unused one that fits there, closed."""
    pieces = deque([lines[0]])
    if len(lines) > 1:
        ends, head, tail = _Ends(lines), tuple(lines[0][0].tolist()), tuple(lines[0][-1].tolist())
        ends.gone[0] = True
        while (i := min((j for p in (head, tail) for own in ends.near(p) if (j := next(own, None)) is not None), default=None)) is not None:
            ends.gone[i] = True
            p, (start, end) = lines[i], ends.tips[i]
            if _meet(tail, start):
                pieces.append(p[1:])
                tail = end
            elif _meet(tail, end):
                pieces.append(p[::-1][1:])
                tail = start
            elif _meet(head, end):
                pieces.appendleft(p[:-1])
                head = start
            else:
                pieces.appendleft(p[::-1][:-1])
                head = end
    ring = np.concatenate(pieces)
    if len(ring) >= 3 and not _same(ring[0], ring[-1]):
        ring = np.concatenate([ring, ring[:1]])
    return ring


def rings(ways: DataFrame) -> DataFrame:
    """(ring, ord, ways, lons, lats, lon, lat, radius): a closed ring of each group of roundabout ways that meet at their ends.

    It is named after its way of most points, the first of equal ones; (lon,
    lat) is the mean of its points and radius their mean distance in metres.
    Rings of less than three points go.
    """
    own = _groups(cut(ways.filter(is_ring()).select("way", "ord", "lons", "lats")))

    def run(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r["ord"], r["way"]))
        lines = [np.column_stack([r["lons"], r["lats"]]) for r in rows]
        order = ring_order(lines)
        rows, lines = [rows[i] for i in order], [lines[i] for i in order]
        ring = assemble_ring(lines)
        if len(ring) < 3:
            return []
        inner = ring[:-1] if _same(ring[0], ring[-1]) else ring
        lon, lat = inner.mean(0)
        away = np.hypot((inner[:, 0] - lon) * DEGREE_METRES * np.cos(np.radians(lat)), (inner[:, 1] - lat) * RING_DEGREE)
        name = max(range(len(rows)), key=lambda i: (len(lines[i]), -i))
        return [(rows[name]["way"], rows[0]["ord"], [r["way"] for r in rows], ring[:, 0].tolist(), ring[:, 1].tolist(), float(lon), float(lat), float(away.mean()))]

    # the ways of one ring meet in a task; what is found is read by every step that follows
    return cut(each_group(own, "group", run, "ring long, ord array<long>, ways array<long>, lons array<double>, lats array<double>, lon double, lat double, radius double"))


def _vertices(ways: DataFrame) -> DataFrame:
    """(way, i, x, y, kx, ky): every vertex of the roads, with its place rounded to ``SAME_PLACE``."""
    roads = ways.filter(~is_ring() & F.col("highway").isNotNull())
    points = roads.select("way", F.posexplode(F.arrays_zip("lons", "lats")).alias("i", "p")).select("way", "i", F.col("p.lons").alias("x"), F.col("p.lats").alias("y"))
    return points.withColumns(_rounded("x", "y"))


def _rounded(x: str, y: str) -> dict[str, Column]:
    return {k: F.rint(F.col(c) / SAME_PLACE).cast("long") for k, c in (("kx", x), ("ky", y))}


def _ring_places(found: DataFrame) -> DataFrame:
    return found.select("ring", F.explode(F.arrays_zip("lons", "lats")).alias("p")).select("ring", F.col("p.lons").alias("x"), F.col("p.lats").alias("y")).withColumns(_rounded("x", "y")).select("ring", "kx", "ky").distinct()


def connections(ways: DataFrame, found: DataFrame) -> DataFrame:
    """(ring, way, ring_index, at, angle, direction): where roads meet the rings ``found``.

    An index from places to rings is joined with the roads' vertices.
    ``ring_index`` is the nearest point of the ring, ``at`` the road's first
    vertex there, ``angle`` in degrees from east about the centre, and
    ``direction`` entry or exit for ends of one-way roads, else both.
    """
    met = _vertices(ways).join(_ring_places(found), ["kx", "ky"]).select("ring", "way", "i", "x", "y")
    met = met.join(found.select("ring", F.arrays_zip("lons", "lats").alias("_p"), "lon", "lat"), "ring")
    away = F.transform("_p", lambda p, i: F.struct(((F.col("x") - p.lons) * (F.col("x") - p.lons) + (F.col("y") - p.lats) * (F.col("y") - p.lats)).alias("d"), i.alias("i")))
    met = met.withColumn("ring_index", F.array_min(away)["i"])
    met = met.withColumn("_q", F.get("_p", F.col("ring_index"))).withColumn("angle", F.degrees(F.atan2(F.col("_q.lats") - F.col("lat"), F.col("_q.lons") - F.col("lon"))))
    first = met.groupBy("ring", "way", "ring_index").agg(F.min(F.struct("i", F.when(F.col("angle") < 0, F.col("angle") + 360).otherwise(F.col("angle")).alias("angle"))).alias("f"))
    tags = ways.select("way", F.lower("oneway").alias("_one"), F.size("lons").alias("_n"))
    out = first.select("ring", "way", "ring_index", F.col("f.i").alias("at"), F.col("f.angle").alias("angle")).join(tags, "way")
    along, against = F.coalesce(F.col("_one").isin("yes", "true", "1"), F.lit(False)), F.coalesce(F.col("_one") == "-1", F.lit(False))
    start, end = F.col("at") == 0, F.col("at") == F.col("_n") - 1
    direction = F.when((along & start) | (against & ~start & end), "exit").when((along & ~start & end) | (against & start), "entry").otherwise("both")
    return out.select("ring", "way", "ring_index", "at", "angle", direction.alias("direction"))


def on_rings(ways: DataFrame, found: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(way, ring, i): vertices of roads at a place of a ring, or within ``tolerance`` metres of its radius about its centre; rings are spread over the grid cells of their box."""
    points = _vertices(ways)
    at = points.join(_ring_places(found), ["kx", "ky"]).select("way", "ring", "i")
    wide = DEGREE_METRES * F.cos(F.radians("lat"))
    reach = F.col("radius") + tolerance
    span = lambda c, metres: F.sequence(F.floor((F.col(c) - reach / metres) / RING_CELL).cast("long"), F.floor((F.col(c) + reach / metres) / RING_CELL).cast("long"))
    spread = found.select("ring", "lon", "lat", "radius", F.explode(span("lon", wide)).alias("cx"), span("lat", F.lit(RING_DEGREE)).alias("_cy")).withColumn("cy", F.explode("_cy")).drop("_cy")
    square = lambda c: F.floor(F.col(c) / RING_CELL).cast("long")
    near = points.withColumn("cx", square("x")).withColumn("cy", square("y")).join(spread, ["cx", "cy"])
    dx, dy = (F.col("x") - F.col("lon")) * wide, (F.col("y") - F.col("lat")) * RING_DEGREE
    near = near.filter(F.abs(F.sqrt(dx * dx + dy * dy) - F.col("radius")) < tolerance)
    return at.union(near.select("way", "ring", "i")).distinct()


def trim(n: int, masks: list[tuple[int, list[int]]]) -> tuple[int, int, list[tuple[int, int]]]:
    """(start, vertices kept, cuts) of a road of ``n`` vertices against rings in turn, each with its vertices on the ring.

    A road that only enters keeps what lies before, one that only leaves what
    lies after; of one that does both the longer side stays, the first of equal
    ones, where leaving at the first vertex is no leaving.  The vertex on the
    ring is kept, and is the cut.  None kept: all lie on one ring.
    """
    start, cuts = 0, []
    for ring, on in masks:
        own = np.zeros(n, bool)
        own[[i - start for i in on if start <= i < start + n]] = True
        if not own.any():
            continue
        if own.all():
            return start, 0, cuts
        turns = np.diff(own.astype(np.int8))
        enters, leaves = np.flatnonzero(turns > 0) + 1, np.flatnonzero(turns < 0)
        before = int(enters[0]) + 1 if len(enters) else 0
        after = n - int(leaves[-1]) if len(leaves) and (leaves[-1] or not len(enters)) else 0
        if before >= after:
            kept, low, cut = before, start, start + before - 1
        else:
            kept, low = after, start + n - after
            cut = low
        if kept < n:
            cuts.append((ring, cut))
        start, n = low, kept
    return start, n, cuts


def trims(ways: DataFrame, found: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(way, start, kept, cuts): what ``trim`` leaves of the roads that touch rings, the rings in their order; ``cuts`` are (ring, vertex)."""
    flags = on_rings(ways, found, tolerance).join(found.select("ring", "ord"), "ring")
    masks = flags.groupBy("way", "ring", "ord").agg(F.sort_array(F.collect_set("i")).alias("on"))
    rows = masks.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("ord", "ring", "on"))).alias("masks")).join(ways.select("way", F.size("lons").alias("n")), "way")

    def run(batches):
        kind = pa.list_(pa.struct([("ring", pa.int64()), ("vertex", pa.int64())]))
        for batch in batches:
            got = [trim(n, [(m["ring"], m["on"]) for m in masks]) for n, masks in zip(batch.column("n").to_pylist(), batch.column("masks").to_pylist())]
            cuts = pa.array([[{"ring": r, "vertex": v} for r, v in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column("way"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), cuts], ["way", "start", "kept", "cuts"])

    return rows.mapInArrow(run, "way long, start long, kept long, cuts array<struct<ring:long,vertex:long>>")


def trimmed(ways: DataFrame, plan: DataFrame) -> DataFrame:
    """``ways`` without the vertices that ``trims`` took, their nodes with them; roads of which nothing is left go."""
    own = ways.join(plan.select("way", "start", "kept"), "way", "left").filter("kept IS NULL OR kept >= 2")
    cut = lambda c: F.when(F.col("kept").isNull() | (F.size(c) == 0), F.col(c)).otherwise(F.slice(c, (F.col("start") + 1).cast("int"), F.col("kept").cast("int")))
    return own.withColumns({c: cut(c) for c in ("lons", "lats", "nodes")}).select(ways.columns)


def _length(ways: DataFrame) -> DataFrame:
    """(way, metres) of lines of longitudes and latitudes."""
    p = F.arrays_zip("lons", "lats")

    def step(a, b):
        wide = DEGREE_METRES * F.cos(F.radians((a.lats + b.lats) / 2))
        return F.sqrt(F.pow((b.lons - a.lons) * wide, 2) + F.pow((b.lats - a.lats) * RING_DEGREE, 2))

    steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size("lons") - 1, F.lit(0))), lambda a, b: F.coalesce(step(a, b), F.lit(0.0)))
    return ways.select("way", F.aggregate(steps, F.lit(0.0), lambda s, d: s + d).alias("metres"))


def stub_parents(ways: DataFrame, found: DataFrame) -> DataFrame:
    """(ring, node, stubs, parent, at_start, lon, lat, ring_node): short paths from a ring to the end of a road, and where that road meets the ring instead.

    Stubs are cycleways, footways and paths of up to ``STUB_LENGTH`` metres of
    which one end alone is a node of the ring; those that leave for the same
    ``node`` are one group.  Its parent is the road of the highest class that
    ends there, the first of equal ones.  One stub gives its own place on the
    ring, several the ring's point nearest to their mean direction.  Groups
    without a parent have no row.
    """
    roads = ways.filter(F.col("highway").isNotNull() & (F.size("nodes") >= 2) & ~is_ring())
    end = lambda tip, i, j: F.struct(F.lit(tip).alias("start"), F.element_at("nodes", i).alias("node"), F.element_at("nodes", j).alias("other"), F.element_at("lons", i).alias("x"), F.element_at("lats", i).alias("y"))
    tips = roads.select("way", "ord", F.lower("highway").alias("kind"), F.explode(F.array(end(True, 1, -1), end(False, -1, 1))).alias("t")).select("way", "ord", "kind", "t.*")
    nodes = found.select("ring", F.explode("ways").alias("way")).join(ways.select("way", F.arrays_zip("nodes", "lons", "lats").alias("p")), "way").select("ring", F.explode("p").alias("p"))
    nodes = nodes.select("ring", F.col("p.nodes").alias("node"), F.col("p.lons").alias("x"), F.col("p.lats").alias("y"))
    short = tips.filter(F.col("kind").isin(*STUBS)).join(_length(roads.filter(F.lower("highway").isin(*STUBS))).filter(F.col("metres") <= STUB_LENGTH), "way")
    touching = short.join(nodes.select("ring", "node").distinct(), "node").groupBy("ring", "way").agg(F.count("*").alias("n"), F.first(F.struct("node", "other", "x", "y")).alias("t")).filter("n = 1")
    centre = found.select("ring", F.col("lon").alias("cx"), F.col("lat").alias("cy"), F.arrays_zip("lons", "lats").alias("_p"))
    stubs = touching.select("ring", "way", F.col("t.node").alias("ring_node"), F.col("t.other").alias("node"), F.col("t.x").alias("x"), F.col("t.y").alias("y")).join(centre.drop("_p"), "ring")
    turn = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    groups = stubs.groupBy("ring", "node").agg(F.sort_array(F.collect_set("way")).alias("stubs"), F.count("*").alias("n"), F.first(F.struct("x", "y", "ring_node")).alias("one"), F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))).alias("mean"))
    rank = F.when(F.col("kind").isin(*UNRANKED), OTHER_PRIORITY).otherwise(lookup(ROAD_PRIORITY, F.col("kind"), OTHER_PRIORITY))
    able = groups.select("ring", "node", "stubs").join(tips.filter(~F.col("kind").isin(*NO_PARENTS)).withColumn("rank", rank), "node").filter(~F.array_contains("stubs", F.col("way")))
    parents = able.groupBy("ring", "node").agg(F.min(F.struct((-F.col("rank")).alias("r"), "ord", (~F.col("start")).alias("e"), "way")).alias("p")).select("ring", "node", F.col("p.way").alias("parent"), (~F.col("p.e")).alias("at_start"))
    met = groups.join(parents, ["ring", "node"]).join(centre, "ring")
    apart = lambda p: F.abs(F.atan2(F.sin(F.atan2(p.lats - F.col("cy"), p.lons - F.col("cx")) - F.col("mean")), F.cos(F.atan2(p.lats - F.col("cy"), p.lons - F.col("cx")) - F.col("mean"))))
    best = F.array_min(F.transform("_p", lambda p, i: F.struct(F.round(apart(p), 12).alias("d"), i.alias("i"))))["i"]
    met = met.withColumn("_b", F.get("_p", best))
    met = met.select("ring", "node", "stubs", "parent", "at_start", F.when(F.col("n") == 1, F.col("one.x")).otherwise(F.col("_b.lons")).alias("lon"), F.when(F.col("n") == 1, F.col("one.y")).otherwise(F.col("_b.lats")).alias("lat"), F.when(F.col("n") == 1, F.col("one.ring_node")).alias("_own"))
    at = nodes.withColumns(_rounded("x", "y")).groupBy("ring", "kx", "ky").agg(F.min("node").alias("_there"))
    placed = met.withColumns(_rounded("lon", "lat")).join(at, ["ring", "kx", "ky"], "left")
    return placed.select("ring", "node", "stubs", "parent", "at_start", "lon", "lat", F.coalesce("_own", "_there", F.lit(-1)).alias("ring_node"))


def without_stubs(ways: DataFrame, plan: DataFrame) -> DataFrame:
    """``ways`` without the stubs of ``stub_parents`` and with their parents led on to the ring; several extensions of one end follow each other by ring and node."""
    gone = plan.select(F.explode("stubs").alias("way")).distinct()
    more = plan.groupBy(F.col("parent").alias("way"), "at_start").agg(F.array_sort(F.collect_list(F.struct("ring", "node", "lon", "lat", "ring_node"))).alias("p"))
    side = lambda start: more.filter("at_start" if start else "NOT at_start").select("way", F.col("p").alias("_head" if start else "_tail"))
    own = ways.join(gone, "way", "left_anti").join(side(True), "way", "left").join(side(False), "way", "left")

    def grown(column: str, field: str) -> Column:
        part = lambda c: F.coalesce(F.transform(c, lambda q: q[field]), F.array().cast(ways.schema[column].dataType))
        return F.concat(F.reverse(part("_head")), F.col(column), part("_tail"))

    keep = (F.col("_head").isNull() & F.col("_tail").isNull())
    return own.withColumns({c: F.when(keep, F.col(c)).otherwise(grown(c, f)) for c, f in (("lons", "lon"), ("lats", "lat"), ("nodes", "ring_node"))}).select(ways.columns)


def ring_lines(found: DataFrame, box: tuple[float, float, float, float], size: int, pixel: float) -> DataFrame:
    """(ring, xs, ys): rings in metres on a square terrain, cut at its border, closed within a decimetre and without repeated points; those of less than four points go."""
    wide, high = box[2] - box[0], box[3] - box[1]

    def run(batches):
        for batch in batches:
            lon, lat, first = flat(batch, "lons", "lats")
            rows, lines = [], []
            for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(lon)])):
                if b - a < 4:
                    continue
                x, y, _, _ = clip_to_square((lon[a:b] - box[0]) / wide * size, (lat[a:b] - box[1]) / high * size, size)
                if len(x) < 4:
                    continue
                x, y = x * pixel, y * pixel
                if np.hypot(x[0] - x[-1], y[0] - y[-1]) > 0.1:
                    x, y = np.append(x, x[0]), np.append(y, y[0])
                keep = without_repeats(x, y, 0.01)
                if keep.sum() >= 4:
                    rows.append(i)
                    lines.append((x[keep], y[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("ring").take(pa.array(rows, pa.int64())), *(pa.array([p[k] for p in lines], pa.list_(pa.float64())) for k in (0, 1))], ["ring", "xs", "ys"])

    return found.select("ring", "lons", "lats").mapInArrow(run, "ring long, xs array<double>, ys array<double>")


def ring_splines(found: DataFrame, box: tuple[float, float, float, float], size: int, pixel: float, interval: float) -> DataFrame:
    """Samples along smooth curves through ``ring_lines``."""
    return spline_samples(ring_lines(found, box, size, pixel), interval, True, least=0.0, key="ring")
