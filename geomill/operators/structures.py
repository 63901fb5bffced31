"""Cross-sections of roads, bridges and tunnels between them, crossings, rings and broken curves."""

from __future__ import annotations

import math
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.operators import spatial
from geomill.operators.graph import connected_components, solved, whole_groups
from geomill.operators.paths import ends_of
from geomill.operators.raster import line_pixels
from geomill.operators.series import blend
from geomill.session import cut


def numbered(rows: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before them in ``order``.

    A prefix scan: sums of range partitions, one number each, then sums inside
    each partition, so no task sees all rows.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    whole = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = whole.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + inside).drop("_part", "_base")  # before: one row a partition


def cross_sections(samples: DataFrame, spline: str, order: str, x: str, y: str, priority: str) -> DataFrame:
    """Samples along splines with ``local_index``, ``section_index``, ``is_start``, ``is_end``, ``nx`` and ``ny``.

    Sections are numbered spline by spline, the highest priority first, ties by
    spline.  The normal is the left-hand one of the chord between a sample's
    neighbours; from five sections on it is averaged over two to each side.
    """
    w = W.partitionBy(spline).orderBy(order)
    local = samples.withColumn("local_index", F.row_number().over(w).cast("long") - 1).withColumn("_n", F.count("*").over(W.partitionBy(spline)))
    splines = local.groupBy(spline).agg(F.max(priority).alias("_p"), F.count("*").alias("_size"))
    first = numbered(splines, [F.desc("_p"), F.asc(spline)], "_size", "_first").select(spline, "_first")
    dx = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    dy = F.coalesce(F.lead(y).over(w), F.col(y)) - F.coalesce(F.lag(y).over(w), F.col(y))
    unit = lambda a, b, v: F.when(F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b)) > 0, v / F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))).otherwise(F.lit(0.0))
    turned = local.withColumn("_dx", dx).withColumn("_dy", dy)
    turned = turned.withColumn("_ux", unit("_dx", "_dy", -F.col("_dy"))).withColumn("_uy", unit("_dx", "_dy", F.col("_dx")))
    about = w.rowsBetween(-2, 2)
    mean = turned.withColumn("_mx", F.when(F.col("_n") >= 5, F.sum("_ux").over(about)).otherwise(F.col("_ux"))).withColumn("_my", F.when(F.col("_n") >= 5, F.sum("_uy").over(about)).otherwise(F.col("_uy")))
    out = mean.withColumn("nx", unit("_mx", "_my", F.col("_mx"))).withColumn("ny", unit("_mx", "_my", F.col("_my")))
    out = out.withColumn("is_start", F.col("local_index") == 0).withColumn("is_end", F.col("local_index") == F.col("_n") - 1)
    return out.join(first, spline).withColumn("section_index", F.col("_first") + F.col("local_index")).drop("_n", "_first", "_dx", "_dy", "_ux", "_uy", "_mx", "_my")


def profile(entry: str, exit_: str, lowest: str, tunnel: str) -> tuple[Column, Column, Column]:
    """(lowest, highest, depth change) of a structure: straight, or for tunnels a curve down to ``lowest``."""
    curved = F.col(tunnel) & F.col(lowest).isNotNull()
    low = F.when(curved, F.col(lowest)).otherwise(F.least(entry, exit_))
    high = F.greatest(entry, exit_)
    return low, high, F.when(curved, high - low).otherwise(F.lit(0.0))


def profile_at(t: str, entry: str, exit_: str, lowest: str, tunnel: str) -> Column:
    """Elevation at the share ``t`` of a structure: straight, or eased down to the middle and up again for tunnels with a lowest point."""
    straight = F.col(entry) + (F.col(exit_) - F.col(entry)) * F.col(t)
    down, up = F.col(t) * 2, F.col(t) * 2 - 1
    ease = lambda s: s * s * (3 - 2 * s)
    curve = F.when(F.col(t) < 0.5, F.col(entry) + (F.col(lowest) - F.col(entry)) * ease(down)).otherwise(F.col(lowest) + (F.col(exit_) - F.col(lowest)) * ease(up))
    return F.when(F.col(tunnel) & F.col(lowest).isNotNull(), curve).otherwise(straight)


def structure_ends(sections: DataFrame, structures: str, target: str, ground: str, tolerance: float) -> DataFrame:
    """(spline, entry, exit) of the splines where ``structures`` holds.

    Each end takes the target of the nearest section of a road within
    ``tolerance``, ties to the first spline, there to its start, its end and its
    first section; without one, the ground at that end.  ``sections`` has
    spline, local_index, is_start, is_end, x and y.
    """
    own = sections.filter(structures).filter("is_start OR is_end")
    tips = own.select("spline", F.explode(F.expr("filter(array(IF(is_start, 's', NULL), IF(is_end, 'e', NULL)), v -> v IS NOT NULL)")).alias("tip"), "x", "y", F.col(ground).alias("_ground"))
    place = F.when(F.col("is_start"), 0).when(F.col("is_end"), 1).otherwise(2)
    roads = sections.filter(f"NOT ({structures})").filter(F.col(target).isNotNull() & ~F.isnan(target))
    roads = roads.select(F.col("x").alias("_rx"), F.col("y").alias("_ry"), F.col(target).alias("_target"), F.struct(F.col("spline").alias("s"), place.alias("p"), F.col("local_index").alias("i")).alias("_tie"))
    near = spatial.nearest(tips, roads, tolerance, ("x", "y"), ("_rx", "_ry"), ["spline", "tip"], "_tie").select("spline", "tip", "_target")
    met = tips.join(near, ["spline", "tip"], "left").withColumn("_v", F.coalesce("_target", "_ground"))
    pick = lambda tip: F.max(F.when(F.col("tip") == tip, F.col("_v")))
    return met.groupBy("spline").agg(pick("s").alias("entry"), pick("e").alias("exit"))


def integrate_structures(sections: DataFrame, structures: str, tunnel: str, along: str, target: str, ground: str, tolerance: float, cover: float = 5.0) -> DataFrame:
    """``sections`` with ``elevation``: the target, or on structures their profile between the roads they join.

    A tunnel goes down to ``cover`` below the lowest ground along it where that
    is below both its ends.
    """
    ends = structure_ends(sections, structures, target, ground, tolerance)
    lengths = sections.filter(structures).groupBy("spline").agg(F.max(along).alias("_length"), (F.min(ground) - cover).alias("_low"))
    known = ends.join(lengths, "spline").withColumn("_low", F.when(F.col("_low") < F.least("entry", "exit"), F.col("_low")))
    met = sections.join(known, "spline", "left").withColumn("_t", F.coalesce(F.col(along) / F.nullif(F.col("_length"), F.lit(0)), F.lit(0.0)))
    value = F.when(F.col("entry").isNotNull(), profile_at("_t", "entry", "exit", "_low", tunnel)).otherwise(F.col(target))
    return met.withColumn("elevation", value).drop("entry", "exit", "_length", "_low", "_t")


def first_apart(places: DataFrame, key: str, x: str, y: str, radius: float, once: str | None = None) -> DataFrame:
    """The rows that a scan in the order of ``key`` (unique) keeps when it skips those nearer than ``radius`` to a kept one, or of the same ``once`` as one.

    Rows that hang together through neighbouring cells, radius / sqrt(2) wide,
    and through ``once`` are scanned in one task.
    """
    size = radius / 2**0.5
    rows = cut(places.withColumn("_cx", spatial.cell(x, size)).withColumn("_cy", spatial.cell(y, size)).withColumn("_cell", F.xxhash64("_cx", "_cy")))
    cells = rows.select("_cx", "_cy", "_cell").distinct()
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if abs(i * j) < 4 and (i, j) > (0, 0)]))
    about = cells.select(F.col("_cell").alias("a"), step.alias("d"), "_cx", "_cy").select("a", (F.col("_cx") + F.col("d.i")).alias("_cx"), (F.col("_cy") + F.col("d.j")).alias("_cy"))
    links = about.join(cells, ["_cx", "_cy"]).select("a", F.col("_cell").alias("b"))
    if once:
        least = rows.groupBy(once).agg(F.min("_cell").alias("_least"))
        links = links.union(rows.join(least, once).select("_cell", "_least"))

    def scan(t: pa.Table) -> pa.Table:
        keys = [tuple(k.values()) if isinstance(k, dict) else k for k in t.column(key).to_pylist()]
        names = t.column(once).to_pylist() if once else range(t.num_rows)
        names = [tuple(n.values()) if isinstance(n, dict) else n for n in names]
        xs, ys, cx, cy = (t.column(c).to_pylist() for c in (x, y, "_cx", "_cy"))
        kept, seen, at = [], set(), {}
        for i in sorted(range(t.num_rows), key=keys.__getitem__):
            if names[i] in seen or any(math.hypot(xs[i] - xs[j], ys[i] - ys[j]) < radius for p in range(-2, 3) for q in range(-2, 3) for j in at.get((cx[i] + p, cy[i] + q), ())):
                continue
            kept.append(i)
            seen.add(names[i])
            at.setdefault((cx[i], cy[i]), []).append(i)
        return t.take(pa.array(kept, pa.int64()))

    return solved(rows, "_cell", links, scan, lambda large: _apart_rounds(large, key, x, y, radius, once)).select(places.columns)


def _apart_rounds(places: DataFrame, key: str, x: str, y: str, radius: float, once: str | None) -> DataFrame:
    """``first_apart`` in rounds: each keeps every cell's earliest row that comes before the earliest of all cells about it and of its ``once``, then drops the rows that those suppress."""
    live, kept, steps = cut(places), [], F.array(*[F.lit(d) for d in range(-2, 3)])
    around = lambda df: df.withColumn("_cx", F.explode(F.transform(steps, lambda d: F.col("_hx") + d))).withColumn("_cy", F.explode(F.transform(steps, lambda d: F.col("_hy") + d)))
    while not live.isEmpty():
        heads = live.groupBy("_cx", "_cy").agg(F.min(key).alias("_head"))
        least = around(heads.select("_head", F.col("_cx").alias("_hx"), F.col("_cy").alias("_hy"))).groupBy("_cx", "_cy").agg(F.min("_head").alias("_least"))
        chosen = live.join(heads.join(least, ["_cx", "_cy"]).filter("_head = _least").select(F.col("_head").alias(key)), key)
        if once:
            chosen = chosen.join(live.groupBy(once).agg(F.min(key).alias("_first")), once).filter(F.col(key) == F.col("_first")).drop("_first")
        chosen = cut(chosen.select(places.columns))
        kept.append(chosen)
        by = around(chosen.select(F.col(key).alias("_k"), F.col(x).alias("_kx"), F.col(y).alias("_ky"), F.col("_cx").alias("_hx"), F.col("_cy").alias("_hy")))
        near = F.sqrt(F.pow(F.col(x) - F.col("_kx"), 2) + F.pow(F.col(y) - F.col("_ky"), 2)) < radius
        gone = live.join(by.select("_cx", "_cy", "_k", "_kx", "_ky"), ["_cx", "_cy"]).filter((F.col(key) == F.col("_k")) | near).select(key).distinct()
        live = live.join(gone, key, "left_anti")
        live = cut(live.join(chosen.select(once).distinct(), once, "left_anti") if once else live)
    return reduce(DataFrame.union, kept)


#: Samples of a road that are searched for crossings, at least half of them, and the grid by which near roads are ordered.
CROSSING_SAMPLES, CROSSING_CELL = 100, 50.0


def mid_crossings(samples: DataFrame, radius: float, connected: DataFrame | None = None) -> DataFrame:
    """(a, b, x, y): where two roads (road, place, x, y) come within ``radius`` of each other, away from their ends.

    Roads are scanned in order, each one's samples, but for the first and the
    last, in order, only every n-th of 100 n or more.  A sample's crossings lie
    halfway to the nearest sample of every road near it, in the order in which
    a grid meets those roads.  Each pair crosses once, where the scan first
    finds a place that is not within half the radius of an earlier crossing;
    pairs of ``connected`` (a, b) never do.
    """
    w = W.partitionBy("road")
    inner = samples.withColumn("_i", F.row_number().over(w.orderBy("place")) - 2).withColumn("_n", F.count("*").over(w) - 2).filter("_i >= 0 AND _i < _n")
    square = lambda c: spatial.cell(c, CROSSING_CELL, floor=False)
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / CROSSING_SAMPLES))
    own = inner.filter(F.col("_i") % every == 0).select("road", "place", F.col("x").alias("ax"), F.col("y").alias("ay"))
    other = inner.select(F.col("road").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), F.struct(square("x").alias("cx"), square("y").alias("cy"), F.col("road").alias("r"), F.col("place").alias("p")).alias("met"))
    near = spatial.within(own, other, radius, ("ax", "ay"), ("bx", "by")).filter("road <> other").withColumn("a", F.least("road", "other")).withColumn("b", F.greatest("road", "other"))
    if connected is not None:
        near = near.join(connected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    found = near.groupBy("road", "place", "other", "a", "b", "ax", "ay").agg(F.min("met").alias("met"), F.min_by(F.struct("bx", "by"), F.struct("distance", "met")).alias("n"))
    places = found.select(F.struct("road", "place", F.col("met.cx").alias("cx"), F.col("met.cy").alias("cy"), "other").alias("order"), F.struct("a", "b").alias("pair"), ((F.col("ax") + F.col("n.bx")) / 2).alias("x"), ((F.col("ay") + F.col("n.by")) / 2).alias("y"))
    return first_apart(places, "order", "x", "y", radius / 2, once="pair").select("pair.a", "pair.b", "x", "y")


def nearest_along(points: DataFrame, samples: DataFrame, key: str, line: str) -> DataFrame:
    """(key, line, along, distance): each point's nearest sample (line, along, sx, sy) of its own line, ties to the first along it."""
    away = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    both = points.join(samples, line).withColumn("distance", away)
    return both.groupBy(key, line).agg(F.min_by(F.struct("along", "distance"), F.struct("distance", "along")).alias("n")).select(key, line, "n.*")


def ring_junctions(sections: DataFrame, rings: DataFrame, radius: float) -> DataFrame:
    """(ring, road, tip, along, distance): each end of a road (road, tip, x, y) within ``radius`` of a ring's samples (ring, along, sx, sy), with the nearest one."""
    near = spatial.within(sections, rings, radius, ("x", "y"), ("sx", "sy"))
    return near.groupBy("ring", "road", "tip").agg(F.min_by(F.struct("along", "distance"), F.struct("distance", "along")).alias("n")).select("ring", "road", "tip", "n.*")


def blended_from_ring(value: str, level: str, distance: str, reach: float, kind: str = "cosine") -> tuple[Column, Column]:
    """(elevation, whether it was changed here and later spreading skips it): the ring's level at distance 0, eased to the road's own over ``reach``."""
    t = blend(F.col(distance) / reach, kind)
    near = F.col(level).isNotNull() & (F.col(distance) < reach)
    return F.when(near, F.col(level) * (1 - t) + F.col(value) * t).otherwise(F.col(value)), F.coalesce(near, F.lit(False))


def edge_constraints(sections: DataFrame, junctions: DataFrame, slack: float = 20.0, kind: str = "cosine", span: int = 3) -> DataFrame:
    """``sections`` with ``level``, ``left_edge`` and ``right_edge``: roads that end at another one lie on its surface there.

    ``sections`` are (spline, along, x, y, nx, ny, tx, ty, target, bank,
    width), ``junctions`` (junction, road, at_start, primary, reach), the
    junctions in their order.  A section nearer than ``reach`` along its road
    to the end takes the surface of the primary road's section nearest to it,
    at most ``reach`` and ``slack`` away: that one's target, by its bank across
    and its slope along, over ``span`` sections to either side.  The end itself
    takes it whole, its middle as the mean of its edges; the others blend it
    with their own edges and middle.  Later junctions blend with what earlier
    ones left; edges that no junction sets are null.
    """
    w = W.partitionBy("spline").orderBy("along")
    whole = W.partitionBy("spline").orderBy("along").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = lambda c, step: F.coalesce(F.lag(c, span).over(w), F.first(c).over(whole)) if step < 0 else F.coalesce(F.lead(c, span).over(w), F.last(c).over(whole))
    run = F.sqrt(F.pow(at("x", 1) - at("x", -1), 2) + F.pow(at("y", 1) - at("y", -1), 2))
    surface = sections.withColumn("slope", F.when(run >= 0.1, (at("target", 1) - at("target", -1)) / run).otherwise(0.0))
    surface = surface.select(F.col("spline").alias("primary"), F.col("along").alias("p_along"), F.col("x").alias("px"), F.col("y").alias("py"), F.struct("x", "y", "nx", "ny", "tx", "ty", "target", "bank", "slope").alias("p"))
    ends = sections.groupBy("spline").agg(F.max("along").alias("_length"), F.min("along").alias("_zero")).withColumnRenamed("spline", "road")
    met = junctions.join(ends, "road")
    own = sections.select("spline", "along", "x", "y", "nx", "ny", "target", "bank", "width").join(met.withColumnRenamed("road", "spline"), "spline")
    own = own.withColumn("_from", F.when(F.col("at_start"), F.col("along") - F.col("_zero")).otherwise(F.col("_length") - F.col("along")))
    own = own.filter((F.col("_from") < F.col("reach")) | (F.col("_from") == 0))
    most = junctions.agg(F.max("reach")).first()[0]
    if most is None:
        none = F.lit(None).cast("double")
        return sections.withColumn("level", F.col("target")).withColumn("left_edge", none).withColumn("right_edge", none)
    # of all sections only those of primary roads are copied to the cells about them
    there = surface.join(junctions.select("primary").distinct(), "primary", "left_semi")
    near = spatial.within(there, own, float(most) + slack, ("px", "py"), ("x", "y"), same=("primary",)).filter(F.col("distance") <= F.col("reach") + slack)
    chosen = near.groupBy("junction", "spline", "along").agg(F.min_by(F.struct("p", "reach", "_from", "x", "y", "nx", "ny", "width"), F.struct("distance", "p_along")).alias("n")).select("junction", "spline", "along", "n.*")

    def on_surface(x, y):
        dx, dy = x - F.col("p.x"), y - F.col("p.y")
        across, ahead = dx * F.col("p.nx") + dy * F.col("p.ny"), dx * F.col("p.tx") + dy * F.col("p.ty")
        return F.col("p.target") + F.when(F.abs("p.bank") > 0.0001, across * F.sin("p.bank")).otherwise(0.0) + F.when(F.abs("p.slope") > 0.0001, ahead * F.col("p.slope")).otherwise(0.0)

    half = F.col("width") / 2
    weight = F.when(F.col("_from") == 0, 1.0).otherwise(1 - blend(F.col("_from") / F.col("reach"), kind))
    force = chosen.withColumn("_w", weight).filter(F.col("_w") > 0.001).select("spline", "along", F.struct("junction", F.col("_w").alias("w"), (F.col("_from") == 0).alias("end"), on_surface(F.col("x") - F.col("nx") * half, F.col("y") - F.col("ny") * half).alias("l"), on_surface(F.col("x") + F.col("nx") * half, F.col("y") + F.col("ny") * half).alias("r"), on_surface(F.col("x"), F.col("y")).alias("m")).alias("f"))
    forces = force.groupBy("spline", "along").agg(F.array_sort(F.collect_list("f")).alias("_forces"))
    lift = F.col("width") / 2 * F.sin("bank")
    start = F.struct(F.col("target").cast("double").alias("m"), F.lit(None).cast("double").alias("l"), F.lit(None).cast("double").alias("r"))

    def apply(state, f):
        mix = lambda there, own: F.when(own.isNull() | f["end"], there).otherwise(there * f["w"] + own * (1 - f["w"]))
        middle = F.when(f["end"], (f["l"] + f["r"]) / 2).otherwise(mix(f["m"], state["m"]))
        return F.struct(middle.alias("m"), mix(f["l"], state["m"] - lift).alias("l"), mix(f["r"], state["m"] + lift).alias("r"))

    done = sections.join(forces, ["spline", "along"], "left").withColumn("_s", F.when(F.col("_forces").isNotNull(), F.aggregate("_forces", start, apply)))
    return done.withColumn("level", F.coalesce("_s.m", "target")).withColumn("left_edge", F.col("_s.l")).withColumn("right_edge", F.col("_s.r")).drop("_forces", "_s")


def banking_roles(members: DataFrame, junction: str, road: str, priority: str, material: str) -> DataFrame:
    """(junction, road, role, leader): how a road is banked near a junction.

    ``fade`` where only one road meets.  Of several, those of the highest
    priority ``keep`` their banking if there is one of them or all are of one
    material, and then every road does if there are several; otherwise they
    ``suppress`` it.  Others ``adapt`` to the smallest of the highest
    (``leader``).
    """
    own = members.groupBy(junction, road).agg(F.max(priority).alias("_p"), F.min(material).alias("_m"))
    top = own.groupBy(junction).agg(F.count("*").alias("_n"), F.max("_p").alias("_top"))
    met = own.join(top, junction).withColumn("_is", F.col("_p") == F.col("_top"))
    led = met.filter("_is").groupBy(junction).agg(F.count("*").alias("_k"), F.min(road).alias("_leader"), F.min("_m").alias("_m1"), F.max("_m").alias("_m2"))
    tie = F.col("_k") > 1
    role = F.when(F.col("_n") == 1, "fade").when(tie & (F.col("_m1") == F.col("_m2")), "keep").when(F.col("_is") & tie, "suppress").when(F.col("_is"), "keep").otherwise("adapt")
    return met.join(led, junction).withColumn("role", role).select(junction, road, "role", F.when(F.col("role") == "adapt", F.col("_leader")).alias("leader"))


def role_histogram(roles: DataFrame) -> DataFrame:
    """(role, n): roads and junctions by their role."""
    return roles.groupBy("role").agg(F.count("*").alias("n"))


def merged_curves(curves: DataFrame, curve: str, line: str, gap: float, most_degrees: float, mask: DataFrame) -> DataFrame:
    """(a, a_tip, b, b_tip): ends of curves that continue each other.

    Ends at most ``gap`` apart, whose lines go on within ``most_degrees``, with
    every pixel between them in ``mask`` (x, y).  Ends join once, the first
    pairs in the order of the curves before later ones.  The ends that hang
    together through near places are matched in one task.
    """
    ends = ends_of(curves, curve, line).filter("dx <> 0 OR dy <> 0").withColumn("_place", F.xxhash64("x", "y"))
    # only places meet each other, whatever the number of ends there
    places = cut(ends.groupBy("_place").agg(F.first("x").alias("x"), F.first("y").alias("y")))
    side = lambda p: places.select(F.col("_place").alias(p), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    near = spatial.within(side("a"), side("b"), gap, ("a_x", "a_y"), ("b_x", "b_y"))
    cells = near.select("a", "b", *[F.floor(c).cast("long").alias(c) for c in ("a_x", "a_y", "b_x", "b_y")])
    steps = cells.select("a", "b", F.explode(line_pixels("a_x", "a_y", "b_x", "b_y")).alias("p"))
    inside = steps.select("a", "b", "p.*").join(mask.select("x", "y").distinct().withColumn("_in", F.lit(1)), ["x", "y"], "left")
    good = cut(inside.groupBy("a", "b").agg(F.count("*").alias("_n"), F.count("_in").alias("_ok")).filter("_n = _ok").select("a", "b"))
    parts = connected_components(good)
    beside = good.groupBy(F.col("a").alias("_place")).agg(F.collect_list("b").alias("near"))
    rows = ends.join(beside, "_place", "left").join(parts, F.col("_place") == F.col("node"), "left").withColumn("_component", F.coalesce("component", "_place"))
    rows = rows.select("_component", "path", "tip", "dx", "dy", F.col("_place").alias("place"), "near")
    return whole_groups(rows, "_component", lambda t: _first_matches(t, most_degrees), "a long, a_tip string, b long, b_tip string")


#: Directions by which the ends at a place are listed.
SECTORS = 16


def _first_matches(t: pa.Table, most_degrees: float) -> pa.Table:
    """The pairs of ends that a scan in the order of their curves joins; each end asks the lists of the places and directions about it for the first free end, so pairs are never listed."""
    path, tip, dx, dy, place = (t.column(c).to_pylist() for c in ("path", "tip", "dx", "dy", "place"))
    # after a scan by (a, b) the tip "s" comes before "e"
    order = sorted(range(t.num_rows), key=lambda i: (path[i], tip[i] != "s"))
    first = {place[i]: i for i in order}
    near = {p: own or () for p, own in zip(first, t.column("near").take(pa.array(list(first.values()), pa.int64())).to_pylist())}
    wide = 2 * math.pi / SECTORS
    turn = [math.atan2(y, x) for x, y in zip(dx, dy)]
    lists: dict = {}
    for i in reversed(order):  # the first is last
        lists.setdefault((place[i], math.floor(turn[i] / wide) % SECTORS), []).append(i)
    used = [False] * t.num_rows

    def best(i: int) -> int | None:
        low = turn[i] + math.pi - math.radians(most_degrees)
        sectors = range(math.floor(low / wide - 1e-6), math.floor((low + 2 * math.radians(most_degrees)) / wide + 1e-6) + 1)
        sectors = {s % SECTORS for s in sectors}
        found = None
        for p in near[place[i]]:
            for s in sectors:
                own = lists.get((p, s))
                while own and (used[own[-1]] or path[own[-1]] <= path[i]):
                    own.pop()
                for j in reversed(own or ()):
                    if found is not None and (path[j], tip[j] != "s") >= (path[found], tip[found] != "s"):
                        break
                    straight = -(dx[i] * dx[j] + dy[i] * dy[j])
                    if not used[j] and math.degrees(math.acos(max(-1.0, min(1.0, straight)))) <= most_degrees:
                        found = j
                        break
        return found

    out = []
    for _, own in groupby(order, path.__getitem__):
        left = [i for i in own if not used[i]]
        while left:
            asked = [(path[j], tip[i] != "s", tip[j] != "s", i, j) for i in left if (j := best(i)) is not None]
            if not asked:
                break
            *_, i, j = min(asked)
            used[i] = used[j] = True
            out.append((path[i], tip[i], path[j], tip[j]))
            left.remove(i)
    return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate((("a", pa.int64()), ("a_tip", pa.string()), ("b", pa.int64()), ("b_tip", pa.string())))})
