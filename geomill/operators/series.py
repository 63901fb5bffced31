"""Ordered series: filters, slopes, curvature, resampling and thinning of rows with a key and an order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import WindowSpec


def along(key: list[str], order: list[str]) -> WindowSpec:
    return W.partitionBy(*key).orderBy(*order)


def box_filter(value: str, w: WindowSpec, size: int) -> Column:
    """Mean over ``size`` // 2 rows to either side, fewer at the ends; sizes up to 1 change nothing."""
    h = size // 2
    return F.col(value) if size <= 1 else F.avg(value).over(w.rowsBetween(-h, h))


def limit_slope(rows: DataFrame, value: str, key: list[str], order: list[str], rise: float) -> DataFrame:
    """``rows`` with ``limited``: the largest series below ``value`` that changes by at most ``rise`` a row.

    Closed form of a forward and a backward pass: the least of e(j) + rise |i - j| over j.
    """
    w = along(key, order)
    i = rows.withColumn("_i", F.row_number().over(w).cast("double"))
    before = F.min(F.col(value) - rise * F.col("_i")).over(w.rowsBetween(W.unboundedPreceding, 0)) + rise * F.col("_i")
    after = F.min(F.col(value) + rise * F.col("_i")).over(w.rowsBetween(0, W.unboundedFollowing)) - rise * F.col("_i")
    return i.withColumn("limited", F.least(before, after)).drop("_i")


def rise_of(spacing: float, max_degrees: float) -> float:
    """The change a row that a slope in degrees allows."""
    return spacing * math.tan(math.radians(max_degrees))


def level(rows: DataFrame, value: str, strength: float) -> DataFrame:
    """``rows`` with ``levelled``: ``value`` blended towards its mean over all rows."""
    mean = rows.agg(F.avg(value).alias("_mean"))
    return rows.join(F.broadcast(mean)).withColumn("levelled", F.col(value) * (1 - strength) + F.col("_mean") * strength).drop("_mean")  # mean: one row


def target_elevations(rows: DataFrame, value: str, key: list[str], order: list[str], size: int, strength: float, rise: float) -> DataFrame:
    """``rows`` with ``target``: box filtered, levelled towards the mean of all, and limited in slope."""
    smooth = rows.withColumn("_smooth", box_filter(value, along(key, order), size))
    flat = level(smooth, "_smooth", strength)
    return limit_slope(flat, "levelled", key, order, rise).withColumnRenamed("limited", "target").drop("_smooth", "levelled")


def fill_forward(value: str, w: WindowSpec, default: float = 100.0) -> Column:
    """The last value before or at a row that is neither null nor NaN, else ``default``."""
    return F.coalesce(F.last(F.nanvl(value, F.lit(None)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(default))


def curvature(x: str, y: str, w: WindowSpec) -> Column:
    """Signed turning angle per length at a row between its neighbours; null at the ends."""
    ax, ay = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (la * lb)))
    sign = F.when(ax * by - ay * bx < 0, -1.0).otherwise(1.0)
    return F.when((la < 1e-6) | (lb < 1e-6), 0.0).otherwise(sign * F.acos(dot) / ((la + lb) / 2))


def with_curvature(rows: DataFrame, x: str, y: str, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``curvature``; the ends copy their neighbour, series below three rows have 0."""
    w = along(key, order)
    inner = rows.withColumn("_c", curvature(x, y, w))
    return inner.withColumn("curvature", F.coalesce("_c", F.lead("_c").over(w), F.lag("_c").over(w), F.lit(0.0))).drop("_c")


def gaussian(value: str, w: WindowSpec, size: int, sigma: float) -> Column:
    """Gaussian kernel over ``size`` // 2 rows to either side, weights renormalised at the ends."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for d in range(-(size // 2), size // 2 + 1):
        k = math.exp(-d * d / (2 * sigma * sigma))
        at = F.lag(value, -d).over(w)
        total += F.coalesce(at, F.lit(0.0)) * k
        weights += F.when(at.isNotNull(), k).otherwise(0.0)
    return total / weights


def smooth_direction(x: str, y: str, w: WindowSpec, reach: int = 2) -> tuple[Column, Column]:
    """Unit vector of the mean direction over ``reach`` rows to either side; the row's own where that mean is zero."""
    box = w.rowsBetween(-reach, reach)
    mx, my = F.avg(x).over(box), F.avg(y).over(box)
    length = F.sqrt(mx * mx + my * my)
    return F.when(length > 1e-6, mx / length).otherwise(F.col(x)), F.when(length > 1e-6, my / length).otherwise(F.col(y))


def distance_along(x: str, y: str, key: list[str], order: list[str], from_start: bool = True) -> Column:
    """Path length from the first row of a series, or to its last."""
    w = along(key, order)
    step = F.coalesce(F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)), F.lit(0.0))
    return step


def with_distance(rows: DataFrame, x: str, y: str, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``from_start`` and ``to_end``, path lengths to the ends of the series."""
    w = along(key, order)
    stepped = rows.withColumn("_step", distance_along(x, y, key, order)).withColumn("from_start", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return stepped.withColumn("to_end", F.coalesce(F.sum("_step").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))).drop("_step")


def local_slope(value: str, distance: str, w: WindowSpec, reach: int = 3) -> Column:
    """Change of ``value`` by distance between ``reach`` rows before and after, clamped to the ends."""
    box = w.rowsBetween(-reach, reach)
    rise = F.last(value).over(box) - F.first(value).over(box)
    run = F.last(distance).over(box) - F.first(distance).over(box)
    return F.when(F.abs(run) < 1e-6, 0.0).otherwise(rise / run)


def endpoints(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First and last row of each series, with ``is_start`` and ``is_end``."""
    w = along(key, order)
    marked = rows.withColumn("is_start", F.lag(F.lit(1)).over(w).isNull()).withColumn("is_end", F.lead(F.lit(1)).over(w).isNull())
    return marked.filter("is_start OR is_end")


def long_enough(rows: DataFrame, length: str, interval: float, least: int = 10) -> DataFrame:
    """Series rows whose length holds at least ``least`` intervals."""
    return rows.filter(F.floor(F.col(length) / interval) >= least)


def chaikin(rows: DataFrame, x: str, y: str, key: list[str], order: str) -> DataFrame:
    """One round of corner cutting: ends stay, each edge gives the points at a quarter and three quarters; ``order`` is doubled."""
    w = along(key, [order])
    n = rows.withColumn("_x", F.lead(x).over(w)).withColumn("_y", F.lead(y).over(w)).withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
    n = n.withColumn("_last", F.col("_x").isNull()).withColumn("_beyond", F.lead("_last").over(w))

    def point(share, at):
        return F.struct(F.lit(at).alias("at"), (F.col(x) * (1 - share) + F.col("_x") * share).alias("x"), (F.col(y) * (1 - share) + F.col("_y") * share).alias("y"))

    own = F.struct(F.lit(0).alias("at"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    parts = F.array_compact(F.array(F.when(F.col("_first") | F.col("_last"), own), F.when(~F.col("_last"), point(0.25, 1)), F.when(~F.col("_last"), point(0.75, 2))))
    return n.select(*key, F.col(order), F.explode(parts).alias("p")).select(*key, (F.col(order) * 3 + F.col("p.at")).alias(order), F.col("p.x").alias(x), F.col("p.y").alias(y))


def resample(rows: DataFrame, x: str, y: str, key: list[str], order: list[str], interval: float) -> DataFrame:
    """Points each ``interval`` along the polyline of a series, and its last point: key, step, distance, x, y.

    A segment makes the samples that fall on it, so no series is gathered in
    one place.
    """
    w = along(key, order)
    d = with_distance(rows, x, y, key, order).withColumn("_nx", F.lead(x).over(w)).withColumn("_ny", F.lead(y).over(w)).withColumn("_nd", F.lead("from_start").over(w))
    first, last = F.ceil(F.col("from_start") / interval), F.ceil(F.col("_nd") / interval) - 1
    steps = F.when(F.col("_nd").isNull(), F.array(F.lit(None).cast("long"))).when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    s = d.withColumn("step", F.explode(steps)).withColumn("distance", F.coalesce(F.col("step") * interval, F.col("from_start")))
    t = F.coalesce((F.col("distance") - F.col("from_start")) / (F.col("_nd") - F.col("from_start")), F.lit(0.0))
    return s.select(*key, F.coalesce("step", F.ceil(F.col("from_start") / interval)).alias("step"), "distance", (F.col(x) + t * (F.coalesce("_nx", x) - F.col(x))).alias(x), (F.col(y) + t * (F.coalesce("_ny", y) - F.col(y))).alias(y))


#: Priority of road classes, and of any other class.
ROAD_PRIORITY = {
    "motorway": 100,
    "motorway_link": 95,
    "trunk": 90,
    "trunk_link": 85,
    "primary": 80,
    "primary_link": 78,
    "secondary": 75,
    "secondary_link": 73,
    "tertiary": 60,
    "tertiary_link": 58,
    "residential": 55,
    "unclassified": 50,
    "service": 45,
    "living_street": 40,
    "track": 30,
    "path": 25,
    "footway": 20,
    "cycleway": 20,
    "bridleway": 15,
    "pedestrian": 15,
    "steps": 10,
    "busway": 5,
    "raceway": 5,
    "proposed": 1,
}
OTHER_PRIORITY = 35


def lookup(table: dict, key: Column, default) -> Column:
    """``key``'s value in a small table, ``default`` where it has none."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def effective_priority(road_class: str, place: str, width: str) -> Column:
    """100 times the priority, plus the place in the material order: that of the class, or without one 5 for each metre of width, 10 to 100."""
    known = lookup(ROAD_PRIORITY, F.lower(road_class), OTHER_PRIORITY)
    by_width = F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.col(width) * 5)).cast("int")
    return F.when(F.coalesce(F.col(road_class), F.lit("")) == "", by_width).otherwise(known) * 100 + F.col(place)


def blend(t: Column, kind: str) -> Column:
    """Blend functions of t in 0 to 1, clamped: linear, cosine, cubic or quintic."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    forms = {
        "linear": t,
        "cosine": (1 - F.cos(t * math.pi)) / 2,
        "cubic": t * t * (3 - 2 * t),
        "quintic": t * t * t * (t * (t * 6 - 15) + 10),
    }
    return forms[kind]


def banked_edges(elevation: str, half_width: str, bank: str) -> tuple[Column, Column]:
    """Left and right edge elevations of a cross-section banked by an angle in radians."""
    rise = F.col(half_width) * F.sin(F.col(bank))
    return F.col(elevation) - rise, F.col(elevation) + rise


def split_at(rows: DataFrame, order: str, at: str) -> DataFrame:
    """``rows`` with ``half`` (a up to and b from the row at ``at``); that row is in both."""
    return rows.filter(F.col(order) <= F.col(at)).withColumn("half", F.lit("a")).unionByName(rows.filter(F.col(order) >= F.col(at)).withColumn("half", F.lit("b")))


def _sections(order: int, cutoff: float) -> list[tuple[float, ...]]:
    """Second-order (and one first-order) low-pass sections by the bilinear transform; ``cutoff`` is a share of the sampling rate."""
    k = math.tan(math.pi * cutoff)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * math.sin(math.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        out.append((k * k * norm, 2 * k * k * norm, k * k * norm, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm))
    if order % 2:
        norm = 1 / (1 + k)
        out.append((k * norm, k * norm, 0.0, (k - 1) * norm, 0.0))
    return out


def butterworth(values: np.ndarray, size: int, order: int) -> np.ndarray:
    """Zero-phase low-pass: each section runs forwards and then backwards, from a state settled on the first value."""
    if size <= 1 or len(values) < 3:
        return values.astype(float)
    y = values.astype(float)
    for b0, b1, b2, a1, a2 in _sections(min(8, max(1, order)), min(0.49, 1.0 / size)):
        for _ in range(2):
            out = np.empty_like(y)
            x1 = x2 = y1 = y2 = y[0]
            for i, x in enumerate(y):
                v = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
                x2, x1, y2, y1 = x1, x, y1, v
                out[i] = v
            y = out[::-1]
    return y


def each_series(rows: DataFrame, key: list[str], order: list[str], change: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """``change`` of every series as a frame in order; a partition's series come one after another from sorted batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finish(frame: pd.DataFrame) -> pd.DataFrame:
            starts = np.flatnonzero((frame[key] != frame[key].shift()).any(axis=1))
            return pd.concat([change(frame.iloc[i:j]) for i, j in zip(starts, [*starts[1:], len(frame)])])

        for batch in batches:
            last = batch[key].iloc[-1] if len(batch) else None
            if last is None:
                continue
            own = (batch[key] == last).all(axis=1).to_numpy()
            rest = len(batch) if own.all() else int(np.flatnonzero(~own)[-1]) + 1
            if own.all() and held and (held[0][key].iloc[-1] == last).all():
                held.append(batch)
                continue
            whole = pd.concat([*held, batch.iloc[:rest]]) if not own.all() else (pd.concat(held) if held else batch.iloc[:0])
            held = [batch.iloc[rest:]] if not own.all() else [batch]
            if len(whole):
                yield finish(whole)
        if held:
            yield finish(pd.concat(held))

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def low_pass(rows: DataFrame, value: str, key: list[str], order: list[str], size: int, degree: int) -> DataFrame:
    """``rows`` with ``filtered`` by ``butterworth``, whose recursion runs along a whole series; keys are not null."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "filtered double"])
    return each_series(rows, key, order, lambda s: s.assign(filtered=butterworth(s[value].to_numpy(), size, degree)), schema)


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Which rows of a polyline the Ramer-Douglas-Peucker rule keeps, without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, inner = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = math.hypot(*d)
        away = np.hypot(*(inner - p).T) if length < 1e-12 else np.abs(d[0] * (inner[:, 1] - p[1]) - d[1] * (inner[:, 0] - p[0])) / length
        i = int(away.argmax())
        if away[i] > epsilon:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def thin(points: np.ndarray, spacing: float) -> np.ndarray:
    """Which rows lie at least ``spacing`` from the last kept one; the first and the last stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    last = points[0]
    for i in range(1, len(points) - 1):
        if math.hypot(*(points[i] - last)) >= spacing:
            keep[i] = True
            last = points[i]
    return keep


def keep_points(rows: DataFrame, x: str, y: str, key: list[str], order: list[str], rule: str, amount: float) -> DataFrame:
    """The rows that ``simplify`` or ``thin`` keeps of each series."""
    chosen = {"simplify": simplify, "thin": thin}[rule]
    return each_series(rows, key, order, lambda s: s[chosen(s[[x, y]].to_numpy(float), amount)], rows.schema)


def curvature_statistics(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, lowest, highest, mean, most, mean_bend, tightest, straight, n) of signed curvatures; the tightest radius is infinite under 0.0001, straight under 0.001."""
    bend = F.abs(value)
    out = rows.groupBy(*key).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"), F.max(bend).alias("most"), F.avg(bend).alias("mean_bend"), F.count_if(bend < 0.001).alias("straight"), F.count("*").alias("n"))
    return out.withColumn("tightest", F.when(F.col("most") > 0.0001, 1 / F.col("most")).otherwise(F.lit(float("inf"))))
