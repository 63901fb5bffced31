"""Rasters as rows (x, y, value): mosaics, ranges, stencils, distance, ownership, blends, masks and shapes to pixels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.operators.graph import plain, solved
from geomill.operators.splines import flat
from geomill.session import cut


def to_metres(raw: str, most: float) -> Column:
    """A 16-bit height as metres."""
    return F.col(raw) / 65535.0 * most


def flipped(y: str, size: int) -> Column:
    return F.lit(size - 1) - F.col(y)


def valid(value: str, nodata: float | None) -> Column:
    """True for values that are numbers, not no-data and not beyond a million."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) <= 1e6)
    return ok if nodata is None else ok & (F.abs(F.col(value) - nodata) >= 0.001)


def value_range(rows: DataFrame, value: str, nodata: float | None = None) -> DataFrame:
    """One row (low, high) over the valid values; 0 and 100 where there is none."""
    v = F.when(valid(value, nodata), F.col(value))
    return rows.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(F.max(v), F.lit(100.0)).alias("high"))


def to_sixteen_bits(rows: DataFrame, value: str, nodata: float | None = None) -> DataFrame:
    """``rows`` with ``raw``, 0 to 65535 over the value range; invalid values are 0."""
    span = value_range(rows, value, nodata)
    width = F.when(F.col("high") - F.col("low") < 0.001, 1.0).otherwise(F.col("high") - F.col("low"))
    scaled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("low")) / width)) * 65535).cast("int")
    return rows.join(F.broadcast(span)).withColumn("raw", F.when(valid(value, nodata), scaled).otherwise(0)).drop("low", "high")  # span: one row


def mosaic(tiles: DataFrame, order: str, value: str, pixel: float) -> DataFrame:
    """(x, y, value) over the joint extent of ``tiles`` (origin_x, origin_y, col, row, order, value); the tile of highest order wins a pixel."""
    corner = tiles.agg(F.min("origin_x").alias("_x0"), F.max("origin_y").alias("_y0"))
    at = tiles.join(F.broadcast(corner))  # one row
    x = F.round((F.col("origin_x") - F.col("_x0")) / pixel).cast("long") + F.col("col")
    y = F.round((F.col("_y0") - F.col("origin_y")) / pixel).cast("long") + F.col("row")
    return at.groupBy(x.alias("x"), y.alias("y")).agg(F.max_by(value, order).alias(value))


def extent(tiles: DataFrame) -> DataFrame:
    """One row: the joint extent of tiles (x0, y0, x1, y1, pixel), how many there are, and whether pixels differ in size."""
    return tiles.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"), (F.max("pixel") - F.min("pixel") > 1e-9).alias("mixed"))


def neighbour_mean(rows: DataFrame, value: str, radius: int, nodata: float | None = None) -> DataFrame:
    """``rows`` (x, y, value) with ``around``, the mean of the valid values in the square about a pixel without it; null if none.

    A pixel is sent to the 2 ``radius`` + 1 columns about it and added up by
    row there; a window along each column adds up the rows.
    """
    ok = valid(value, nodata)
    own = rows.withColumn("_v", F.when(ok, F.col(value)).otherwise(0.0)).withColumn("_n", F.coalesce(ok, F.lit(False)).cast("int"))
    sent = own.select(F.explode(F.sequence(F.col("x") - radius, F.col("x") + radius)).alias("x"), "y", "_v", "_n")
    band = sent.groupBy("x", "y").agg(F.sum("_v").alias("_bv"), F.sum("_n").alias("_bn"))
    side = W.partitionBy("x").orderBy("y").rangeBetween(-radius, radius)
    summed = band.withColumn("_sv", F.sum("_bv").over(side)).withColumn("_sn", F.sum("_bn").over(side)).select("x", "y", "_sv", "_sn")
    found = own.join(summed, ["x", "y"], "left")
    n = F.col("_sn") - F.col("_n")
    return found.withColumn("around", F.when(n > 0, (F.col("_sv") - F.col("_v")) / n)).drop("_v", "_n", "_sv", "_sn")


def repair_spikes(rows: DataFrame, value: str, most: float, radius: int = 3, lift: float = 50.0, default: float = 0.23) -> DataFrame:
    """``rows`` with ``repaired`` and ``is_spike``: NaN, negative, ``most`` or more, or above its neighbours' mean by ``lift`` near the top.

    A spike takes its neighbours' mean, else the median, else ``default``.  All
    pixels are judged on the input, not on pixels repaired before them.
    """
    around = neighbour_mean(rows, value, radius)
    middle = rows.filter(valid(value, None) & (F.col(value) >= 0) & (F.col(value) < most)).agg(F.percentile_approx(value, 0.5).alias("_median"))
    bad = F.col(value).isNull() | F.isnan(value) | (F.col(value) < 0) | (F.col(value) >= most) | ((F.col(value) > 0.95 * most) & (F.col(value) - F.col("around") > lift))
    return around.join(F.broadcast(middle)).withColumn("is_spike", bad).withColumn("repaired", F.when(F.col("is_spike"), F.coalesce("around", "_median", F.lit(default))).otherwise(F.col(value))).drop("around", "_median")  # one row


#: Distinct values among which the driver finds a median.
MEDIAN_VALUES, MEDIAN_PIECES = 100_000, 100


def lower_median(rows: DataFrame, value: str) -> float | None:
    """The exact median of a double column without nulls, the lower of two; None if it has no rows.

    Equal values are counted first; pieces of equally many of the distinct ones
    narrow them down until few enough are left for the driver.
    """
    counts = cut(rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")))
    n, many = counts.agg(F.sum("n"), F.count("*")).first()
    if not many:
        return None
    rank = (n + 1) // 2
    while many > MEDIAN_VALUES:
        marks = counts.agg(F.percentile_approx("v", [i / MEDIAN_PIECES for i in range(1, MEDIAN_PIECES)], 10 * MEDIAN_PIECES)).first()[0]
        marks = sorted(set(marks))
        piece = sum(((F.col("v") > m).cast("int") for m in marks), F.lit(0))
        for of, held, distinct in sorted(counts.groupBy(piece.alias("of")).agg(F.sum("n"), F.count("*")).collect()):
            if rank <= held:
                break
            rank -= held
        low, high = ([None, *marks][of], [*marks, None][of])
        counts = counts.filter((F.lit(True) if low is None else F.col("v") > low) & (F.lit(True) if high is None else F.col("v") <= high))
        many = distinct
    for v, held in sorted(map(tuple, counts.collect())):
        if rank <= held:
            return v
        rank -= held


def repair_in_scan_order(rows: DataFrame, value: str, most: float, radius: int = 3, default: float = 0.23, near: float = 0.99, believed: float = 0.95, low: float = 0.5) -> DataFrame:
    """``rows`` (x, y, value) with ``repaired`` and ``is_spike``, pixels judged row by row on those repaired before them.

    Spikes are missing, infinite or negative, ``most`` or more, or from
    ``near`` of it on with a mean of valid neighbours below ``low`` of it.  They
    take that mean where it is below ``believed`` of ``most``, else the median
    of good heights, else ``default``.  Only pixels that may be spikes depend on
    the order, so those that hang together by steps of ``radius`` are repaired
    in one task, each with the pixels about it; a whole region of them is one
    task's.  ``rows`` are read four times.
    """
    v = F.col(value).cast("double")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    doubtful = lambda c: ~sound(c) | (c < 0) | (c >= near * most)
    middle = lower_median(rows.filter(sound(v) & (v >= 0) & (v < believed * most)).select(v.alias("_v")), "_v")
    fill = middle if middle is not None and middle > 0 else default
    maybe = rows.filter(doubtful(v)).select("x", "y", v.alias("_v"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i or j]))
    wanted = maybe.select(F.col("x").alias("_x"), F.col("y").alias("_y"), step.alias("d")).select("_x", "_y", (F.col("_x") + F.col("d.i")).alias("x"), (F.col("_y") + F.col("d.j")).alias("y"))
    about = wanted.join(rows.select("x", "y", v.alias("_v")), ["x", "y"]).groupBy("_x", "_y").agg(F.collect_list(F.struct("x", "y", "_v")).alias("_about")).select(F.col("_x").alias("x"), F.col("_y").alias("y"), "_about")
    cell = lambda x, y: F.xxhash64(F.floor(x / (radius + 1)), F.floor(y / (radius + 1)))
    own = maybe.join(about, ["x", "y"], "left").withColumn("repaired", F.col("_v")).withColumn("is_spike", F.lit(False))
    own = cut(own.withColumn("_cell", cell(F.col("x"), F.col("y"))))
    links = own.select(F.col("_cell").alias("a"), F.explode(F.filter("_about", lambda n: doubtful(n["_v"]))).alias("n")).select("a", cell(F.col("n.x"), F.col("n.y")).alias("b")).filter("a < b")

    def judge(t: pa.Table) -> pa.Table:
        at = list(zip(t.column("y").to_pylist(), t.column("x").to_pylist()))
        spikes, repaired = [False] * t.num_rows, t.column("_v").to_pylist()
        now, lists = dict(zip(at, repaired)), plain(t.column("_about").combine_chunks())
        good = lambda h: h is not None and math.isfinite(h) and h >= 0
        for i in sorted(range(t.num_rows), key=at.__getitem__):
            h = now[at[i]]
            heights = [x for x in (now.get((n["y"], n["x"]), n["_v"]) for n in lists[i] or ()) if good(x)]
            mean = math.fsum(heights) / len(heights) if heights else math.nan
            if good(h) and h < most and not mean < low * most:
                continue
            spikes[i], repaired[i] = True, mean if mean < believed * most else fill
            now[at[i]] = repaired[i]
        return t.set_column(t.schema.get_field_index("repaired"), "repaired", pa.array(repaired, pa.float64())).set_column(t.schema.get_field_index("is_spike"), "is_spike", pa.array(spikes))

    done = solved(own, "_cell", links, judge, None).select("x", "y", "repaired", "is_spike")
    return rows.join(done, ["x", "y"], "left").withColumn("repaired", F.when(F.col("is_spike"), F.col("repaired")).otherwise(v)).withColumn("is_spike", F.coalesce("is_spike", F.lit(False)))


#: Pixels along the side of a tile that one task resizes.
TILE = 256


def _bicubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def resize_weights(first: int, stop: int, size: int, target: int, low: int, high: int) -> np.ndarray:
    """Weights of the source pixels ``low`` to ``high`` for the target pixels ``first`` to ``stop``, a row each; the kernel widens with the source's pixels."""
    ratio = size / target
    scale = max(ratio, 1.0)
    centre = (np.arange(first, stop) + 0.5) * ratio - 0.5
    reach = math.ceil(2 * scale)
    at = np.arange(low, high)
    inside = (at >= np.ceil(centre - reach)[:, None]) & (at <= np.floor(centre + reach)[:, None])
    own = np.where(inside, _bicubic((at - centre[:, None]) / scale), 0.0)
    total = own.sum(1, keepdims=True)
    return own / np.where(total == 0, 1, total)


def resize(rows: DataFrame, value: str, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(x, y, value): a raster of ``size`` (width, height) stretched to ``target`` by a bicubic kernel.

    Every pixel goes to the target tiles that it weighs in, a tile and its halo
    to a task; both directions are one matrix product there.  Missing and NaN
    pixels weigh nothing; pixels that only they weigh in have no row.
    """
    ratio = [s / t for s, t in zip(size, target)]
    reach = [math.ceil(2 * max(r, 1.0)) for r in ratio]

    def tiles(c: str, k: int) -> Column:
        to = lambda shift: F.floor(((F.col(c) + shift + 0.5) / ratio[k] - 0.5) / TILE)
        last = (target[k] - 1) // TILE
        return F.explode(F.sequence(F.greatest(F.lit(0), F.least(F.lit(last), to(-reach[k] - 1))), F.greatest(F.lit(0), F.least(F.lit(last), to(reach[k] + 1)))))

    own = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias("v"))
    sent = own.withColumn("tx", tiles("x", 0)).withColumn("ty", tiles("y", 1))

    def run(key, t):
        tx, ty = (int(k.as_py()) for k in key)
        x, y, v = (t.column(c).to_numpy() for c in ("x", "y", "v"))
        x0, y0 = x.min(), y.min()
        block = np.zeros((2, y.max() - y0 + 1, x.max() - x0 + 1))
        block[0, y - y0, x - x0], block[1, y - y0, x - x0] = v, 1
        i0, j0 = tx * TILE, ty * TILE
        i1, j1 = min(target[0], i0 + TILE), min(target[1], j0 + TILE)
        across = resize_weights(i0, i1, size[0], target[0], x0, x0 + block.shape[2])
        down = resize_weights(j0, j1, size[1], target[1], y0, y0 + block.shape[1])
        out, weight = down @ (block @ across.T)
        j, i = np.nonzero(weight > 1e-6)
        return pa.table({"x": i + i0, "y": j + j0, value: out[j, i] / weight[j, i]})

    return sent.groupBy("tx", "ty").applyInArrow(run, f"x long, y long, `{value}` double")


#: Lines of a raster whose distances one task works out together.
BAND = 64


def _envelopes(at: np.ndarray, cost: np.ndarray, where: np.ndarray) -> np.ndarray:
    """min over i of cost[r, i] + (where - at[i])^2 for every row r, by lower envelopes of parabolas, all rows at once; ``at`` and ``where`` ascend."""
    rows, many = cost.shape
    r = np.arange(rows)
    v, z, k = np.zeros((rows, many), np.int64), np.full((rows, many + 1), np.inf), np.zeros(rows, np.int64)
    z[:, 0] = -np.inf
    height = cost + at * at
    for i in range(1, many):
        todo, s = r, np.empty(rows)
        while len(todo):
            j = v[todo, k[todo]]
            s[todo] = (height[todo, i] - height[todo, j]) / (2.0 * (at[i] - at[j]))
            todo = todo[s[todo] <= z[todo, k[todo]]]
            k[todo] -= 1
        k += 1
        v[r, k], z[r, k] = i, s
        z[r, np.minimum(k + 1, many)] = np.inf
    out, now = np.empty((rows, len(where))), np.zeros(rows, np.int64)
    for q, x in enumerate(where):
        todo = r
        while len(todo := todo[(now[todo] < k[todo]) & (z[todo, now[todo] + 1] < x)]):
            now[todo] += 1
        own = v[r, now]
        out[:, q] = cost[r, own] + (x - at[own]) ** 2
    return out


def distance_field(rows: DataFrame, mask: str, metres: float = 1.0) -> DataFrame:
    """(x, y, distance) of each pixel to the nearest where ``mask`` holds; null if there is none.

    One pass down the columns, one across the rows, ``BAND`` of which a task
    works out together.  The first pass also fills the holes of a column that
    has a masked pixel, so that the second sees it from every row; the lines of
    the raster, a number each, are known to all tasks.
    """
    own = rows.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(mask).alias("on"))
    lines = np.sort(own.select("y").distinct().toPandas()["y"].to_numpy(float))  # one number a line

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        y, on = pdf["y"].to_numpy(float), pdf["on"].fillna(False).to_numpy(bool)
        if not on.any():
            return pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "d": np.nan, "there": True})
        d = np.abs(_nearest(np.sort(y[on]), lines) - lines) ** 2
        return pd.DataFrame({"x": pdf["x"].iloc[0], "y": lines.astype(np.int64), "d": d, "there": np.isin(lines, y)})

    def across(t: pa.Table) -> pa.Table:
        x, y, d, there = (t.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "d", "there"))
        (xs, col), (ys, row) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        known = ~np.isnan(d)
        at, place = np.unique(x[known], return_inverse=True)
        out = np.full((len(ys), len(xs)), np.nan)
        if len(at):  # a column with a masked pixel is known in every row
            cost = np.empty((len(ys), len(at)))
            cost[row[known], place] = d[known]
            out = np.sqrt(_envelopes(at.astype(float), cost, xs.astype(float))) * metres
        there = there.astype(bool)
        return pa.table({"x": x[there], "y": y[there], "distance": out[row, col][there]})

    columns = own.groupBy("x").applyInPandas(down, "x long, y long, d double, there boolean")
    bands = columns.groupBy(F.floor(F.col("y") / BAND).alias("_band"))
    return bands.applyInArrow(across, "x long, y long, distance double").withColumn("distance", F.nanvl("distance", F.lit(None)))


def _nearest(sorted_: np.ndarray, where: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(sorted_, where), 1, max(1, len(sorted_) - 1)) if len(sorted_) > 1 else np.zeros(len(where), int)
    if len(sorted_) == 1:
        return sorted_[i]
    return np.where(where - sorted_[i - 1] <= sorted_[i] - where, sorted_[i - 1], sorted_[i])


def owners(claims: DataFrame, owner: str, priority: str, order: str) -> DataFrame:
    """(x, y, owner, priority): the claim of highest priority on each pixel, ties to the first in ``order``."""
    best = claims.groupBy("x", "y").agg(F.max_by(F.struct(owner, priority), F.struct(priority, -F.col(order))).alias("b"))
    return best.select("x", "y", "b.*")


def protected_blend(rows: DataFrame, ground: str, target: str, distance: str, core: str, reach: str) -> Column:
    """The target in the core, eased to the ground over ``reach`` beyond it, the ground elsewhere."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(distance) / F.nullif(F.col(reach), F.lit(0))))
    eased = (1 - F.cos(t * np.pi)) / 2
    near = F.col(target).isNotNull() & (F.col(distance) < F.col(reach))
    return F.when(F.col(core) & F.col(target).isNotNull(), F.col(target)).when(near, F.col(target) * (1 - eased) + F.col(ground) * eased).otherwise(F.col(ground))


def layers_to_index(layers: DataFrame, place: str, alpha: str, threshold: int = 128) -> DataFrame:
    """(x, y, layer): the last layer in order whose alpha reaches the threshold, -1 for none."""
    return layers.groupBy("x", "y").agg(F.coalesce(F.max(F.when(F.col(alpha) >= threshold, F.col(place))), F.lit(-1)).alias("layer"))


def paint_statistics(layers: DataFrame, layer: str, alpha: str) -> DataFrame:
    """(layer, full, partial, mean_alpha): pixels of alpha 255, of less but not none, and the mean of the painted."""
    a = F.col(alpha)
    return layers.groupBy(layer).agg(F.count_if(a == 255).alias("full"), F.count_if((a > 0) & (a < 255)).alias("partial"), F.avg(F.when(a > 0, a)).alias("mean_alpha"))


def cut_and_fill(before: DataFrame, after: DataFrame, value: str, metres: float = 1.0, least: float = 0.001) -> DataFrame:
    """One row: cut and fill volumes and the number of changed pixels of two rasters (x, y, value)."""
    both = before.join(after.select("x", "y", F.col(value).alias("_after")), ["x", "y"]).withColumn("_d", F.col("_after") - F.col(value))
    d, area = F.col("_d"), metres * metres
    return both.agg((F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0.0)) * area).alias("cut"), (F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)) * area).alias("fill"), F.count_if(F.abs(d) > least).alias("modified"))


def masked_mode(rows: DataFrame, value: str, mask: str, order: str | None = None) -> DataFrame:
    """One row (value, n): the commonest value where ``mask`` holds; ties to the first in ``order``, or the lowest."""
    counts = rows.filter(mask).groupBy(value).agg(F.count("*").alias("n"), F.min(order or value).alias("_first"))
    return counts.agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("m")).select("m.*")


def histogram(rows: DataFrame, value: str, mask: str) -> DataFrame:
    """(value, n, share) where ``mask`` holds."""
    counts = rows.filter(mask).groupBy(value).agg(F.count("*").alias("n"))
    whole = rows.filter(mask).agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(whole)).select(value, "n", (F.col("n") / F.col("_all")).alias("share"))  # whole: one row


def exclude(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """``rows`` (x, y) outside the pixels of ``zones``."""
    return rows.join(zones.select("x", "y").distinct(), ["x", "y"], "left_anti")


def line_pixels(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Pixels of a straight line as an array of (x, y): one for each step along its longer side."""
    dx, dy = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    n = F.greatest(F.abs(dx), F.abs(dy)).cast("int")
    part = lambda a, d, i: F.floor(F.col(a) + F.when(n == 0, 0).otherwise(d * i / n) + 0.5).cast("long")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(part(x0, dx, i).alias("x"), part(y0, dy, i).alias("y")))


def polygon_pixels(xs: np.ndarray, ys: np.ndarray, size: int) -> np.ndarray:
    """Pixels (x, y) whose centre is inside the rings, laid end to end with NaN between them, by the even-odd rule."""
    return polygons_pixels(np.asarray(xs, float), np.asarray(ys, float), np.zeros(len(xs), np.int64), size)[:, 1:]


def polygons_pixels(x: np.ndarray, y: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """(shape, x, y) of the pixels of many shapes at once, in the order of shape, y and x; ``of`` is the shape of each point and ascends."""
    n = len(x)
    empty = np.empty((0, 3), np.int64)
    if not n:
        return empty
    gap = np.isnan(x)
    first = np.concatenate(([True], (of[1:] != of[:-1]) | gap[:-1])) & ~gap
    last = np.concatenate(((of[1:] != of[:-1]) | gap[1:], [True])) & ~gap
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    after = np.arange(1, n + 1)
    after[stops] = starts
    held = np.repeat(stops - starts > 1, stops - starts + 1)
    a = np.flatnonzero(~gap)[held]
    b = after[a]
    x1, y1, x2, y2, of = x[a], y[a], x[b], y[b], of[a]
    low = np.maximum(0, np.floor(np.minimum(y1, y2)).astype(np.int64))
    high = np.minimum(size - 1, np.ceil(np.maximum(y1, y2)).astype(np.int64))
    edge, row = _spans(low, high)
    c = row + 0.5
    hit = (y1[edge] <= c) != (y2[edge] <= c)
    edge, row, c = edge[hit], row[hit], c[hit]
    at = x1[edge] + (c - y1[edge]) / (y2[edge] - y1[edge]) * (x2[edge] - x1[edge])
    order = np.lexsort((at, row, of[edge]))
    own, row, at = of[edge][order][::2], row[order][::2], at[order]
    span, cols = _spans(np.maximum(0, np.ceil(at[::2] - 0.5).astype(np.int64)), np.minimum(size - 1, np.ceil(at[1::2] - 0.5).astype(np.int64) - 1))
    return np.column_stack([own[span], cols, row[span]]) if len(cols) else empty


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each pair and every number from its low to its high."""
    many = np.maximum(0, high - low + 1)
    i = np.repeat(np.arange(len(low)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]


#: Pixels of shapes that a task holds at once, more only where one shape has them.
HELD_PIXELS = 1_000_000


def fill_polygons(rows: DataFrame, key: str, xs: str, ys: str, size: int) -> DataFrame:
    """(key, x, y): the pixels of each polygon."""

    def run(batches):
        for batch in batches:
            x, y, first = flat(batch, xs, ys)
            ends = np.append(first[1:], len(x))
            kept = ~np.isnan(x)
            most = np.zeros(batch.num_rows)
            full = np.flatnonzero(ends > first)
            if not len(full):
                continue
            reach = lambda v: np.maximum.reduceat(np.where(kept, v, -np.inf), first[full]) - np.minimum.reduceat(np.where(kept, v, np.inf), first[full])
            most[full] = np.minimum(size, np.maximum(0, reach(x) + 2)) * np.minimum(size, np.maximum(0, reach(y) + 2)) + ends[full] - first[full]
            part = np.floor(np.cumsum(most) / HELD_PIXELS)
            cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [batch.num_rows]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                a, b = first[lo], ends[hi - 1]
                p = polygons_pixels(x[a:b], y[a:b], np.repeat(np.arange(lo, hi), ends[lo:hi] - first[lo:hi]), size)
                if len(p):
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(p[:, 0])), pa.array(p[:, 1]), pa.array(p[:, 2])], [key, "x", "y"])

    return rows.select(key, xs, ys).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, x long, y long")


def bilinear(points: DataFrame, px: str, py: str, raster: DataFrame, value: str) -> DataFrame:
    """Distinct ``points`` with ``sampled``: the raster between its four pixels about a point; null where one is missing."""
    cells = F.array(*[F.struct((F.floor(px) + i).alias("x"), (F.floor(py) + j).alias("y"), (F.abs(1 - i - (F.col(px) - F.floor(px))) * F.abs(1 - j - (F.col(py) - F.floor(py)))).alias("w")) for i in (0, 1) for j in (0, 1)])
    own = points.withColumn("_id", F.struct(*points.columns))
    four = own.select("_id", F.explode(cells).alias("c")).select("_id", "c.x", "c.y", "c.w")
    got = four.join(raster.select("x", "y", value), ["x", "y"], "left").groupBy("_id").agg(F.when(F.count(value) >= 4, F.sum(F.col(value) * F.col("w")) / F.count("*") * 4).alias("sampled"))
    return got.select("_id.*", "sampled")


def cropped(rows: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """``rows`` of the window whose first pixel is (x, y)."""
    return rows.filter(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))


def spikes(rows: DataFrame, raw: str, most: float, share: float, radius: int = 3) -> DataFrame:
    """(x, y, raw, height, around, reason) of the pixels of a 16-bit raster that stand out from their neighbours.

    Only pixels at the top of the range or above ``share`` of ``most`` are
    compared with the pixels about them.  Reasons: ``top`` (raw 65534 or more,
    neighbours below 60000 on average), ``over nothing`` (raw 65535, neighbours
    within a twentieth of ``most``), ``jump`` (0.8 of ``most`` above the mean,
    every neighbour below a fifth).  Pixels without neighbours are no spikes.
    """
    own = rows.select("x", "y", F.col(raw).alias("raw"))
    metres = to_metres("raw", most)
    high = own.filter((F.col("raw") >= 65534) | (metres >= most * share))
    steps = [F.lit(d) for d in range(-radius, radius + 1)]
    about = high.withColumn("_x", F.explode(F.transform(F.array(*steps), lambda d: F.col("x") + d))).withColumn("_y", F.explode(F.transform(F.array(*steps), lambda d: F.col("y") + d)))
    about = about.filter("_x <> x OR _y <> y")
    near = about.join(own.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("raw").alias("_raw")), ["_x", "_y"])
    seen = near.groupBy("x", "y", "raw").agg(F.avg("_raw").alias("_mean"), F.max("_raw").alias("_max"))
    height, mean, top = metres, to_metres("_mean", most), to_metres("_max", most)
    reason = (
        F.when((F.col("raw") >= 65534) & (F.col("_mean") < 60000), "top")
        .when((F.col("raw") == 65535) & (mean < most * 0.05), "over nothing")
        .when((height - mean > most * 0.8) & (top < height * 0.2), "jump")
    )
    return seen.select("x", "y", "raw", height.alias("height"), mean.alias("around"), reason.alias("reason")).filter("reason IS NOT NULL")


def section_mask(sections: DataFrame, x: str, y: str, nx: str, ny: str, width: str, target: str, metres: float, size: int) -> DataFrame:
    """(x, y) of the pixels under one line from edge to edge of each cross-section that has a finite target; what lies off the raster goes."""
    cell = lambda at, normal, side: ((F.col(at) + side * F.col(normal) * F.col(width) / 2) / metres).cast("int")
    ends = sections.filter(F.col(target).isNotNull() & ~F.isnan(target) & (F.abs(target) < float("inf")))
    ends = ends.select(cell(x, nx, -1).alias("x0"), cell(y, ny, -1).alias("y0"), cell(x, nx, 1).alias("x1"), cell(y, ny, 1).alias("y1"))
    pixels = ends.select(F.explode(line_pixels("x0", "y0", "x1", "y1")).alias("p")).select("p.*")
    return pixels.filter(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1)).distinct()


def subtract(pixels: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """``pixels`` (key, x, y) without those of ``holes`` of the same key.

    Shapes grow into far more pixels than plans expect of them, so the holes
    are never broadcast.
    """
    return pixels.join(holes.select(key, "x", "y").distinct().hint("merge"), [key, "x", "y"], "left_anti")


def wide_line(segments: DataFrame, key: str, half_width: float, size: int) -> DataFrame:
    """(key, x, y): pixels met by half-unit steps along and across each segment (x0, y0, x1, y1); a segment of no length has none.

    The segments of a key meet in a task, pixels are never shuffled; of a key
    a task holds its distinct pixels.
    """
    across = np.arange(int(half_width * 4) + 1) * 0.5 - half_width
    ends = ("x0", "y0", "x1", "y1")

    def run(batches):
        last, held = ..., np.empty(0, np.int64)
        for batch in batches:
            keys = batch.column(key)
            named = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x0, y0, x1, y1 = (batch.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for c in ends)
            length = np.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
            steps = np.where(length > 0, np.maximum(1, np.nan_to_num(length * 2, posinf=0).astype(np.int64)), -1)
            part = np.floor(np.cumsum((steps + 1) * len(across)) / HELD_PIXELS)
            cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(x0)]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                i, k = _spans(np.zeros(hi - lo, np.int64), steps[lo:hi])
                i += lo
                if not len(i):
                    continue
                t, wide = (k / steps[i])[:, None], length[i]
                px, py = -(y1 - y0)[i] / wide, (x1 - x0)[i] / wide
                x = ((x0[i] + (x1 - x0)[i] * t[:, 0])[:, None] + px[:, None] * across).astype(np.int64)
                y = ((y0[i] + (y1 - y0)[i] * t[:, 0])[:, None] + py[:, None] * across).astype(np.int64)
                inside = (x >= 0) & (x < size) & (y >= 0) & (y < size)
                own = np.broadcast_to(named[i][:, None], x.shape)[inside]
                rank, own = np.unique(own, return_inverse=True)
                codes = np.unique((own * size + x[inside]) * size + y[inside])
                group, pixel = rank[codes // (size * size)], codes % (size * size)
                if keys[lo].as_py() == last:  # the key goes on from the batch or block before
                    there = group == named[lo]
                    new = ~there | ~np.isin(pixel, held)
                    held = np.union1d(held, pixel[there])
                    if named[hi - 1] != named[lo]:
                        held = pixel[group == named[hi - 1]]
                    group, pixel = group[new], pixel[new]
                else:
                    held = pixel[group == named[hi - 1]]
                last = keys[hi - 1].as_py()
                row = lo + np.unique(named[lo:hi], return_index=True)[1][np.searchsorted(np.unique(named[lo:hi]), group)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(pixel // size), pa.array(pixel % size)], [key, "x", "y"])

    own = segments.select(key, *ends).repartition(key).sortWithinPartitions(key)
    return own.mapInArrow(run, f"`{key}` {segments.schema[key].dataType.simpleString()}, x long, y long")


def convex_pixels(shapes: DataFrame, key: str, ring: str, size: int) -> DataFrame:
    """(key, x, y): pixels of convex rings, arrays of (x, y), one span a scan line from its leftmost to its rightmost edge."""
    n = F.size(ring)
    low, high = F.array_min(F.transform(ring, lambda p: p.y)), F.array_max(F.transform(ring, lambda p: p.y))
    lines = F.sequence(F.greatest(F.lit(0), F.floor(low)).cast("int"), F.least(F.lit(size - 1), F.ceil(high)).cast("int"))
    rows = shapes.filter((n >= 3) & (high >= 0) & (low < size)).withColumn("_y", F.explode(lines))
    centre = F.col("_y") + 0.5
    edges = F.zip_with(F.col(ring), F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.when((a.y <= centre) != (b.y <= centre), a.x + (centre - a.y) / (b.y - a.y) * (b.x - a.x)))
    met = rows.withColumn("_e", F.filter(edges, lambda v: v.isNotNull())).filter(F.size("_e") > 0)
    first, last = F.greatest(F.lit(0), F.ceil(F.array_min("_e") - 0.5)).cast("long"), F.least(F.lit(size - 1), F.ceil(F.array_max("_e") - 0.5) - 1).cast("long")
    return met.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").select(key, F.explode(F.sequence("_a", "_b")).alias("x"), F.col("_y").cast("long").alias("y"))


def one_hot(rows: DataFrame, layer: str, names: dict[str, object]) -> DataFrame:
    """(x, y, one boolean a name): which layers a pixel has; ``names`` gives each column its value of ``layer``."""
    return rows.groupBy("x", "y").agg(*[F.coalesce(F.bool_or(F.col(layer) == value), F.lit(False)).alias(name) for name, value in names.items()])


def marked(rows: DataFrame, x: str, y: str, zones: DataFrame, metres: float) -> DataFrame:
    """``rows`` with ``excluded``: whether their pixel is one of ``zones`` (x, y)."""
    pixels = zones.select(F.col("x").alias("_zx"), F.col("y").alias("_zy")).distinct().withColumn("_z", F.lit(True))
    own = rows.withColumn("_zx", (F.col(x) / metres).cast("long")).withColumn("_zy", (F.col(y) / metres).cast("long"))
    return own.join(pixels, ["_zx", "_zy"], "left").withColumn("excluded", F.coalesce("_z", F.lit(False))).drop("_zx", "_zy", "_z")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule; a rule that is null counts as broken.  One pass for all rules."""
    counts = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules])).alias("r")).select("r.*")


def to_world(x: str, y: str, size: int, metres: float) -> tuple[Column, Column]:
    """Terrain metres from a corner as metres from the middle."""
    half = size / 2 * metres
    return F.col(x) - half, F.col(y) - half
