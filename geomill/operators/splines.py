"""Smooth or straight curves through the points of lines, sampled along their length.

A batch of lines is one flat array of points with the place where each line
begins, and every step works on all lines of the batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points from which a smooth curve is an Akima spline; three or four make a natural cubic one.
AKIMA_POINTS = 5
#: Shortest curve, and the least distance of the last sample before the end, in units of the plane.
LEAST_LENGTH, LEAST_STEP = 0.001, 0.01
#: Samples evaluated at once.
SAMPLES_AT_ONCE = 1 << 20


def arc_lengths(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distance of each point from the start of its line along the line."""
    step = np.hypot(np.diff(x, prepend=x[:1]), np.diff(y, prepend=y[:1]))
    step[first] = 0
    run = np.cumsum(step)
    return run - np.repeat(run[first], np.diff(np.append(first, len(x))))


def _three_point(t: np.ndarray, v: np.ndarray, at: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Slope at the points ``at`` of the parabola through the points i, i + 1 and i + 2."""
    u, t1, t2 = t[at] - t[i], t[i + 1] - t[i], t[i + 2] - t[i]
    a = (v[i + 2] - v[i] - t2 / t1 * (v[i + 1] - v[i])) / (t2 * t2 - t1 * t2)
    return 2 * a * u + (v[i + 1] - v[i] - a * t1 * t1) / t1


def akima_slopes(t: np.ndarray, v: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slopes at the points of lines of ``AKIMA_POINTS`` points or more; zero elsewhere."""
    out, n = np.zeros(len(t)), len(t)
    wide = size >= AKIMA_POINTS
    if not wide.any():
        return out
    h = np.diff(t, append=t[-1:])
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.diff(v, append=v[-1:]) / h
    w = np.abs(np.diff(d, prepend=d[:1]))
    place = np.arange(n) - np.repeat(first, size)
    inner = np.flatnonzero(np.repeat(wide, size) & (place >= 2) & (place <= np.repeat(size, size) - 3))
    a, b = w[inner - 1], w[inner + 1]
    flat = (a < 1.2e-15) & (b < 1.2e-15)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = (b * d[inner - 1] + a * d[inner]) / (a + b)
        even = (h[inner] * d[inner - 1] + h[inner - 1] * d[inner]) / (t[inner + 1] - t[inner - 1])
    out[inner] = np.where(flat, even, own)
    lo, hi = first[wide], first[wide] + size[wide] - 3
    for at, base in ((lo, lo), (lo + 1, lo), (hi + 1, hi), (hi + 2, hi)):
        out[at] = _three_point(t, v, at, base)
    return out


def natural_slopes(t: np.ndarray, v: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slopes at the points of lines of three or four points, of curves without bend at both ends."""
    out = np.zeros(len(t))
    for n in range(3, AKIMA_POINTS):
        at = first[size == n][:, None] + np.arange(n)
        if not len(at):
            continue
        h, d = np.diff(t[at], axis=1), np.diff(v[at], axis=1)
        left, right = np.zeros((len(at), n, n)), np.empty((len(at), n, 1))
        left[:, 0, 0], left[:, 0, 1], right[:, 0, 0] = 2, 1, 3 * d[:, 0] / h[:, 0]
        left[:, -1, -1], left[:, -1, -2], right[:, -1, 0] = 2, 1, 3 * d[:, -1] / h[:, -1]
        for i in range(1, n - 1):
            left[:, i, i - 1], left[:, i, i], left[:, i, i + 1] = h[:, i], 2 * (h[:, i - 1] + h[:, i]), h[:, i - 1]
            right[:, i, 0] = 3 * (d[:, i - 1] / h[:, i - 1] * h[:, i] + d[:, i] / h[:, i] * h[:, i - 1])
        out[at] = np.linalg.solve(left, right)[..., 0]
    return out


def sample(x: np.ndarray, y: np.ndarray, first: np.ndarray, interval: float, smooth: bool = True) -> tuple[np.ndarray, ...]:
    """(line, distance, x, y, tx, ty) of samples each ``interval`` along every line, and at its end.

    Consecutive points of a line are apart.  Smooth curves are Akima splines
    over the arc length of the points' polyline, natural cubic ones through
    three or four points; others, and those of two points, are straight
    between points.  (tx, ty) is the unit direction, (1, 0) where the curve
    stands still.
    """
    size = np.diff(np.append(first, len(x)))
    t = arc_lengths(x, y, first)
    whole = t[first + size - 1]
    many = np.floor(whole / interval).astype(np.int64) + 1
    many += (many - 1) * interval < whole - LEAST_STEP
    line = np.repeat(np.arange(len(first)), many)
    step = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
    at = np.minimum(step * interval, whole[line])
    # one search over all lines: places on a common axis on which lines follow each other
    base = np.cumsum(whole + 1) - whole - 1
    seg = np.searchsorted(np.repeat(base, size) + t, base[line] + at, side="right") - 1
    seg = np.clip(seg, first[line], first[line] + size[line] - 2)
    u, h = at - t[seg], t[seg + 1] - t[seg]
    out = []
    for v in (x, y):
        d = (v[seg + 1] - v[seg]) / h
        if smooth:
            curved = size[line] >= 3
            m = akima_slopes(t, v, first, size) + natural_slopes(t, v, first, size)
            a, b = np.where(curved, m[seg], d), np.where(curved, m[seg + 1], d)
        else:
            a = b = d
        c2, c3 = (3 * d - 2 * a - b) / h, (a + b - 2 * d) / (h * h)
        out.append((v[seg] + u * (a + u * (c2 + u * c3)), a + u * (2 * c2 + 3 * u * c3)))
    (px, dx), (py, dy) = out
    length = np.hypot(dx, dy)
    moves = length > LEAST_LENGTH
    safe = np.where(moves, length, 1)
    return line, at, px, py, np.where(moves, dx / safe, 1.0), np.where(moves, dy / safe, 0.0)


def without_repeats(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of one line lie more than ``tolerance`` from the last kept one; the first stays."""
    keep = np.ones(len(x), bool)
    near = np.hypot(np.diff(x), np.diff(y)) <= tolerance
    if near.any():  # only from the first near pair on does a point depend on what was kept
        last = at = int(near.argmax())
        for i in range(at + 1, len(x)):
            keep[i] = (x[i] - x[last]) ** 2 + (y[i] - y[last]) ** 2 > tolerance * tolerance
            last = i if keep[i] else last
    return keep


def without_repeats_each(x: np.ndarray, y: np.ndarray, first: np.ndarray, tolerance: float) -> np.ndarray:
    """``without_repeats`` of lines laid end to end, of which only those with a near pair are gone through one by one; none of a line of one point."""
    size = np.diff(np.append(first, len(x)))
    keep = np.repeat(size > 1, size)
    if len(x) < 2:
        return keep
    line = np.repeat(np.arange(len(first)), size)
    near = (np.hypot(np.diff(x), np.diff(y)) <= tolerance) & (line[1:] == line[:-1])
    for i in np.unique(line[1:][near]).tolist():
        own = slice(first[i], first[i] + size[i])
        keep[own] = without_repeats(x[own], y[own], tolerance)
    return keep


def flat(batch: pa.RecordBatch, xs: str, ys: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, first) of the lines of a batch, their points end to end."""
    a, b = batch.column(xs), batch.column(ys)
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64)
    return *(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (a, b)), np.cumsum(size) - size


def spline_samples(lines: DataFrame, interval: float, smooth: bool = True, tolerance: float = 0.01, least: float = 1.0, key: str = "path", xs: str = "xs", ys: str = "ys") -> DataFrame:
    """(key, step, distance, x, y, tx, ty, nx, ny): samples of the curve through each line's points.

    Points within ``tolerance`` of the last kept one go; lines then of less
    than two points, or shorter than ``least``, have no samples, nor have null
    and empty ones.  The normal (nx, ny) points to the right of the direction.
    """
    kind = lines.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x, y, first = flat(batch, xs, ys)
            stop = np.append(first[1:], len(x))
            keep = without_repeats_each(x, y, first, tolerance)
            run_ = np.append(0, np.cumsum(keep))
            size = run_[stop] - run_[first]
            x, y = x[keep], y[keep]
            begin = np.cumsum(size) - size
            own = size >= 2
            length = np.zeros(len(size))
            if own.any():
                t = arc_lengths(x, y, begin[size > 0])
                length[own] = t[(begin + size - 1)[own]]
            own &= length >= max(least, LEAST_LENGTH)
            chosen = np.flatnonzero(own)
            part = np.cumsum(length[chosen] / interval + 2) // SAMPLES_AT_ONCE
            for some in np.split(chosen, np.flatnonzero(np.diff(part)) + 1) if len(chosen) else []:
                points = np.repeat(begin[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                line, at, px, py, tx, ty = sample(x[points], y[points], np.cumsum(size[some]) - size[some], interval, smooth)
                step = np.arange(len(line)) - np.searchsorted(line, line)
                names = batch.column(key).take(pa.array(some[line]))
                yield pa.RecordBatch.from_arrays([names, *(pa.array(c) for c in (step, at, px, py, tx, ty, ty, -tx))], [key, "step", "distance", "x", "y", "tx", "ty", "nx", "ny"])

    return lines.select(key, xs, ys).mapInArrow(run, f"`{key}` {kind}, step long, distance double, x double, y double, tx double, ty double, nx double, ny double")


def clip_to_square(x: np.ndarray, y: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(x, y, start is cut, end is cut) of a line inside the square from 0 to ``size``.

    Points inside stay.  A point outside, after one inside, gives the place of
    the step from the last result towards it that still lies inside the
    square, which is the last result itself; before any, the place at which
    the step from the point before it enters the square, if it does.
    """
    inside = (x >= 0) & (x <= size) & (y >= 0) & (y <= size)
    if inside.all():
        return x, y, False, False
    out: list[tuple[float, float]] = []
    for i in range(len(x)):
        if inside[i]:
            out.append((x[i], y[i]))
            continue
        if not out and not i:
            continue
        (ax, ay), (bx, by) = (out[-1], (x[i], y[i])) if out else ((x[i], y[i]), (x[i - 1], y[i - 1]))
        low, high = 0.0, 1.0
        for move, place in ((bx - ax, ax), (by - ay, ay)):
            if abs(move) < 1e-10:
                low, high = (low, high) if 0 <= place <= size else (1.0, 0.0)
                continue
            enter, leave = sorted((-place / move, (size - place) / move))
            low, high = max(low, enter), min(high, leave)
        if low <= high:
            out.append((ax + low * (bx - ax), ay + low * (by - ay)))
    if len(out) < 2:
        return np.empty(0), np.empty(0), True, True
    points = np.array(out)
    return points[:, 0], points[:, 1], out[0] != (x[0], y[0]), out[-1] != (x[-1], y[-1])
