import math
import random

import numpy as np
import pytest

from geomill.operators import raster

V = "x long, y long, v double"


def rows_of(grid):
    return [(x, y, None if grid[y][x] is None else float(grid[y][x])) for y in range(len(grid)) for x in range(len(grid[0]))]


def scan(grid, most, fill):
    """Row by row, each pixel judged on what the ones before it became."""
    g = [list(r) for r in grid]
    good = lambda h: h is not None and math.isfinite(h) and h >= 0
    spikes = set()
    for y in range(len(g)):
        for x in range(len(g[0])):
            h = g[y][x]
            near = [g[b][a] for b in range(max(0, y - 3), min(len(g), y + 4)) for a in range(max(0, x - 3), min(len(g[0]), x + 4)) if (a, b) != (x, y) and good(g[b][a])]
            mean = math.fsum(near) / len(near) if near else math.nan
            if not good(h) or h >= most or h >= 0.99 * most and mean < 0.5 * most:
                g[y][x] = mean if mean < 0.95 * most else fill
                spikes.add((x, y))
    return g, spikes


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_equals_a_scan(spark, seed):
    draw = random.Random(seed)
    grid = [[draw.uniform(10, 60) for _ in range(40)] for _ in range(30)]
    for _ in range(25):  # spikes and patches of them, some side by side
        x, y = draw.randrange(38), draw.randrange(28)
        for dx in range(draw.choice([1, 1, 2, 6])):
            grid[y][min(39, x + dx)] = draw.choice([None, float("nan"), -3.0, 100.0, 250.0, 99.5, 99.9, float("inf")])
    for y in range(20, 30):
        for x in range(8):
            grid[y][x] = draw.choice([99.5, 100.0, None])
    fill = sorted(v for r in grid for v in r if v is not None and math.isfinite(v) and 0 <= v < 95)
    want, spikes = scan(grid, 100.0, fill[(len(fill) - 1) // 2])
    got = raster.repair_in_scan_order(spark.createDataFrame(rows_of(grid), V).repartition(5), "v", 100.0).collect()
    assert {(r.x, r.y) for r in got if r.is_spike} == spikes and len(spikes) > 60
    for r in got:
        assert abs(r.repaired - want[r.y][r.x]) < 1e-9


def reference_resize(grid, width, height):
    h, w = grid.shape

    def weights(size, target):
        ratio = size / target
        scale = max(ratio, 1.0)
        out = np.zeros((target, size))
        for i in range(target):
            c = (i + 0.5) * ratio - 0.5
            for j in range(size):
                d = abs(j - c) / scale
                if abs(j - c) <= math.ceil(2 * scale):
                    out[i, j] = 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0
        return out / out.sum(1, keepdims=True)

    return weights(h, height) @ grid @ weights(w, width).T


@pytest.mark.parametrize("target", [(75, 61), (20, 13), (50, 40), (50, 90)])
def test_resizing_over_several_tiles(spark, monkeypatch, target):
    monkeypatch.setattr(raster, "TILE", 16)
    grid = np.random.default_rng(1).uniform(0, 100, (40, 50))
    got = raster.resize(spark.createDataFrame(rows_of(grid), V).repartition(4), "v", (50, 40), target).collect()
    want = reference_resize(grid, *target)
    assert len(got) == target[0] * target[1]
    for r in got:
        assert abs(r.v - want[r.y, r.x]) < 1e-9


def test_resizing_passes_over_missing_pixels(spark):
    grid = np.full((20, 20), 7.0)
    rows = [r if (r[0] + r[1]) % 5 else (r[0], r[1], None) for r in rows_of(grid)]
    got = raster.resize(spark.createDataFrame(rows, V), "v", (20, 20), (33, 33)).collect()
    assert all(abs(r.v - 7) < 1e-9 for r in got) and len(got) > 900
    assert raster.resize(spark.createDataFrame([], V), "v", (20, 20), (33, 33)).count() == 0
