"""Many shapes at once against one at a time."""

import numpy as np
from pyspark.sql import functions as F

from geomill.operators import raster


def test_wide_lines_of_one_key_give_each_pixel_once(spark, monkeypatch):
    monkeypatch.setattr(raster, "HELD_PIXELS", 50)
    draw = np.random.default_rng(3)
    rows = [(int(k), *map(float, draw.uniform(-4, 24, 4))) for k in draw.integers(0, 4, 60)]
    want = set()
    for k, x0, y0, x1, y1 in rows:
        length = np.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
        n = max(1, int(length * 2))
        for i in range(n + 1):
            for w in np.arange(7) * 0.5 - 1.5:
                x, y = int(x0 + (x1 - x0) * (i / n) + -(y1 - y0) / length * w), int(y0 + (y1 - y0) * (i / n) + (x1 - x0) / length * w)
                if 0 <= x < 20 and 0 <= y < 20:
                    want.add((k, x, y))
    lines = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double")
    found = raster.wide_line(lines, "k", 1.5, 20)
    assert "Exchange hashpartitioning(k" in found._jdf.queryExecution().toString() and "x#" not in found._jdf.queryExecution().toString().split("Exchange hashpartitioning(")[1].split(")")[0]
    got = [tuple(r) for r in found.select("k", "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_polygons_at_once_against_one_at_a_time():
    draw = np.random.default_rng(4)
    shapes = [np.concatenate([draw.uniform(-5, 30, (5, 2)), [[np.nan] * 2], draw.uniform(5, 20, (3, 2))]) for _ in range(30)] + [np.empty((0, 2)), np.array([[1.0, 1], [9, 9]])]
    p = np.concatenate(shapes)
    got = raster.polygons_pixels(p[:, 0], p[:, 1], np.repeat(np.arange(len(shapes)), [len(s) for s in shapes]), 25)
    for i, s in enumerate(shapes):
        assert got[got[:, 0] == i, 1:].tolist() == raster.polygon_pixels(s[:, 0], s[:, 1], 25).tolist()


def test_holes_are_never_broadcast(spark):
    k = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("x"), F.lit(1).alias("y"))
    plan = raster.subtract(k, k.filter("k < 4"), "k")
    assert "Broadcast" not in plan._jdf.queryExecution().toString() and plan.count() == 6
