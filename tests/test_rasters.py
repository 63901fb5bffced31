import math

import numpy as np

from geomill.operators import raster


def test_distances_over_a_raster_with_holes(spark):
    rows = [(x, y, (x * 7 + y * 3) % 11 == 0) for x in range(9) for y in range(8) if (x * y) % 4 != 1]
    on = [(x, y) for x, y, m in rows if m]
    want = sorted((x, y, round(min(math.dist((x, y), p) for p in on), 9)) for x, y, _ in rows)
    got = raster.distance_field(spark.createDataFrame(rows, "x int, y int, m boolean"), "m").collect()
    assert sorted((r.x, r.y, round(r.distance, 9)) for r in got) == want
    none = raster.distance_field(spark.createDataFrame([(0, 0, False), (1, 5, None)], "x int, y int, m boolean"), "m").collect()
    assert sorted((r.x, r.y, r.distance) for r in none) == [(0, 0, None), (1, 5, None)]


def test_distances_over_bands_of_a_larger_raster(spark, monkeypatch):
    monkeypatch.setattr(raster, "BAND", 7)
    draw = np.random.default_rng(3)
    on = draw.random((45, 60)) < 0.01
    rows = [(x, y, bool(on[y, x])) for y in range(45) for x in range(60) if draw.random() < 0.95 or on[y, x]]
    places = np.argwhere(on)
    got = raster.distance_field(spark.createDataFrame(rows, "x int, y int, m boolean").repartition(4), "m", 2.0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.distance - 2 * np.sqrt(((places - [r.y, r.x]) ** 2).sum(1).min())) < 1e-9


def test_envelopes_equal_all_parabolas():
    draw = np.random.default_rng(4)
    at, where = np.sort(draw.choice(200, 60, replace=False)).astype(float), np.arange(-3, 210).astype(float)
    cost = draw.integers(0, 900, (37, 60)).astype(float) ** draw.choice([1, 1.5, 0], (37, 1))
    want = (cost[:, None, :] + (where[None, :, None] - at[None, None, :]) ** 2).min(2)
    assert np.allclose(raster._envelopes(at, cost, where), want)
