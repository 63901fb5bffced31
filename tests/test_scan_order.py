"""Repair in scan order: what hangs together, the median of good heights, heights made once."""

import random

import pytest

from geomill.operators import raster
from geomill.plans import all_queries


def links_of(spark, monkeypatch, places):
    held = []

    def solved(rows, node, links, solve, rounds):
        held.append(links.distinct().count())
        return rows

    monkeypatch.setattr(raster, "solved", solved)
    grid = spark.createDataFrame([(x, y, 100.0 if (x, y) in places else 20.0) for x in range(40) for y in range(6)], "x long, y long, v double")
    raster.repair_in_scan_order(grid, "v", 100.0)
    return held[0]


def test_only_pixels_in_reach_hang_together(spark, monkeypatch):
    assert links_of(spark, monkeypatch, {(x, 0) for x in range(0, 40, 5)}) == 0  # cells side by side, pixels too far apart
    assert links_of(spark, monkeypatch, {(3, 3), (6, 4), (20, 0), (21, 0)}) == 1


@pytest.mark.parametrize("values", [1, 4, 100_000])
def test_medians_are_exact(spark, monkeypatch, values):
    monkeypatch.setattr(raster, "MEDIAN_VALUES", values)
    monkeypatch.setattr(raster, "MEDIAN_PIECES", 5)
    draw = random.Random(values)
    for many in (1, 2, 7, 300):
        v = [draw.choice([draw.uniform(-5, 5), float(draw.randrange(4))]) for _ in range(many)]
        assert raster.lower_median(spark.createDataFrame([(x,) for x in v], "h double"), "h") == sorted(v)[(many - 1) // 2]
    assert raster.lower_median(spark.createDataFrame([], "h double"), "h") is None


def test_heights_are_made_once(spark, sf_dir):
    plan = all_queries()[0]["repaired_in_order"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "ExistingRDD" in plan
