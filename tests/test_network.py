"""Clusters of places and elevations of junctions against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geomill.operators import network, spatial


def brute_clusters(rows):
    label = {k: k for k, *_ in rows}

    def find(a):
        while label[a] != a:
            label[a] = a = label[label[a]]
        return a

    for i, (a, x, y, r) in enumerate(rows):
        for b, u, v, s in rows[:i]:
            if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= max(r, s):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {k: find(k) for k in label}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_different_radii(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-2.5, 0.6)) for i in range(500)]
    rows += [(500 + i, rng.gauss(20, 0.05), rng.gauss(20, 0.05), rng.choice([0.01, 0.02, 0.3])) for i in range(300)]  # dense
    rows += [(900 + i, 3.0 * (i % 4), 80.0 + 3 * (i // 4), 3.0) for i in range(12)]  # exactly in reach
    rows += [(1000, 500.0, 0.0, 0.0), (1001, 500.0, 0.0, 0.0), (1002, 501.0, 0.0, 0.0), (1003, 502.0, 0.0, 1.0)]
    rng.shuffle(rows)
    got = spatial.cluster(spark.createDataFrame(rows, "k long, x double, y double, r double"), "k", "x", "y", "r")
    assert {r.k: r.cluster for r in got.collect()} == brute_clusters(rows)


def test_clusters_of_one_radius_and_without_places(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(30)), float(rng.randrange(30)), 1.0) for i in range(150)]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 1.0)], "k long, x double, y double, r double")
    got = {r.k: r.cluster for r in spatial.cluster(df, "k", "x", "y", 1.0).collect()}
    assert got.pop(999) == 999 and got == brute_clusters(rows)
    assert spatial.cluster(df.limit(0), "k", "x", "y", 1.0).count() == 0


def test_levels_pass_over_missing_values(spark):
    rows = [(1, 1, None, 5, 0.0), (1, 2, 10.0, 1, 0.0), (2, 1, None, 5, 1.0), (3, 1, 4.0, 0, 0.0), (3, 2, 8.0, 0, 0.0), (4, 1, 6.0, None, 0.0), (4, 2, 2.0, 3, 0.0)]
    df = spark.createDataFrame(rows, "j int, road int, v double, p int, d double").withColumn("through", F.col("road") == 1)
    level = lambda found: {r.j: r.level for r in found.collect()}
    assert level(network.junction_levels(df, "j", "v", "p", "d")) == {1: 10.0, 2: None, 3: 6.0, 4: 2.0}
    assert level(network.crossing_levels(df, "j", "v", "p")) == {1: 10.0, 2: None, 3: 6.0, 4: 2.0}
    assert level(network.t_junction_levels(df, "j", "road", "v", "p", "through"))[1] == 10.0
    flat = network.plateaus(df.withColumn("r", F.lit(5.0)), "j", "v", "p", "d", "r", 1.0).filter("j = 1 AND road = 2").first().flat
    assert flat == 10.0


def test_equal_roads_take_the_two_furthest_apart(spark):
    rng = random.Random(6)
    rows = [(j, r, rng.uniform(0, 50), 10.0 + r % 3, float(rng.choice([rng.randrange(360), rng.randrange(0, 360, 45), rng.randrange(-720, 720, 90)]))) for j in range(60) for r in range(rng.randrange(3, 9))]
    rows += [(99, r, float(r), 1.0, 180.0 * (r % 2)) for r in range(500)]
    df = spark.createDataFrame(rows, "j long, road long, v double, len double, g double")
    got = {r.j: r.level for r in network.equal_priority_levels(df, "j", "road", "v", "len", "g").collect()}
    for j in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == j]
        pairs = []
        for a in own:
            for b in own:
                turn = abs(a[4] - b[4]) % 360
                turn = 360 - turn if turn > 180 else turn
                if a[1] < b[1] and turn >= 140:
                    pairs.append((turn, -a[1], -b[1], (a[2] + b[2]) / 2))
        want = max(pairs)[3] if pairs else sum(r[2] * r[3] for r in own) / sum(r[3] for r in own)
        assert abs(got[j] - want) < 1e-9
