import math
import random

import numpy as np
from pyspark.sql import functions as F

from geomill.operators import rings, splines

WAY = "way long, ord array<long>, lons array<double>, lats array<double>, nodes array<long>, highway string, junction string, oneway string"
WIDE = 111_320.0


def at(lon, lat, metres, degrees):
    return round(lon + metres * math.cos(math.radians(degrees)) / WIDE / math.cos(math.radians(lat)), 9), round(lat + metres * math.sin(math.radians(degrees)) / 110_574.0, 9)


def town(seed):
    """Three rings, one of three ways, one of two given end to end the other way, one of one; roads that meet one ring, two, none, or run along one."""
    draw = random.Random(seed)
    centres = [(9.0, 48.0, 20), (9.0009, 48.0, 25), (9.01, 48.02, 15)]
    circle = [[at(lon, lat, r, 360 / 24 * k) for k in range(25)] for lon, lat, r in centres]
    ways, name = [], iter(range(1, 1000))

    def add(points, junction=None, oneway=None, highway="residential"):
        i = next(name)
        ways.append((i, [draw.randrange(5), i], [p[0] for p in points], [p[1] for p in points], [i * 100 + k for k in range(len(points))], highway, junction, oneway))

    for part in (circle[0][:9], circle[0][16:], circle[0][8:17], circle[1][12:], circle[1][:13][::-1], circle[2]):
        add(part, "Roundabout")
    add(circle[2][3:6])
    for _ in range(60):
        c = draw.randrange(3)
        lon, lat, r = centres[c]
        k = draw.randrange(24)
        out = [at(lon, lat, r + d, 15 * k + draw.uniform(-3, 3)) for d in range(60, 5, -12)]
        points = out[: draw.randrange(5)] + [circle[c][(k + j) % 24] for j in range(draw.choice([0, 1, 1, 1, 2, 3]))]
        if draw.random() < 0.4:
            points += [at(lon, lat, r + d, 15 * (k + 3)) for d in (8, 30, 50)][: draw.randrange(4)]
        if draw.random() < 0.3 and c < 2:  # on to the other of the two near rings
            points += [circle[1 - c][draw.randrange(24)], at(*centres[1 - c][:2], centres[1 - c][2] + 40, draw.randrange(360))]
        if draw.random() < 0.2:
            points = [at(lon, lat, r + 1.2, 15 * k + 7)] + points
        if draw.random() < 0.5:
            points = points[::-1]
        if len(points) >= 2:
            add(points, None, draw.choice([None, "yes", "-1", "no"]), draw.choice(["residential", "residential", None]))
    return ways


def brute_trim(ways, found):
    """Roads against rings one after the other, over copies of the vertex lists."""
    out = {}
    rows = sorted(found, key=lambda r: r.ord)
    for way, _, lons, lats, nodes, highway, junction, _ in ways:
        if junction or highway is None:
            continue
        points, cuts = list(zip(lons, lats, range(len(lons)))), []
        for ring in rows:
            places = {(round(x / 1e-6), round(y / 1e-6)) for x, y in zip(ring.lons, ring.lats)}
            mask = []
            for x, y, _ in points:
                d = math.hypot((x - ring.lon) * WIDE * math.cos(math.radians(ring.lat)), (y - ring.lat) * 110_574.0)
                mask.append((round(x / 1e-6), round(y / 1e-6)) in places or abs(d - ring.radius) < 2)
            if all(mask):
                points = []
                break
            turns = [(i, True) for i in range(1, len(points)) if mask[i] and not mask[i - 1]] + [(i - 1, False) for i in range(1, len(points)) if mask[i - 1] and not mask[i]]
            if not turns:
                continue
            turns.sort(key=lambda t: (t[0] + (not t[1]), t[1]))
            size = len(points)
            if len(turns) == 1:
                i, enters = turns[0]
                kept = points[: i + 1] if enters else points[i:]
            else:
                entry = next(t for t in turns if t[1])[0]
                leave = next(t for t in reversed(turns) if not t[1])[0]
                post = size - leave if leave else 0
                enters = entry + 1 >= post
                i = entry if enters else leave
                kept = points[: entry + 1] if enters else points[leave:]
            if len(kept) < size:
                cuts.append((ring.ring, points[i][2]))
            points = kept
        out[way] = [p[2] for p in points], cuts
    return out


def test_rings_trims_and_connections(spark):
    for seed in (1, 2, 3):
        ways = town(seed)
        df = spark.createDataFrame(ways, WAY).repartition(3)
        found = rings.rings(df).persist()
        got = sorted(found.collect())
        assert [(sorted(r.ways), len(r.lons)) for r in sorted(got, key=lambda r: min(r.ways))] == [([1, 2, 3], 25), ([4, 5], 25), ([6], 25)]
        for r, (lon, lat, radius) in zip(sorted(got, key=lambda r: min(r.ways)), [(9.0, 48.0, 20), (9.0009, 48.0, 25), (9.01, 48.02, 15)]):
            assert abs(r.radius - radius) < 1e-2 and abs(r.lon - lon) < 1e-7 and abs(r.lat - lat) < 1e-7 and (r.lons[0], r.lats[0]) == (r.lons[-1], r.lats[-1])
        want = brute_trim(ways, got)
        plan = rings.trims(df, found).persist()
        there = {r.way: r for r in plan.collect()}
        for way, (left, cuts) in want.items():
            row = there.get(way)
            if row is None:
                assert len(left) == len(next(w for w in ways if w[0] == way)[2]) and not cuts
            elif not left:
                assert row.kept == 0
            else:
                assert list(range(row.start, row.start + row.kept)) == left and [tuple(c) for c in row.cuts] == cuts
        assert sum(1 for left, c in want.values() if len(c) > 1) >= 1 and sum(not left for left, _ in want.values()) >= 1
        kept = {r.way: r for r in rings.trimmed(df, plan).collect()}
        assert set(kept) == {w[0] for w in ways} - {w for w, (left, _) in want.items() if not left}
        for w in ways:
            if w[0] in kept and w[0] in want:
                assert kept[w[0]].nodes == [w[4][i] for i in want[w[0]][0]] and kept[w[0]].lons == [w[2][i] for i in want[w[0]][0]]
        brute = set()
        for r in got:
            places = {(round(x / 1e-6), round(y / 1e-6)) for x, y in zip(r.lons, r.lats)}
            for way, _, lons, lats, _, highway, junction, oneway in ways:
                seen = set()
                for i, (x, y) in enumerate(zip(lons, lats)):
                    if junction or highway is None or (round(x / 1e-6), round(y / 1e-6)) not in places:
                        continue
                    j = min(range(len(r.lons)), key=lambda k: ((x - r.lons[k]) ** 2 + (y - r.lats[k]) ** 2, k))
                    if j in seen:
                        continue
                    seen.add(j)
                    direction = "both"
                    if oneway in ("yes", "-1") and i in (0, len(lons) - 1):
                        direction = "exit" if (i == 0) == (oneway == "yes") else "entry"
                    brute.add((r.ring, way, j, i, round(math.degrees(math.atan2(r.lats[j] - r.lat, r.lons[j] - r.lon)) % 360, 6), direction))
        assert {(r.ring, r.way, r.ring_index, r["at"], round(r.angle, 6), r.direction) for r in rings.connections(df, found).collect()} == brute and len(brute) > 20


def test_ring_splines(spark):
    df = spark.createDataFrame(town(1), WAY)
    found = rings.rings(df)
    box = (8.99, 47.99, 9.02, 48.03)
    lines = {r.ring: r for r in rings.ring_lines(found, box, 1000, 2.0).collect()}
    assert len(lines) == 3 and all(len(r.xs) == 25 and abs(r.xs[0] - r.xs[-1]) < 0.1 for r in lines.values())
    rows = rings.ring_splines(found, box, 1000, 2.0, 5.0).groupBy("ring").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect()
    for r in rows:
        x, y = np.array(lines[r.ring].xs), np.array(lines[r.ring].ys)
        length = splines.arc_lengths(x, y, np.array([0]))[-1]
        assert abs(r.d - length) < 1e-9 and r.n == int(length // 5) + 1 + (length % 5 > 0.01)
    small = rings.ring_lines(found, (9.0, 47.99, 9.02, 48.03), 1000, 2.0).collect()  # through the middle of the first ring
    assert all(min(r.xs) >= 0 for r in small) and len(small) == 3


def test_stubs_give_way_to_their_road(spark):
    lon, lat, r = 9.0, 48.0, 20
    circle = [at(lon, lat, r, 15 * k) for k in range(25)]
    ring_nodes = [100 + k % 24 for k in range(25)]
    gate = [at(lon, lat, 45, d) for d in (30, 120, 210, 300)]
    far = [at(lon, lat, 90, d) for d in (30, 120, 210, 300)]

    def way(i, points, nodes, highway, junction=None):
        return (i, [i], [p[0] for p in points], [p[1] for p in points], nodes, highway, junction, None)

    ways = [
        way(1, circle, ring_nodes, "secondary", "roundabout"),
        way(2, [circle[1], gate[0]], [101, 500], "cycleway"), way(3, [gate[0], circle[3]], [500, 103], "path"),  # two stubs of one road
        way(4, [gate[0], far[0]], [500, 600], "tertiary"), way(5, [far[0], gate[0]], [600, 500], "service"),
        way(6, [circle[8], gate[1]], [108, 501], "Footway"), way(7, [far[1], gate[1]], [601, 501], "residential"), way(8, [far[1], gate[1]], [601, 501], "residential"),
        way(9, [circle[14], gate[2]], [114, 502], "path"),  # no road there
        way(10, [circle[20], circle[22]], [120, 122], "footway"),  # both ends on the ring
        way(11, [circle[20], at(lon, lat, 400, 300)], [120, 503], "footway"), way(12, [at(lon, lat, 400, 300), at(lon, lat, 500, 300)], [503, 603], "primary"),  # too long
    ]
    df = spark.createDataFrame(ways, WAY).repartition(3)
    plan = rings.stub_parents(df, rings.rings(df)).persist()
    got = {r.node: (list(r.stubs), r.parent, r.at_start, r.ring_node, (r.lon, r.lat)) for r in plan.collect()}
    assert got == {500: ([2, 3], 4, True, 102, circle[2]), 501: ([6], 7, False, 108, circle[8])}
    left = {r.way: r for r in rings.without_stubs(df, plan).collect()}
    assert set(left) == {1, 4, 5, 7, 8, 9, 10, 11, 12}
    assert left[4].nodes == [102, 500, 600] and (left[4].lons[0], left[4].lats[0]) == circle[2] and left[7].nodes == [601, 501, 108] and left[8].nodes == [601, 501]


def test_odd_rings(spark):
    ways = [(1, [1], [9.0, 9.1], [48.0, 48.0], [1, 2], "residential", "roundabout", None), (2, [2], [9.3, 9.4, 9.4], [48.0, 48.0, 48.1], [3, 4, 5], None, "roundabout", None), (3, [3], [], [], [], "service", "roundabout", None)]
    got = rings.rings(spark.createDataFrame(ways, WAY)).collect()
    assert [(r.ring, len(r.lons)) for r in got] == [(2, 4)]
    none = spark.createDataFrame([], WAY)
    assert rings.rings(none).count() == 0 and rings.trims(none, rings.rings(none)).count() == 0 and rings.connections(none, rings.rings(none)).count() == 0
