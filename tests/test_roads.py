import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.operators import roads, splines


def scalar_slope(t, v, i):
    """Slope at point i of the smooth curve through (t, v), one number at a time."""
    n = len(t)
    if n == 2:
        return (v[1] - v[0]) / (t[1] - t[0])
    if n < 5:
        a, b = [[0.0] * n for _ in range(n)], [0.0] * n
        d = [(v[k + 1] - v[k]) / (t[k + 1] - t[k]) for k in range(n - 1)]
        h = [t[k + 1] - t[k] for k in range(n - 1)]
        a[0][0], a[0][1], b[0] = 2, 1, 3 * d[0]
        a[-1][-1], a[-1][-2], b[-1] = 2, 1, 3 * d[-1]
        # the second derivative is the same on both sides: natural cubic in slopes, each side divided by its step
        a[0] = [x / h[0] for x in a[0]]
        b[0] /= h[0]
        a[-1] = [x / h[-1] for x in a[-1]]
        b[-1] /= h[-1]
        for k in range(1, n - 1):
            a[k][k - 1], a[k][k], a[k][k + 1] = 1 / h[k - 1], 2 / h[k - 1] + 2 / h[k], 1 / h[k]
            b[k] = 3 * (d[k - 1] / h[k - 1] + d[k] / h[k])
        return np.linalg.solve(np.array(a), np.array(b))[i]
    d = lambda k: (v[k + 1] - v[k]) / (t[k + 1] - t[k])
    if i in (0, 1) or i >= n - 2:
        k = 0 if i < 2 else n - 3
        p = np.polyfit(np.array(t[k : k + 3]) - t[k], v[k : k + 3], 2)
        return 2 * p[0] * (t[i] - t[k]) + p[1]
    a, b = abs(d(i - 1) - d(i - 2)), abs(d(i + 1) - d(i))
    if a + b < 1e-14:
        return ((t[i + 1] - t[i]) * d(i - 1) + (t[i] - t[i - 1]) * d(i)) / (t[i + 1] - t[i - 1])
    return (b * d(i - 1) + a * d(i)) / (a + b)


def scalar_samples(x, y, interval, smooth):
    t = [0.0]
    for k in range(1, len(x)):
        t.append(t[-1] + math.hypot(x[k] - x[k - 1], y[k] - y[k - 1]))
    at = [k * interval for k in range(int(t[-1] // interval) + 1)]
    if t[-1] - at[-1] > 0.01:
        at.append(t[-1])
    out = []
    for s in at:
        k = max(j for j in range(len(t) - 1) if t[j] <= s or j == 0)
        h, u, place, slope = t[k + 1] - t[k], s - t[k], [], []
        for v in (x, y):
            d = (v[k + 1] - v[k]) / h
            a, b = (scalar_slope(t, v, k), scalar_slope(t, v, k + 1)) if smooth else (d, d)
            c2, c3 = (3 * d - 2 * a - b) / h, (a + b - 2 * d) / h**2
            place.append(v[k] + a * u + c2 * u**2 + c3 * u**3)
            slope.append(a + 2 * c2 * u + 3 * c3 * u**2)
        n = math.hypot(*slope)
        out.append((s, *place, *(np.array(slope) / n if n > 0.001 else (1.0, 0.0))))
    return out


@pytest.mark.parametrize("smooth", [True, False])
def test_samples_equal_a_scalar_version(spark, smooth, monkeypatch):
    monkeypatch.setattr(splines, "SAMPLES_AT_ONCE", 40)
    draw = np.random.default_rng(2)
    lines = [draw.uniform(-50, 50, (n, 2)) for n in (2, 3, 4, 5, 6, 9, 30)] + [np.column_stack([np.arange(8) * 3.0, np.zeros(8)])]
    near = np.repeat(lines[4], 2, axis=0) + np.tile([[0, 0], [0.001, 0]], (len(lines[4]), 1))
    rows = [(i, x[:, 0].tolist(), x[:, 1].tolist()) for i, x in enumerate([*lines, near])]
    rows += [(100, [1.0], [1.0]), (101, [], []), (102, None, None), (103, [0.0, 0.5], [0.0, 0.0]), (104, [3.0, 3.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "path long, xs array<double>, ys array<double>").repartition(3)
    got = {}
    for r in splines.spline_samples(df, 2.5, smooth).orderBy("path", "step").collect():
        got.setdefault(r.path, []).append((r.distance, r.x, r.y, r.tx, r.ty))
        assert (r.nx, r.ny) == (r.ty, -r.tx)
    assert set(got) == set(range(9))
    for i, x in enumerate(lines):
        want = scalar_samples(x[:, 0].tolist(), x[:, 1].tolist(), 2.5, smooth)
        assert len(want) == len(got[i])
        np.testing.assert_allclose(got[i], want, atol=1e-9, rtol=0)
    np.testing.assert_allclose(got[8], got[4], atol=1e-9)  # points within a centimetre go


def test_clip_to_square():
    clip = lambda *p: tuple(np.round(v, 6).tolist() if isinstance(v, np.ndarray) else v for v in splines.clip_to_square(*np.array(p, float).T, 10))
    assert clip((1, 1), (2, 2)) == ([1, 2], [1, 2], False, False)
    assert clip((-5, 5), (5, 5), (6, 6)) == ([5, 6], [5, 6], True, False)
    assert clip((5, 5), (15, 5), (5, 6)) == ([5, 5, 5], [5, 5, 6], False, False)
    assert clip((-5, 5), (-1, 5), (15, 5), (5, 5)) == ([10, 5], [5, 5], True, False)
    assert clip((-5, -5), (-1, -5)) == ([], [], True, True)


CLASSES = ["residential", "residential", "tertiary", "tertiary_link", "service", None]


def network(seed, n=80, grid=6):
    """Ways between nodes of a jittered grid; some tips have no node, one-way roads and roundabouts among them."""
    draw = random.Random(seed)
    node = {(i, j): (100 * i + j + 1, 40.0 * i + draw.uniform(-6, 6), 40.0 * j + draw.uniform(-6, 6)) for i in range(grid) for j in range(grid)}
    rows = []
    for k in range(n):
        at = draw.choice(list(node))
        steps = draw.choice([1, 1, 2, 3])
        path = [at]
        for _ in range(steps):
            i, j = path[-1]
            path.append(draw.choice([p for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if p in node and p not in path[-2:]]))
        xs, ys = [node[p][1] for p in path], [node[p][2] for p in path]
        if draw.random() < 0.4:  # a short stub before the first node
            xs, ys = [xs[0] + (xs[1] - xs[0]) * 0.1 * d for d in (0, 1, 2)], [ys[0] + (ys[1] - ys[0]) * 0.1 * d for d in (0, 1, 2)]
            ends = [node[path[0]][0], 5000 + k]
        else:
            ends = [node[path[0]][0], node[path[-1]][0]]
        loose = draw.random()
        if loose < 0.15:
            ends[0], xs[0] = None, xs[0] + 0.3
        elif loose < 0.3:
            ends[1], ys[-1] = None, ys[-1] - 0.3
        rows.append(dict(path=1000 + k, ord=[draw.randrange(50), k], way=1000 + k, start_node=ends[0], end_node=ends[1], xs=xs, ys=ys, highway=draw.choice(CLASSES), junction="roundabout" if draw.random() < 0.05 else None, oneway=draw.choice([None, None, "yes", "-1", "no"])))
    return rows


LINE = "path long, ord array<long>, way long, start_node long, end_node long, xs array<double>, ys array<double>, highway string, junction string, oneway string"
MEMBERS = "relation long, relation_order long, member_order long, way long, role string"


def line_rows(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in LINE.split(", ")) for r in rows], LINE)


def cosine(a, b, c):
    u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
    p, q = u[0] * u[0] + u[1] * u[1], v[0] * v[0] + v[1] * v[1]
    return None if p < 1e-8 or q < 1e-8 else (u[0] * v[0] + u[1] * v[1]) / math.sqrt(p * q)


def look(points):
    run = 0.0
    for a, b in zip(points, points[1:]):
        run += math.dist(a, b)
        if run >= 30:
            t = (run - 30) / math.dist(a, b)
            return b[0] + (a[0] - b[0]) * t, b[1] + (a[1] - b[1]) * t
    return points[-1]


def merged(p, q, s, t):
    """Line p joined with q at p's end s and q's end t."""
    other = q["points"][::-1] if s == t else q["points"]
    points = p["points"] + other[1:] if s else other + p["points"][1:]
    ends = list(p["ends"])
    ends[s] = q["ends"][1 - t]
    return {**p, "points": points, "ends": ends, "parts": p["parts"] + q["parts"]}


def brute_join(rows, relations, tolerance=1.0):
    """All pairs of all lines again after each join."""
    valence = {}
    for r in rows:
        for e in (r["start_node"], r["end_node"]):
            valence[e] = valence.get(e, 0) + 1
    group = lambda r: {"tertiary_link": "tertiary"}.get(r["highway"], r["highway"])
    work = [{**r, "points": list(zip(r["xs"], r["ys"])), "ends": [r["start_node"], r["end_node"]], "parts": [r["path"]]} for r in sorted(rows, key=lambda r: (r["ord"], r["path"]))]
    while True:
        best = None
        for i, p in enumerate(work):
            for j in range(i + 1, len(work)):
                q = work[j]
                if group(p) and group(q) and group(p) != group(q) or "roundabout" in (p["junction"], q["junction"]):
                    continue
                bonus = 0.5 if relations.get(p["way"], set()) & relations.get(q["way"], set()) else 0
                for s, t in ((1, 0), (1, 1), (0, 1), (0, 0)):
                    if s == t and q["oneway"] in ("yes", "true", "1"):
                        continue
                    a, b = p["ends"][s], q["ends"][t]
                    shared = a is not None and a == b
                    own, its = p["points"][::-1] if s else p["points"], q["points"][::-1] if t else q["points"]
                    if not shared and (a is not None and b is not None or math.dist(own[0], its[0]) > tolerance):
                        continue
                    c = cosine(look(own), own[0], look(its))
                    if c is None or shared and valence[a] >= 3 and c <= 0:
                        continue
                    score = c + 0.5 * shared + bonus - 0.001 * (s == t)
                    if best is None or score > best[0]:
                        best = score, i, j, s, t
        if not best:
            return sorted((w["parts"][0], sorted(w["parts"]), [tuple(p) for p in w["points"]], *w["ends"]) for w in work)
        _, i, j, s, t = best
        work[i] = merged(work[i], work[j], s, t)
        del work[j]


def relations_of(members):
    out = {}
    for relation, _, _, way, _ in members:
        out.setdefault(way, set()).add(relation)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joins_equal_all_pairs(spark, seed):
    rows = network(seed)
    draw = random.Random(seed)
    members = [(r, r, k, 1000 + draw.randrange(80), "") for r in range(6) for k in range(8)]
    lines = line_rows(spark, rows).repartition(3)
    parts = roads.connected(lines, 1.0, spark.createDataFrame(members, MEMBERS))
    whole = {r.joined: (list(zip(r.xs, r.ys)), r.start_node, r.end_node) for r in roads.put_together(lines, parts).collect()}
    by = {}
    for r in parts.collect():
        by.setdefault(r.joined, []).append(r.path)
    got = sorted((j, sorted(p), [tuple(q) for q in whole[j][0]], *whole[j][1:]) for j, p in by.items())
    want = brute_join(rows, relations_of(members))
    assert got == want and len(got) < 70


def brute_relations(rows, members):
    """A scan over relations in order, then over each one's members."""
    by_way, consumed, out = {r["way"]: r for r in rows}, set(), []
    orders = sorted({m[1] for m in members})
    for order in orders:
        own = [(m[3], m[4]) for m in sorted(members, key=lambda m: m[2]) if m[1] == order and m[3] not in consumed and m[3] in by_way]
        chains = []
        for way, role in own:
            r = by_way[way]
            new = {"way": way, "points": list(zip(r["xs"], r["ys"])), "ends": [r["start_node"], r["end_node"]], "oneway": r["oneway"], "parts": [way]}
            joined = None
            if chains:
                p = chains[-1]
                both = all(x["oneway"] in ("yes", "true", "1", "-1") for x in (p, new))
                for s, t in ([(1, 1), (1, 0)] if role == "backward" else [(1, 0), (1, 1)]) + [(0, 1), (0, 0)]:
                    a, b = p["ends"][s], new["ends"][t]
                    mine, its = p["points"][::-1] if s else p["points"], new["points"][::-1] if t else new["points"]
                    if a is None or a != b:
                        continue
                    c = cosine(mine[1], mine[0], its[1]) if s else cosine(its[1], its[0], mine[1])
                    if both and c is not None and c < -0.7:
                        continue
                    joined = merged(p, new, s, t)
                    break
            if joined:
                chains[-1] = joined
            else:
                chains.append(new)
        out += chains
        consumed |= {w for w, _ in own}
    return sorted((c["way"], sorted(c["parts"]), c["points"], *c["ends"]) for c in out), [r["way"] for r in rows if r["way"] not in consumed]


def test_relations_equal_a_scan(spark):
    rows = network(7, n=150, grid=4)
    draw = random.Random(5)
    nodes = {}
    for r in rows:
        for e in (r["start_node"], r["end_node"]):
            nodes.setdefault(e, []).append(r)
    members = []
    for rel in range(30):  # walks along common nodes, so that chains form
        way = draw.choice(rows)
        for k in range(12):
            members.append((rel, 50 - rel, k, way["way"], draw.choice(["", "forward", "backward", None])))
            way = draw.choice([w for w in nodes[way["end_node"]] if w["way"] not in [m[3] for m in members if m[0] == rel]] or rows)
            if way["way"] in [m[3] for m in members if m[0] == rel]:
                break
    lines = line_rows(spark, rows).repartition(3)
    got = roads.assembled_by_relations(lines, spark.createDataFrame(members, MEMBERS)).collect()
    parts = roads.relation_chains(lines, spark.createDataFrame(members, MEMBERS)).collect()
    want, rest = brute_relations(rows, members)
    by = {}
    for r in parts:
        by.setdefault(r.joined, []).append(r.path)
    chains = sorted((r.path, sorted(by[r.path]), list(zip(r.xs, r.ys)), r.start_node, r.end_node) for r in got if r.ord[0] == 0)
    assert chains == want and any(len(c[1]) > 2 for c in chains)
    assert sorted(r.path for r in got if r.ord[0] == 1) == sorted(rest)


def test_ways_to_splines(spark):
    box, size, pixel = (10.0, 50.0, 10.1, 50.1), 100, 2.0
    lon, lat = lambda x: 10.0 + x / 2000, lambda y: 50.0 + y / 2000
    ways = [
        (1, [0], [lon(20), lon(60)], [lat(50), lat(50)], [11, 12], "residential", None, None, False),
        (2, [1], [lon(60), lon(100), lon(100)], [lat(50), lat(50), lat(50)], [12, 13, 13], "residential", None, None, False),
        (3, [2], [lon(100), lon(140)], [lat(50), lat(52)], [13, 14], "residential", None, None, True),
        (4, [3], [lon(-40), lon(50), lon(50.2)], [lat(80), lat(80), lat(80)], [20, 21, 22], "service", None, None, False),
        (5, [4], [lon(-40), lon(-20)], [lat(80), lat(80)], [30, 31], "service", None, None, False),
        (6, [5], [lon(150)], [lat(80)], [30], "service", None, None, False),
    ]
    df = spark.createDataFrame(ways, "way long, ord array<long>, lons array<double>, lats array<double>, nodes array<long>, highway string, junction string, oneway string, bridge boolean")
    lines = {r.way: r for r in roads.terrain_lines(df, box, size, pixel).collect()}
    assert set(lines) == {1, 2, 3, 4} and len(lines[2].xs) == 2
    assert (lines[4].start_node, lines[4].end_node) == (None, 22) and [round(x, 6) for x in lines[4].xs] == [50, 50.2]
    got = roads.road_splines(df, box, size, pixel, 10.0, apart=F.col("bridge")).groupBy("path").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect()
    assert sorted((r.path, r.n, round(r.d, 3)) for r in got) == [(1, 9, 80.0), (3, 6, 40.05)]


def test_empty_tables(spark):
    none = line_rows(spark, [])
    members = spark.createDataFrame([], MEMBERS)
    assert roads.assembled_by_relations(none, members).count() == 0
    assert roads.connected(none, 1.0, members).count() == 0
