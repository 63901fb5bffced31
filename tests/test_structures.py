"""Crossings, ends of curves and prefix sums against brute force on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from geomill.operators import graph, paths, structures


def test_prefix_sums_over_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), rng.randrange(9)) for i in range(300)]
    got = structures.numbered(spark.createDataFrame(rows, "k long, p long, n long"), [F.desc("p"), F.asc("k")], "n", "before").collect()
    total, want = 0, {}
    for k, _, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[k], total = total, total + n
    assert {r.k: r.before for r in got} == want


def test_first_apart_equals_a_scan(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() * 3, rng.random() * 3) for i in range(400)] + [(400 + i, 1.0, 1.0) for i in range(50)]
    rng.shuffle(rows)
    rows = [(i, x, y) for i, (_, x, y) in enumerate(rows)]
    kept = []
    for i, x, y in rows:
        if all(math.hypot(x - a, y - b) >= 0.4 for _, a, b in kept):
            kept.append((i, x, y))
    got = structures.first_apart(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y", 0.4)
    assert sorted(r.k for r in got.collect()) == [k for k, _, _ in kept]


def test_spacing_in_rounds_equals_one_task(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.random() * 3, rng.random() * 3, rng.randrange(40)) for i in range(300)], "k long, x double, y double, pair long")
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(graph, "COMPONENT_ROWS", most)
        found.append(sorted(r.k for r in structures.first_apart(rows, "k", "x", "y", 0.4, once="pair").collect()))
    kept = []
    for r in sorted(rows.collect()):
        if all(math.hypot(r.x - o.x, r.y - o.y) >= 0.4 and r.pair != o.pair for o in kept):
            kept.append(r)
    assert found[0] == found[1] == [r.k for r in kept]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: made.append(1) or real(df))
    line = spark.createDataFrame([(i, i * 0.3, 0.0) for i in range(1000)], "k long, x double, y double")
    got = structures.first_apart(line, "k", "x", "y", 0.4)
    assert sorted(r.k for r in got.collect()) == list(range(0, 1000, 2)) and len(made) <= 20
    made.clear()
    pairs = spark.createDataFrame([(i, "e", i + 1, "e" if i % 2 else "s", 1000.0 - i) for i in range(1000)], "a long, a_tip string, b long, b_tip string, score double")
    assert paths.greedy_matching(pairs).count() > 300 and len(made) <= 20


def brute_crossings(rows, radius, connected):
    """Roads in order, their inner samples in order, near roads in the order in which cells of 50 hold them."""
    roads = sorted({r[0] for r in rows})
    inner = {r: sorted((p, x, y) for s, p, x, y in rows if s == r)[1:-1] for r in roads}
    index = {}
    for r in roads:
        for p, x, y in inner[r]:
            index.setdefault((int(x / 50), int(y / 50)), []).append((r, p, x, y))
    done, places, out = set(), [], []
    for r in roads:
        for p, x, y in inner[r][:: max(1, len(inner[r]) // 100)]:
            near = {}
            for cx in range(int((x - radius) / 50), int((x + radius) / 50) + 1):
                for cy in range(int((y - radius) / 50), int((y + radius) / 50) + 1):
                    for o, q, u, v in index.get((cx, cy), ()):
                        if o != r and math.hypot(u - x, v - y) <= radius:
                            near.setdefault(o, []).append((math.hypot(u - x, v - y), u, v))
            for o, them in near.items():
                pair = min(r, o), max(r, o)
                if pair in done or pair in connected:
                    continue
                _, u, v = min(them, key=lambda t: t[0])
                place = (x + u) / 2, (y + v) / 2
                if any(math.dist(place, q) < radius / 2 for q in places):
                    continue
                done.add(pair)
                places.append(place)
                out.append((*pair, round(place[0], 9), round(place[1], 9)))
    return sorted(out)


def test_mid_crossings_equal_a_scan(spark):
    for seed, many in ((3, 30), (5, 230)):
        rng = random.Random(seed)
        rows = []
        for road in range(14):
            x, y, turn = rng.uniform(30, 120), rng.uniform(30, 120), rng.uniform(0, 7)
            for i in range(many):
                rows.append((road, i, x, y))
                turn += rng.uniform(-0.3, 0.3)
                x, y = x + math.cos(turn) * 2, y + math.sin(turn) * 2
        got = structures.mid_crossings(spark.createDataFrame(rows, "road long, place long, x double, y double"), 6.0, spark.createDataFrame([(1, 0), (2, 5)], "a long, b long"))
        want = brute_crossings(rows, 6.0, {(0, 1), (2, 5)})
        assert sorted((r.a, r.b, round(r.x, 9), round(r.y, 9)) for r in got.collect()) == want and len(want) > 8


def test_curves_merge_along_the_mask_alone(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    curves = spark.createDataFrame([(1, line((0, 0), (4, 0))), (2, line((6, 0), (9, 0))), (3, line((6, 1), (6, 6))), (4, line((9, 9), (9, 12))), (5, line((9, 14), (9, 20)))], "id long, line array<struct<x:double,y:double>>")
    mask = spark.createDataFrame([(x, 0) for x in range(10)] + [(9, y) for y in range(13)], "x long, y long")
    got = structures.merged_curves(curves, "id", "line", 2.5, 30.0, mask).collect()
    assert [(r.a, r.a_tip, r.b, r.b_tip) for r in got] == [(1, "e", 2, "s")]
    assert structures.merged_curves(curves.limit(0), "id", "line", 2.5, 30.0, mask).count() == 0


def surface(p, slope, x, y):
    dx, dy = x - p["x"], y - p["y"]
    lift = (dx * p["nx"] + dy * p["ny"]) * math.sin(p["bank"]) if abs(p["bank"]) > 0.0001 else 0.0
    rise = (dx * p["tx"] + dy * p["ty"]) * slope if abs(slope) > 0.0001 else 0.0
    return p["target"] + lift + rise


def test_edge_constraints_equal_a_scalar_version(spark):
    rng = random.Random(9)
    columns = ("spline", "along", "x", "y", "nx", "ny", "tx", "ty", "target", "bank", "width")
    rows = []
    for spline, (x0, y0, turn, n) in enumerate([(0, 0, 0.1, 60), (30, 2, 1.4, 25), (60, 30, 3.5, 40), (10, 3, 1.6, 8)]):
        for i in range(n):
            t = turn + 0.01 * i
            rows.append(dict(zip(columns, (spline, 1.5 * i, x0 + 1.5 * i * math.cos(turn), y0 + 1.5 * i * math.sin(turn), math.sin(t), -math.cos(t), math.cos(t), math.sin(t), 100 + rng.uniform(-1, 1) + 0.05 * i, rng.choice([0.0, 0.05, -0.08]), 6.0))))
    junctions = [(1, 1, True, 0, 12.0), (2, 2, False, 0, 20.0), (3, 3, True, 0, 9.0), (4, 3, False, 1, 9.0)]
    by = {s: [r for r in rows if r["spline"] == s] for s in range(4)}
    want = {(r["spline"], r["along"]): [r["target"], None, None] for r in rows}
    for _, road, at_start, primary, reach in junctions:
        own, other = by[road], by[primary]
        for r in own:
            away = r["along"] if at_start else own[-1]["along"] - r["along"]
            if away >= reach:
                continue
            j = min(range(len(other)), key=lambda k: (math.hypot(other[k]["x"] - r["x"], other[k]["y"] - r["y"]), k))
            p = other[j]
            if math.hypot(p["x"] - r["x"], p["y"] - r["y"]) > reach + 20:
                continue
            a, b = other[max(0, j - 3)], other[min(len(other) - 1, j + 3)]
            run = math.hypot(b["x"] - a["x"], b["y"] - a["y"])
            slope = (b["target"] - a["target"]) / run if run >= 0.1 else 0.0
            h = r["width"] / 2
            left, right, middle = (surface(p, slope, r["x"] + k * r["nx"] * h, r["y"] + k * r["ny"] * h) for k in (-1, 1, 0))
            state = want[road, r["along"]]
            if away == 0:
                state[:] = [(left + right) / 2, left, right]
                continue
            w = 1 - (1 - math.cos(math.pi * away / reach)) / 2
            if w > 0.001:
                lift = h * math.sin(r["bank"])
                m = state[0]
                state[:] = [middle * w + m * (1 - w), left * w + (m - lift) * (1 - w), right * w + (m + lift) * (1 - w)]
    sections = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "spline long, along double, x double, y double, nx double, ny double, tx double, ty double, target double, bank double, width double").repartition(3)
    made = spark.createDataFrame(junctions, "junction long, road long, at_start boolean, primary long, reach double")
    got = {(r.spline, r.along): (r.level, r.left_edge, r.right_edge) for r in structures.edge_constraints(sections, made).collect()}
    assert set(got) == set(want) and sum(v[1] is not None for v in want.values()) > 25
    for k, v in want.items():
        for a, b in zip(got[k], v):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert structures.edge_constraints(sections, made.limit(0)).filter("level = target AND left_edge IS NULL").count() == len(rows)
