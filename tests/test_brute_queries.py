"""Queries without SQL against straight loops over the same rows."""

import math

import duckdb
import numpy as np
import pytest

from geomill.operators import raster, series, spatial
from geomill.plans import all_queries

QUERIES, _ = all_queries()


@pytest.fixture(scope="module")
def orders(sf_dir):
    rows = duckdb.sql(f"SELECT o_custkey, o_orderkey, o_totalprice FROM '{sf_dir}/orders.parquet' ORDER BY o_custkey, o_orderdate, o_orderkey").fetchall()
    out = {}
    for c, k, v in rows:
        out.setdefault(c, []).append((k, float(v)))
    return out


def test_simplified_lines(spark, sf_dir, orders):
    def keep(p, a, b):
        """Which of the points strictly between a and b stay."""
        if b - a < 2:
            return set()
        (x0, y0), (x1, y1) = p[a], p[b]
        length = math.hypot(x1 - x0, y1 - y0)
        away = [math.hypot(x - x0, y - y0) if length < 1e-12 else abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / length for x, y in p[a + 1 : b]]
        i = a + 1 + max(range(len(away)), key=lambda k: (away[k], -k))
        return {i} | keep(p, a, i) | keep(p, i, b) if max(away) > 150 else set()

    want = set()
    for c, rows in orders.items():
        p = [(float(k % 1000), v % 977) for k, v in rows]
        want |= {(c, rows[i][0]) for i in {0, len(p) - 1} | keep(p, 0, len(p) - 1)}
    assert {tuple(r) for r in QUERIES["simplified_lines"](spark, sf_dir).select("o_custkey", "o_orderkey").collect()} == want


def test_butterworth_filtered(spark, sf_dir, orders):
    def low_pass(v, cut, order):
        """The filter of a pass there and back, by the bilinear transform of the analogue poles."""
        k, y = math.tan(math.pi * cut), list(v)
        sections = [(1, 2 * math.sin(math.pi * (2 * i + 1) / (2 * order))) for i in range(order // 2)] + [(0, 1)] * (order % 2)
        for quadratic, damp in sections:
            if quadratic:
                n = 1 + damp * k + k * k
                b, a = (k * k / n, 2 * k * k / n, k * k / n), (2 * (k * k - 1) / n, (1 - damp * k + k * k) / n)
            else:
                b, a = (k / (1 + k), k / (1 + k), 0.0), ((k - 1) / (k + 1), 0.0)
            for _ in range(2):
                out = []
                for i, x in enumerate(y):
                    x1, x2 = (y[i - j] if i >= j else y[0] for j in (1, 2))
                    y1, y2 = (out[i - j] if i >= j else y[0] for j in (1, 2))
                    out.append(b[0] * x + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2)
                y = out[::-1]
        return y

    got = {r.o_orderkey: r.filtered for r in QUERIES["butterworth_filtered"](spark, sf_dir).collect()}
    n = 0
    for rows in orders.values():
        want = low_pass([v for _, v in rows], 1 / 5, 3) if len(rows) >= 3 else [v for _, v in rows]
        for (k, _), w in zip(rows, want):
            assert abs(got[k] - w) < 1e-3 + 1e-9 * abs(w)
            n += len(rows) >= 3
    assert n > 300


def test_polygons_with_holes_against_every_pixel():
    draw = np.random.default_rng(5)
    for _ in range(20):
        outer, inner = draw.uniform(0, 30, (7, 2)), draw.uniform(8, 20, (4, 2))
        xs, ys = np.concatenate([outer[:, 0], [np.nan], inner[:, 0]]), np.concatenate([outer[:, 1], [np.nan], inner[:, 1]])
        got = {tuple(p) for p in raster.polygon_pixels(xs, ys, 25).tolist()}
        want = set()
        for px in range(25):
            for py in range(25):
                crossings = 0
                for ring in (outer, inner):
                    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
                        if (y1 > py + 0.5) != (y2 > py + 0.5) and px + 0.5 >= x1 + (py + 0.5 - y1) / (y2 - y1) * (x2 - x1):
                            crossings += 1
                if crossings % 2:
                    want.add((px, py))
        assert got == want


def test_clipped_lines_against_many_samples():
    draw = np.random.default_rng(6)
    for _ in range(50):
        p = draw.uniform(-5, 15, (6, 2))
        got = spatial.clip_line(p, 10.0)
        dense = np.concatenate([a + (b - a) * np.linspace(0, 1, 400)[:, None] for a, b in zip(p[:-1], p[1:])])
        inside = dense[((dense >= 0) & (dense <= 10)).all(1)]
        assert ((got >= -1e-9) & (got <= 10 + 1e-9)).all()
        for q in inside[::29]:
            steps = [abs((b - a)[0] * (q - a)[1] - (b - a)[1] * (q - a)[0]) / max(1e-12, np.hypot(*(b - a))) for a, b in zip(got[:-1], got[1:])]
            assert min(steps, default=1) < 1e-6


def test_thinned_points_against_a_scan():
    draw = np.random.default_rng(7)
    p = draw.uniform(0, 10, (200, 2))
    last, want = p[0], [True] + [False] * 199
    for i in range(1, 200):
        if math.dist(p[i], last) >= 3:
            want[i], last = True, p[i]
    want[-1] = True
    assert series.thin(p, 3.0).tolist() == want


def test_rings_of_shuffled_segments():
    draw = np.random.default_rng(8)
    corners = draw.uniform(0, 10, (30, 2))
    ring = np.concatenate([corners, corners[:1]])
    cuts = [0, 4, 5, 11, 20, 30]
    parts = [ring[a : b + 1][:: draw.choice([1, -1])] for a, b in zip(cuts, cuts[1:])]
    other = np.array([[50, 0], [51, 0], [51, 1], [50, 0]], float)
    open_ = np.array([[80, 0], [81, 0]], float)
    got = spatial.assemble_rings([parts[i] for i in (3, 1, 4)] + [other] + [parts[i] for i in (0, 2)] + [open_])
    assert [len(r) for r in got] == [31, 4] and {tuple(p) for p in got[0]} == {tuple(p) for p in corners} and (got[0][0] == got[0][-1]).all()
