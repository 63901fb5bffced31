"""Steps that solve many small groups, and groups that are large."""

import random
import time

import numpy as np
import pyarrow as pa

from geomill.operators import graph, rings, splines


def test_small_groups_share_a_call(spark):
    rows = spark.range(2000).selectExpr("IF(id % 7 = 0, NULL, id DIV 4) AS k", "id AS v").repartition(5)

    def whole(t):
        return pa.table({"calls": pa.array([t.num_rows], pa.int64()), "keys": pa.array([t.column("k").to_pylist()], pa.list_(pa.int64()))})

    calls = graph.whole_groups(rows, "k", whole, "calls long, keys array<long>").collect()
    assert sum(r.calls for r in calls) == 2000 and len(calls) < 40
    seen = [k for r in calls for k in set(r["keys"])]
    assert len(seen) == len(set(seen)) == 501

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # groups cross batches
    try:
        got = graph.each_group(rows, "k", lambda g: [(g[0]["k"], sum(r["v"] for r in g))], "k long, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(2000):
        k = None if i % 7 == 0 else i // 4
        want[k] = want.get(k, 0) + i
    assert len(got) == len(want) and {r.k: r.s for r in got} == want


def test_plain_equals_pylist():
    for a in (pa.array([1, None, 3]), pa.array([[1, 2], None, [], [None, 3]]), pa.array([{"x": 1.5, "y": None}, None, {"x": 2.0, "y": [1]}]), pa.array([True, None]), pa.array([[{"x": 1.0}], []])):
        assert graph.plain(a) == a.to_pylist() and graph.plain(a[1:]) == a[1:].to_pylist()


def brute_order(lines):
    ends = [(p[0], p[-1]) if len(p) > 1 else () for p in lines]
    order, left = [0], list(range(1, len(lines)))
    while True:
        before = len(order)
        for i in list(left):
            if any((np.abs(a - b) < rings.SAME_PLACE).all() for j in order for a in ends[i] for b in ends[j]):
                order.append(i)
                left.remove(i)
        if len(order) == before:
            return order


def test_ring_order_equals_passes_and_takes_long_rings():
    draw = random.Random(5)
    for _ in range(60):
        place = [(9 + i * 1e-4 + draw.choice([0, 4e-7]), 48.0) for i in range(9)]
        lines = [np.array([draw.choice(place) for _ in range(draw.choice([1, 2, 2, 3]))]) for _ in range(draw.randrange(1, 14))]
        assert rings.ring_order(lines) == brute_order(lines)
    n = 3000
    circle = np.column_stack([9 + np.cos(np.arange(n + 1) * 2 * np.pi / n), 48 + np.sin(np.arange(n + 1) * 2 * np.pi / n)])
    lines = [circle[i : i + 2] for i in range(n)][::-1]
    began = time.time()
    assert len(rings.ring_order(lines)) == n
    assert len(rings.assemble_ring(lines)) == n + 1
    assert time.time() - began < 5


def test_repeats_of_many_lines_at_once():
    draw = np.random.default_rng(3)
    lines = [np.round(draw.uniform(0, 1, (k, 2)), 1) for k in (0, 1, 2, 5, 9, 30, 1, 0)]
    x, y = np.concatenate(lines).T
    size = np.array([len(p) for p in lines])
    got = splines.without_repeats_each(x, y, np.cumsum(size) - size, 0.15)
    want = np.concatenate([splines.without_repeats(*p.T, 0.15) if len(p) > 1 else np.zeros(len(p), bool) for p in lines])
    assert (got == want).all()
