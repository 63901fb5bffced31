import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.llm import flatgraph, nearest, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, node int, score double"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "v", 2, 0.5) for i, v in zip(ids, x)], SCHEMA)


def clustered(n=600, seed=4):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, 32)).astype(np.float32)
    x[100:200] = x[100] + 0.12 * draw.standard_normal((100, 32))  # dense
    x[200:210] = x[200]  # exact copies
    x[210:220] = 3 * x[200]  # of another length
    for i in range(220, 300, 2):
        x[i + 1] = x[i] + 0.3 * draw.standard_normal(32)
    return x


def brute_links(x, threshold=0.9):
    u = vectors.units(np.asarray(x, np.float64))
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    label = np.arange(len(u))
    while True:
        new = np.array([min([label[i], *label[s[i]]]) for i in range(len(u))])
        if (new == label).all():
            return s.sum(1), label
        label = new


def check(spark, x):
    got = sorted(flatgraph.near_duplicates(table(spark, x)).collect())
    links, label = brute_links(x)
    assert [r.n_links for r in got] == links.tolist()
    assert [r.component_id for r in got] == label.tolist()
    assert [r.kept for r in got] == (label == np.arange(len(x))).tolist()


def test_links_equal_brute_force(spark):
    check(spark, clustered())


def test_links_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 60)
    monkeypatch.setattr(flatgraph, "BLOCK_ROWS", 50)
    x = clustered(seed=8)
    got = [r.n_links for r in sorted(flatgraph.near_duplicates(table(spark, x)).collect())]
    links, _ = brute_links(x)
    assert (np.array(got) <= links).all() and sum(got) >= 0.999 * links.sum()


def test_exact_cells_replace_a_graph_that_misses_its_recall(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 60)
    monkeypatch.setattr(flatgraph, "BLOCK_ROWS", 50)
    monkeypatch.setattr(flatgraph, "audit", lambda *_: 0.0)
    x = clustered(seed=8)
    got = sorted(flatgraph.near_duplicates(table(spark, x), attempts=1).collect())
    links, label = brute_links(x)
    assert [r.n_links for r in got] == links.tolist() and [r.component_id for r in got] == label.tolist()


def test_null_ids_join_only_what_they_link(spark):
    got = flatgraph.near_duplicates(table(spark, [[1, 0, 0], [0, 1, 0], [1, 0, 0.01], [0, 1, 0.01], [0, 0, 1], [0, 0.01, 1], [0.01, 0, 1]], [1, 2, None, None, None, 9, 7])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 1, 1), (0, 1, 2), (0, 2, 7), (1, 1, 1), (2, 1, 2), (7, 2, 7), (9, 2, 7)]


def test_audit_counts_missed_links(spark):
    rows = [(1, 1, 1, [1.0, 0.0]), (2, 2, 2, [1.0, 0.01]), (3, 3, 1, [0.0, 1.0])]
    nodes = spark.createDataFrame(rows, "node long, id long, many long, vec array<double>")
    all_ = spark.createDataFrame([(1, 2), (2, 1)], "node long, hits long")
    assert flatgraph.audit(nodes, all_, 0.9) == 1.0
    assert flatgraph.audit(nodes, all_.filter("node = 1"), 0.9) == pytest.approx(2 / 3)


ODD = [None, [], [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [2, 0], [2, 0], [1, 0], [0, 1]]


def test_odd_vectors_have_no_link(spark):
    got = sorted(flatgraph.near_duplicates(table(spark, ODD)).collect())
    assert [r.n_links for r in got] == [0] * 7 + [2, 2, 2, 0]
    assert [r.component_id for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 10]
    nulls = flatgraph.near_duplicates(table(spark, [[1, 0], [1, 0]], [None, 5])).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in nulls} == {(None, 1, None), (5, 1, 5)} or {(r.vec_id, r.n_links) for r in nulls} == {(None, 1), (5, 1)}
    assert flatgraph.near_duplicates(table(spark, [])).count() == 0
    assert flatgraph.near_duplicates(table(spark, ODD[:3])).count() == 3


def brute_nearest(x, ids, asked, k):
    u = vectors.units(np.asarray(x, np.float64))
    out = []
    for q in asked:
        s = vectors.cosines(u, np.broadcast_to(u[ids.index(q)], u.shape))
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out += [(q, r + 1, ids[i]) for r, i in enumerate(order)]
    return out


def test_nearest_equals_brute_force(spark):
    x = clustered(900)
    ids = list(range(900))
    got = sorted(tuple(r)[:3] for r in nearest.nearest(table(spark, x), F.col("vec_id") % 50 == 0).collect())
    want = brute_nearest(x, ids, range(0, 900, 50), 5)
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(want)


def test_nearest_of_odd_vectors_and_ties(spark):
    got = nearest.nearest(table(spark, ODD), F.col("vec_id") >= 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(7, 8), (7, 9), (7, 10), (8, 7), (8, 9), (8, 10), (9, 7), (9, 8), (9, 10), (10, 7), (10, 8), (10, 9)]
    assert [r["rank"] for r in got[:3]] == [1, 2, 3] and got[0].score == pytest.approx(1.0)
    assert nearest.nearest(table(spark, []), F.col("vec_id") >= 0).count() == 0
    assert nearest.nearest(table(spark, ODD[:3]), F.col("vec_id") >= 0).count() == 0


def test_error_bounds_hold():
    draw = np.random.default_rng(2)
    u = vectors.units(draw.standard_normal((2000, 48)))
    turn = nearest.rotation(48, 256, 1)
    code, share, bound = nearest.encode(u, turn, 3.5)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    estimate = (u[:50] @ turn) @ signs.T / (16 * share)
    assert (np.abs(estimate - u[:50] @ u.T) <= bound).mean() > 0.999
