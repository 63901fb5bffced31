import pytest

from geomill.operators import assets


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_reference_chains_are_reached(spark):
    uses = spark.createDataFrame([(i, i + 1) for i in range(53)] + [(100, 101)], "user long, used long").coalesce(1)
    got = assets.unused_fixpoint(uses, spark.createDataFrame([(0,)], "key long")).collect()
    assert {r.key for r in got} == {100, 101}


def test_deep_chains_keep_every_node(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 35)] + [(50, 51), (51, 50)]
    got = {r.key: (r.depth, r.path) for r in assets.ancestry(spark.createDataFrame(rows, "k long, p long").coalesce(1), "k", "p").collect()}
    assert got == {i: (i, list(range(i + 1))) for i in range(35)}


def test_few_edges_take_few_stages_and_many_give_the_same(spark, monkeypatch):
    from geomill.operators import graph

    rows = [(i, i + 1) for i in range(-40, 40) if i % 9] + [(7, -30), (100, 100), (None, 3), (2**62, -(2**62))]
    edges = spark.createDataFrame(rows, "a long, b long")
    marks, real = [], graph._mark
    monkeypatch.setattr(graph, "_mark", lambda e: marks.append(1) or real(e))
    got = sorted(tuple(r) for r in graph.connected_components(edges).collect())
    assert len(marks) == 1  # no rounds
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    assert sorted(tuple(r) for r in graph.connected_components(edges).collect()) == got and len(marks) > 2
    root = {n: n for e in rows if None not in e and e[0] != e[1] for n in e}
    for _ in rows:
        for a, b in rows:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == sorted(root.items())
    assert graph.connected_components(edges.filter("a = 100")).count() == 0
