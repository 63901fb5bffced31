"""Rounds of the fixpoint read only rows that can be reached."""

from geomill.operators import assets


def test_rows_that_nothing_uses_are_put_aside(spark, monkeypatch):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (4, None)] + [(100 + i, 900 + i % 3) for i in range(400)]
    seen, inner = [], assets.cut
    monkeypatch.setattr(assets, "cut", lambda df: seen.append(inner(df)) or seen[-1])
    got = assets.unused_fixpoint(spark.createDataFrame(rows, "user long, used long"), spark.createDataFrame([(1,), (77,)], "key long"))
    keys = {k for r in rows for k in r} - {1, 2, 3, 4, None}
    assert {r.key for r in got.collect()} - {None} == keys
    assert any("user" in df.columns for df in seen) and max(df.count() for df in seen) < 20
