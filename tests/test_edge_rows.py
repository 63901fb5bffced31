"""Only sections of primary roads are copied to the cells about them."""

from geomill.operators import structures


def test_primary_sections_alone_are_copied(spark, monkeypatch):
    rows = [(s, 4.0 * k, 4.0 * k, 3.0 * s, 0.0, 1.0, 1.0, 0.0, float(s), 0.0, 6.0) for s in range(1, 31) for k in range(6)]
    sections = spark.createDataFrame(rows, "spline long, along double, x double, y double, nx double, ny double, tx double, ty double, target double, bank double, width double")
    junctions = spark.createDataFrame([(s, s, True, 1, 10.0) for s in range(2, 31)], "junction long, road long, at_start boolean, primary long, reach double")
    left, inner = [], structures.spatial.within
    monkeypatch.setattr(structures.spatial, "within", lambda a, *rest, **more: left.append(a.count()) or inner(a, *rest, **more))
    got = structures.edge_constraints(sections, junctions).filter("left_edge IS NOT NULL").collect()
    assert left == [6] and got and all(r.level == 1.0 for r in got if r.along == 0)
