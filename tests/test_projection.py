import math

from pyspark.sql import functions as F

from geomill.operators import projection


def arc(zone, lat, steps=200_000):
    """Length of the meridian from the equator, by Simpson's rule."""
    a, e2 = zone.ellipsoid.axis, zone.ellipsoid.e**2
    f = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = math.radians(lat) / steps
    return h / 3 * math.fsum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(i * h) for i in range(steps + 1))


def test_round_trip_and_known_places(spark):
    zone = projection.zone_of(25832)
    rows = [(9.0 + dx / 4, float(lat)) for dx in range(-14, 15) for lat in (-60, -1, 0, 10, 45, 47.5, 50, 55, 84)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = projection.to_plane("lon", "lat", zone)
    df = df.withColumn("x", x).withColumn("y", y)
    lon, lat = projection.to_degrees("x", "y", zone)
    got = df.withColumn("lon2", lon).withColumn("lat2", lat).collect()
    for r in got:
        assert abs(r.lon - r.lon2) * math.cos(math.radians(r.lat)) < 2e-10 and abs(r.lat - r.lat2) < 2e-10  # 0.02 mm
    by = {(r.lon, r.lat): (r.x, r.y) for r in got}
    for lat_ in (45.0, 50.0, 84.0):
        assert by[9.0, lat_][0] == 500_000 and abs(by[9.0, lat_][1] - 0.9996 * arc(zone, lat_)) < 1e-4
    for side in (-1, 1):  # the edge of a zone on the equator, as published
        assert abs(by[9.0 + 3 * side, 0.0][0] - (500_000 + side * 333_978.557)) < 1e-3 and abs(by[9.0 + 3 * side, 0.0][1]) < 1e-9


def test_maps_are_true_to_angles(spark):
    zone = projection.utm(32)
    h = 1e-6
    df = spark.createDataFrame([(11.5, 48.0)], "lon double, lat double")
    ends = {}
    for name, dx, dy in (("o", 0, 0), ("e", h, 0), ("n", 0, h)):
        x, y = projection.to_plane(F.col("lon") + dx, F.col("lat") + dy, zone)
        ends[name] = df.select(x.alias("x"), y.alias("y")).first()
    e = ends["e"].x - ends["o"].x, ends["e"].y - ends["o"].y
    n = ends["n"].x - ends["o"].x, ends["n"].y - ends["o"].y
    assert abs(e[0] * n[0] + e[1] * n[1]) / math.hypot(*e) / math.hypot(*n) < 1e-6


def test_boxes_by_their_corners(spark):
    box = lambda *b: dict(zip(("x0", "y0", "x1", "y1"), map(float, b)))
    df = spark.createDataFrame([(1, box(500_000, 5_300_000, 510_000, 5_310_000)), (2, box(510_000, 5_310_000, 500_000, 5_300_000)), (3, None)], "k int, b struct<x0:double,y0:double,x1:double,y1:double>")
    got = {r.k: r.d for r in df.select("k", projection.box_to_degrees("b", projection.zone_of(32632)).alias("d")).collect()}
    assert got[2] is None and got[3] is None and abs(got[1].x0 - 9.0) < 1e-12 and 47.8 < got[1].y0 < got[1].y1 < 48.0
