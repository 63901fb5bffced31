import math

import numpy as np
import pytest

from geomill.operators import series


def test_butterworth_keeps_constants_and_damps_high_frequencies():
    assert np.allclose(series.butterworth(np.full(50, 7.0), 9, 4), 7.0)
    t = np.arange(400)
    low, high = np.sin(t / 60), np.sin(t * 2.5)
    out = series.butterworth(low + high, 11, 3)
    assert np.abs(out - low)[40:-40].max() < 0.05
    assert (series.butterworth(low, 1, 3) == low).all()


@pytest.mark.parametrize("order", [1, 2, 3, 8])
def test_sections_have_gain_one_at_zero(order):
    gain = math.prod((b0 + b1 + b2) / (1 + a1 + a2) for b0, b1, b2, a1, a2 in series._sections(order, 0.1))
    assert gain == pytest.approx(1.0) and len(series._sections(order, 0.1)) == (order + 1) // 2


def test_simplify_and_thin():
    p = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float)
    assert series.simplify(p, 0.1).tolist() == [True, False, True, True, True]
    assert series.thin(p, 1.5).tolist() == [True, False, True, True, True]
    assert series.simplify(p[:1], 0.1).tolist() == [True]


def test_each_series_joins_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(1 + 9 * (k % 3))], "k int, i int")
        got = series.each_series(rows, ["k"], ["i"], lambda s: s.assign(n=len(s), at=range(len(s))), "k int, i int, n int, at int").collect()
        assert len(got) == rows.count() and all(r.n == 1 + 9 * (r.k % 3) and r.at == r.i for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slope_limit_holds_everywhere(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 100, 3, 50, 51, 0])], "k int, i int, e double")
    got = [r.limited for r in series.limit_slope(rows, "e", ["k"], ["i"], 10.0).orderBy("i").collect()]
    assert got == [0.0, 10.0, 3.0, 13.0, 10.0, 0.0]
