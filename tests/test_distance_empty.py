"""Distances where no pixel is masked."""

from geomill.plans import all_queries


def test_no_masked_pixel_gives_no_rows(spark, tmp_path):
    rows = [(k, k % 5, 1.0) for k in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert all_queries()[0]["distance_field"](spark, str(tmp_path)).count() == 0
