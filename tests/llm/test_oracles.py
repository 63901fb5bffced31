"""The queries that SQL can state against DuckDB, over whole small tables."""

import os

import duckdb
import pandas as pd
import pytest

from geomill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLES[name]).df()
    keys = {"op11_decontamination": ["doc_id"], "op12_search": ["item_id", "rank"], "op13_codes": ["vec_id"]}[name]
    order = lambda d: d[sorted(d.columns)].sort_values(keys).reset_index(drop=True)
    assert len(got) > 0
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
