"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import kind, normal

# One or two per family; tools/check_oracle.py runs all of them.
NAMES = ["geojson_parse", "median_fill", "region_lookup", "hotspots", "bands", "historical_30d", "sequence_stats",
         "shock_roles", "numeric_summary", "corr_spearman", "interval_lags", "b_value_interp", "daily_features",
         "token_ngrams", "frequent_itemsets", "sequence_windows", "threshold_metrics", "roc_points"]


@pytest.fixture(scope="module")
def con(request):
    connection = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 130


def test_entry_returns_regions(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    got = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: kind(t) for c, t in got.dtypes} == kinds
    columns = sorted(names)
    want = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    rows = sorted(tuple(normal(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == want
