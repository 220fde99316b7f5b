"""Every query with a DuckDB statement gives the same rows at the smallest scale."""

import os

import duckdb
import pytest

from aeroquilt.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(table):
    table = table.select(sorted(table.column_names))
    return sorted(map(repr, zip(*[c.to_pylist() for c in table.columns], strict=True)))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


#: A few of each kind; TEST_ALL=1 runs all.
SOME = ("terrain_summary", "erode", "median_filter", "pyramid_pushpull", "contours", "utm_forward", "knn_pairs", "hamming_mutual", "match_components", "triangulate", "celsius", "las_quantise")


@pytest.mark.parametrize("name", sorted(catalogue.SQL) if os.environ.get("TEST_ALL") else SOME)
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toArrow()
    want = duck.sql(catalogue.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
