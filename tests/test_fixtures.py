"""Fixture views hold all the rows that FIXTURES.md gives them."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from aeroquilt.plans import catalogue, fixtures

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(found):
    return sorted(map(repr, found))


def test_sparse_cells_are_those_of_the_document(spark, duck):
    text = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()
    given = re.search(r"^-- sparse_cells\n(.*?);$", text, re.M | re.S)[1]
    want = rows(duck.sql(given).fetchall())
    assert rows(map(tuple, fixtures.view(spark, DATA, "sparse_cells").select("row", "col", "z").collect())) == want
    assert rows(duck.sql(f"with {fixtures.ctes('sparse_cells')} select row, col, z from sparse_cells").fetchall()) == want


def test_pairs_and_marks_come_from_all_orders(spark, duck):
    orders = duck.sql("select o_orderkey, o_custkey from orders").fetchall()
    want = {tuple(sorted((c % 601, o % 673))) for o, c in orders if c % 601 != o % 673}
    assert rows(map(tuple, fixtures.view(spark, DATA, "sparse_pairs").select("i", "j").collect())) == rows(want)
    marks = fixtures.view(spark, DATA, "gcp_errors").select("name", "marks").collect()
    assert rows(map(tuple, marks)) == rows((f"G{c % 40}", 1 + o % 4) for o, c in orders)


def test_every_camera_looks_at_every_cell(spark, duck):
    seen = catalogue.QUERIES["visibility"](spark, DATA)
    count = lambda name: duck.sql(f"with {fixtures.ctes(name)} select count(*) from {name}").fetchall()[0][0]
    assert seen.select("cam_id").distinct().count() == count("cameras") > 6
    assert seen.count() == count("cameras") * count("cells")
