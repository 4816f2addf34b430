"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from stackroom.plans import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name].run(spark, FOLDER).toArrow()
    assert got.num_columns > 0
    if QUERIES[name].sql is not None:
        assert compare(got, duck.sql(QUERIES[name].sql).to_arrow_table()) == ""
