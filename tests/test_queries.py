"""Every registered query gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from coneflow import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Without rows on the smallest tables: few jets pass all cuts there.
EMPTY = {"t02_jets_of_interest"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    got = plans.QUERIES[name](spark, SF)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found or name in EMPTY, "a query without rows checks nothing"
    if name in plans.SQL:
        cursor = oracle.execute(plans.SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert found == rows(names, cursor.fetchall())
    else:
        assert len(got.columns) == len(set(got.columns))
