"""Every registered engine query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from skyloom.queries import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
#: Slow ones are left to the driver's own comparison.
FAST = [n for n in catalog.SQL if n not in ("beam_is_part_of_sky", "consecutive_shells", "pix_round_trip")]


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(catalog.SQL[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
