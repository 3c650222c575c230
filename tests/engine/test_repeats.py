"""The replica checks over their whole reach (test_queries.py holds the queries against their SQL)."""

import pytest

from skyloom.operators import repeats

COPIES = "cell int, snap int, nx int, ny int, nz int, layer int, row int, x double, y double, z double"


def test_reach_covers_the_line_of_sight_and_the_next_snapshot(spark):
    rows = [(1, 70, 0, 0, 0, -1, 0, 500.0, 0.0, 0.0), (1, 71, 1, 0, 0, -1, 1, 1400.0, 0.0, 0.0), (1, 73, 3, 0, 0, -1, 2, 2000.0, 0.0, 0.0), (2, 70, 0, 0, 0, -1, 0, 500.0, 0.0, 0.0)]
    copies = spark.createDataFrame(rows, COPIES)
    pairs = repeats.close_pairs(copies, 125.0, 1000.0, angle=0.1).collect()
    assert [(r["a_snap"], r["b_snap"], r["separation"], r["line_of_sight"]) for r in pairs] == [(70, 71, 900.0, True)]
    got = {(r["cell"], r["snap"]): r["closest"] for r in repeats.closest_copy(copies, 125.0, 1000.0).collect()}
    assert got == {(1, 70): 900.0, (1, 71): 900.0, (1, 73): None, (2, 70): None}
    assert repeats.search_radius(125.0, 1000.0) == pytest.approx(1216.506351)
    assert repeats.search_radius(125.0, 1000.0, 10.0, 700.0) == 700.0
