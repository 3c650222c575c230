"""The clash queries over the whole orientation table (test_queries.py holds them against their SQL)."""

from skyloom.queries import catalog
from skyloom.queries.fixtures import CELLS, ORIENTATIONS


def test_every_orientation_is_looked_at(spark):
    keys = catalog.QUERIES["face_keys"](spark, "").groupBy("row").count().collect()
    assert {r["row"]: r["count"] for r in keys} == dict.fromkeys(range(len(ORIENTATIONS)), 6 * CELLS**2)
    assert {r["b"] for r in catalog.QUERIES["clashing_rows"](spark, "").collect()} - set(range(12))
    tiles = catalog.QUERIES["neighbour_tiles_clash"](spark, "").collect()
    assert max(max(map(abs, (r["ax"], r["ay"], r["az"]))) for r in tiles) == 3
