import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import ann, lsh


def exact(rows, k=ann.K):
    keep = {(i, tuple(np.asarray(v, float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in keep:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(np.square(np.subtract(x, y)).sum())), i) for i, y in keep if i != q and len(x) == len(y))
            out[q] = near[:k]
    return out


def recall(got, want):
    hits = sum(len({i for _, i in want[q]} & {r["vec_id"] for r in got if r["query_id"] == q}) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.5 * rng.standard_normal(24)]) for i in range(2500)]
    rows += [(3000 + i, rows[100][1]) for i in range(40)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    want = exact(rows)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    for r in got:
        assert r["score"] == pytest.approx(np.sqrt(np.square(vectors[r["query_id"]] - vectors[r["vec_id"]]).sum()), abs=1e-12)
    for q in want:
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: (r["score"], r["vec_id"]))] == list(range(1, len(own) + 1))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == list(range(3000, 3010))


def test_recall_where_the_sample_is_a_part(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 7)
    monkeypatch.setattr(ann, "BLOCK", 500)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 32))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.5 * rng.standard_normal(32)]) for i in range(3 * ann.SAMPLE)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert recall(got, exact(rows)) >= 0.93


def test_slots_widen_until_the_sample_is_found(monkeypatch):
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "WIDTH", 0.05)
    sample = np.random.default_rng(1).standard_normal((400, 12))
    hashes, sets = ann.fit(sample)
    assert len(sets) == 1 and hashes.width > 1


def test_odd_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, -0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 4.0]), (9, []), (10, [2.0, 0.0]), (11, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 id", "2 key")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 10, 1.0), (200, 1, 8, 1.0), (200, 2, 11, pytest.approx(np.sqrt(14.0)))]
    assert ann.nearest(table.where("false"), F.lit(True)).count() == 0


def test_probe_order():
    sets = lsh.probe_sets(3, 27)
    assert sets[0] == () and sets[1] == (0,) and len(sets) == len(set(sets)) == 27
    hashes = lsh.Hashes(4, 2, 3, 1.0)
    x = np.random.default_rng(0).standard_normal((5, 4))
    keys = lsh.probe_keys(hashes, x, sets)
    assert (keys[:, :, 0] == hashes.keys(hashes.slots(x)[0])).all() and all(len(set(k)) == 27 for row in keys for k in row)
