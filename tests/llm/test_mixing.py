import math
from collections import Counter, defaultdict

import pytest

from skyloom.llm import mixing


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 tokens", "'w' weight")


ROWS = [(i, "big", "w " * (5 + i % 7)) for i in range(300)] + [(1000 + i, "mid", "x y z") for i in range(60)] + [(2000 + i, None, "a\tb") for i in range(20)] + [(3000, "one", None)]


def test_exponent_meets_its_target(spark):
    shares = [0.7, 0.2, 0.07, 0.03]
    df = spark.createDataFrame([(x,) for x in shares], "share double")
    a = mixing.exponent(df, repeats=3.0)
    assert (0.7 / 0.03) ** (1 - a) == pytest.approx(3.0, rel=1e-4)
    a = mixing.exponent(df, entropy=0.9)
    z = sum(x**a for x in shares)
    assert -sum(x**a / z * math.log(x**a / z) for x in shares) == pytest.approx(0.9 * math.log(4), rel=1e-4)
    assert mixing.exponent(df, repeats=100.0) == 0.0 and mixing.exponent(df, repeats=1.0) == 1.0 and mixing.exponent(df, entropy=0.1) == 1.0


def test_whole_blocks_and_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    got = mixing.mixed(docs_of(spark, ROWS)).collect()
    times = Counter(r["doc_id"] for r in got)
    assert set(times) == {r[0] for r in ROWS}
    n = {d: max(1, len((t or "").split())) for d, _, t in ROWS}
    tokens = Counter()
    drawn, weight = Counter(), {}
    for d, s, _ in ROWS:
        tokens[s] += n[d]
    for r in got:
        drawn[r["source"]] += n[r["doc_id"]]
        weight[r["source"]] = r["weight"]
    assert sum(weight.values()) == pytest.approx(1)
    assert all(times[d] == 1 for d, s, _ in ROWS if s == "big") and drawn["one"] / tokens["one"] == 2
    for s in tokens:
        assert drawn[s] / drawn["big"] == pytest.approx(weight[s] / weight["big"], rel=0.2)
    blocks = defaultdict(list)
    for r in sorted(got, key=lambda r: r["mix_at"]):
        blocks[r["source"], r["block"]].append(r["doc_id"])
    assert all(len(x) == len(set(x)) for x in blocks.values()) and blocks["big", 0] != sorted(blocks["big", 0])


def test_budget_cuts(spark):
    rows = [(i, "s", "a b c d") for i in range(100)]
    got = mixing.mixed(docs_of(spark, rows), budget=250.0).collect()
    assert len(got) in (62, 63) and len({r["doc_id"] for r in got}) == len(got)
    assert mixing.mixed(docs_of(spark, rows).where("false")).count() == 0
    assert mixing.mixed(docs_of(spark, rows)).columns == ["doc_id", "source", "text", "tokens", "weight", "block", "mix_at"]


def test_many_rows_of_one_id_odd_names_and_long_texts(spark, monkeypatch):
    rows = [(None, "a", "x y z")] * 400 + [(7, "a", "p q")] * 300 + [(i, "a", f"w{i} " * (i % 5)) for i in range(1000, 1200)] + [(1, "b", "long " * 200_000), (2, "b", ""), (3, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 `__n`", "2 Block", "3 n", "4 hash", "5 part")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    plain = mixing.mixed(docs).collect()
    monkeypatch.setattr(mixing, "HOT", 50)
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "source", "text", "__n", "n", "hash", "part", "weight", "block", "mix_at"]
    got = got.collect()
    times = lambda rows: Counter((r["doc_id"], r["source"], r["block"]) for r in rows)
    assert times(got) == times(plain)
    for s in "ab":
        own = sorted((r["mix_at"], max(1, len((r["text"] or "").split()))) for r in got if r["source"] == s)
        tokens = sum(n for _, n in own) / own[-1][0] if own[-1][0] else 0
        total = sum(max(1, len((t or "").split())) for _, x, t in rows if x == s)
        budget = own[1][1] and next(n / (b - a) for (a, n), (b, _) in zip(own, own[1:], strict=False))
        # Rows follow one another without gap or overlap: each stands where the tokens before it end.
        assert all(a + n / budget == pytest.approx(b, abs=1e-9) for (a, n), (b, _) in zip(own, own[1:], strict=False)) and budget >= total - 1e-6 and tokens
