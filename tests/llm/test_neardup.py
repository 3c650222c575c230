import random

import numpy as np

import corpus_pipeline
from skyloom.llm import graph, neardup

from . import brute


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, source, n):
    out = list(source)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


def corpus():
    rng = random.Random(7)
    rows = []
    for _ in range(25):
        rows.append(words(rng, rng.choice([3, 8, 60, 200])))
    hub = words(rng, 150)
    rows += [edited(rng, hub, rng.choice([1, 2, 3, 4, 5, 6, 8])) for _ in range(80)]
    rows.append(hub)
    chain = words(rng, 120)
    for _ in range(12):
        chain = edited(rng, chain, 2)
        rows.append(chain)
    passage = words(rng, 60)
    rows += [words(rng, rng.choice([5, 15, 30])) + passage + words(rng, 10) for _ in range(40)]
    texts = [" ".join(r) for r in rows]
    texts += [texts[3]] * 6 + [texts[30].upper(), "", None, " \n", "one", "ONE", "one two", "a b c d e f g", "b c d e f g h", "a b c d e f g h"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * i, texts[k]) for i, k in enumerate(order)]


def check(got, rows):
    want = brute.component_of(rows)
    n = {d: len(brute.shingle_set(t)) for d, t in rows}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (n[d], c, c == d) for d, c in want.items()}


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' id", "1 key", "2 sketch")
    check(neardup.near_duplicates(docs).collect(), rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1500)
    rows = corpus()
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_nulls_ties_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "A b  c"), (6, None)], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (5, 1, 4, False), (5, 1, 4, False), (4, 1, 4, True), (6, 0, 6, True)], key=str)
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def recrawls():
    rng = random.Random(11)
    a, b, c = (words(rng, 100) for _ in range(3))
    rows = [(5, a), (5, b), (9, edited(rng, a, 2)), (8, edited(rng, b, 2)), (3, edited(rng, b, 2)), (7, c), (7, []), (6, edited(rng, c, 2)), (7, c), (12, words(rng, 50)), (12, words(rng, 50)), (13, [])]
    return [(d, " ".join(w)) for d, w in rows]


def test_texts_that_share_an_id(spark):
    rows = recrawls()
    want, n = brute.component_of(rows), {t: len(brute.shingle_set(t)) for _, t in rows}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((d, n[t], want[d], want[d] == d) for d, t in rows)


def test_the_stage_keeps_each_text_that_shares_an_id(spark):
    rows = recrawls()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    # 5's first text (with 9's), 3's copy of its second, 6's copy of 7's, both of 12, and the empty ones of 7 and 13.
    assert sorted(map(tuple, got)) == sorted(rows[i] for i in (0, 4, 7, 9, 10, 6, 11))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 4000, np.uint64)
    a, b = pool[:1000], pool[100:1100]
    assert (neardup.merged(neardup.registers(a), neardup.registers(b)) == neardup.registers(np.union1d(a, b))).all()
    sketch = lambda x: neardup.registers(x)[None]
    n = np.array([1000.0])
    assert neardup.likely(sketch(a), sketch(b), n, n)[0]
    assert not neardup.likely(sketch(a), sketch(pool[600:1600]), n, n)[0]
    same = (neardup.registers(a) == neardup.registers(b)).mean()
    assert abs(same - 900 / 1100) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)} | {299: 299, 300: 299}
