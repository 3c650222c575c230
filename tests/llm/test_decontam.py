import random

from skyloom.llm import decontam
from skyloom.llm.decontam import Index, words


def vocabulary(rng, n):
    return [f"w{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(n)]


def index_of(items):
    df = {}
    tokens = [words(t) for _, t in items]
    for ws in tokens:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    return Index(items, len(items), sum(map(len, tokens)) / len(items), df, max(map(len, tokens)))


def items_of(rng, n=120):
    return [(i, " ".join(vocabulary(rng, rng.randrange(12, 50))) + ". " + " ".join(vocabulary(rng, rng.randrange(2, 12))) + ".") for i in range(n)]


def test_wand_finds_what_full_scoring_finds(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 4)
    monkeypatch.setattr(decontam, "THRESHOLD", 0.25)
    rng = random.Random(1)
    items = items_of(rng)
    index, some = index_of(items), 0
    for trial in range(120):
        terms = set(vocabulary(rng, 60)) | (set(words(items[trial][1])[: rng.randrange(30)]))
        full = [0.0] * len(items)
        for w in terms & index.docs.keys():
            for d, s in zip(index.docs[w], index.scores[w], strict=True):
                full[d] += s
        want = [d for d, s in enumerate(full) if s >= index.limit[d] - 1e-9]
        assert index.search(sorted(terms)) == want
        some += len(want)
    assert some > 50


def plant(rng):
    items = items_of(rng)
    rows = []
    for i in range(60):
        ws = vocabulary(rng, rng.choice([3, 40, 400, 900]))
        held = []
        if i % 3 == 0:
            held = rng.sample(items, 2 if i % 6 == 0 else 1)
            at = sorted(rng.randrange(len(ws) + 1) for _ in held)
            for k, (_, t) in reversed(list(zip(at, held, strict=True))):
                ws[k:k] = [t.upper() if i % 2 else t.replace(". ", "\n")]
        rows.append((i, " ".join(ws), sorted(k for k, _ in held)))
    return items, rows


def test_planted_items(spark, monkeypatch):
    items, rows = plant(random.Random(2))
    rows += [(100, None, []), (101, "", []), (102, items[5][1].split(". ")[0], [])]
    rows = [(i, t, k) for i, t, k in rows]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(3)] + [(300, " ".join([*vocabulary(random.Random(3), 60_000), items[7][1]]), [7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want array<long>").selectExpr("*", "1 item_id", "2 Item_IDs", "3 found", "4 c0", "5 Text_")
    tests = spark.createDataFrame([*items, (500, None), (501, " ")], "item_id long, text string")
    got = decontam.contamination(docs, tests).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got} == {i: k for i, _, k in rows}
    assert decontam.contamination(docs, tests).columns == ["doc_id", "text", "want", "item_id", "found", "c0", "Text_", "item_ids"]
    assert {r["doc_id"] for r in decontam.clean(docs, tests).collect()} == {r["doc_id"] for r in got if not r["item_ids"]}
    shards = list(decontam.indexes(tests, shard_bytes=2000))
    assert len(shards) > 3 and sum(len(x.ids) for x in shards) == len(items)
    monkeypatch.setattr(decontam, "indexes", lambda items: iter(shards))
    assert sorted(map(tuple, decontam.contamination(docs, tests).select("doc_id", "item_ids").collect()), key=str) == sorted(((r["doc_id"], r["item_ids"]) for r in got), key=str)


def test_shards_do_not_change_the_window(spark, monkeypatch):
    rng = random.Random(6)
    question, answer = "what " + " ".join(f"q{i}" for i in range(20)) + "?", "a1 a2 a3 a4 a5 a6."
    far = question + " " + " ".join(vocabulary(rng, 150)) + " " + answer
    items = [(1, f"{question} {answer}"), (2, " ".join(f"l{i}" for i in range(200)) + ". end of it.")]
    docs = spark.createDataFrame([(1, far)], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    whole, alone = (decontam.contamination(docs, tests).first()["item_ids"], list(decontam.indexes(tests, shard_bytes=10)))
    assert len(alone) == 2
    monkeypatch.setattr(decontam, "indexes", lambda items: iter(alone))
    assert decontam.contamination(docs, tests).first()["item_ids"] == whole


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a b")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "x y. z")], "item_id long, text string")
    assert decontam.clean(docs, tests.where("false")).count() == 2 and decontam.clean(docs.where("false"), tests).count() == 0
    assert decontam.question_and_answer("a b c") == (["a", "b"], ["c"])
