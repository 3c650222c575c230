import random
from collections import Counter

from skyloom.llm.linededup import dedup_lines


def test_boilerplate_goes(spark):
    # b.com has four pages: a line on all of them goes, own lines stay.
    rows = [(i, "a.com", f"Menu  \nown {i}\n\n menu") for i in range(10)] + [(100 + i, "b.com", f"Menu\nother {i}") for i in range(4)]
    rows += [(200 + i, None, "Foot\nFoot" if i % 2 else f"x{i}") for i in range(12)] + [(300, "a.com", None), (301, "a.com", ""), (302, "a.com", "Menu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 lines", "'h' host", "1 `__host`", "2 N_Dropped", "3 c1")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in dedup_lines(docs).collect()}
    assert dedup_lines(docs).columns == ["doc_id", "source", "text", "lines", "host", "__host", "c1", "n_dropped"]
    want = {i: (f"own {i}\n", 2) for i in range(0)}
    want |= {i: (f"own {i}\n\n menu", 1) for i in range(10)}
    want |= {100 + i: (f"other {i}", 1) for i in range(4)}
    want |= {200 + i: ("", 2) if i % 2 else (f"x{i}", 0) for i in range(12)}
    want |= {300: (None, 0), 301: ("", 0), 302: ("", 1)}
    for i in range(10):  # " menu" is a line of its own on ten of thirteen pages
        want[i] = (f"own {i}\n", 2)
    assert got == want
    assert dedup_lines(docs.where("false")).count() == 0
    assert {r["doc_id"]: r["n_dropped"] for r in dedup_lines(docs, min_pages=5).collect()}[100] == 0


def plain(rows, max_ratio, min_pages):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, seen = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        seen.update({(h, bare(x)) for x in (t or "").split("\n") if bare(x)})
    bad = {k for k, n in seen.items() if n >= min_pages and n > max_ratio * pages[k[0]]}
    out = []
    for d, h, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if (h, bare(x)) not in bad]
        out.append((d, "\n".join(kept) if t is not None else None, len(lines) - len(kept)))
    return sorted(out, key=str)


def test_long_texts_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, f"h{i % 3}.com" if i % 7 else None, "\n".join(rng.choice(["nav", " nav\t", "own", "", f"l{rng.randrange(9)}", f"x{rng.random()}"]) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(90)]
    rows += [(500, "h0.com", "\n".join(f"long {i}" for i in range(20_000)) + "\nnav"), (501, "h0.com", "word " * 200_000)] + [rows[3]] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for ratio, least in ((0.05, 2), (0.3, 2), (0.3, 20)):
        got = sorted((tuple(r) for r in dedup_lines(docs, max_ratio=ratio, min_pages=least).select("doc_id", "text", "n_dropped").collect()), key=str)
        assert got == plain(rows, ratio, least)
