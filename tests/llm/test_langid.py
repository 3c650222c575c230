import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import langid, queries

SYLLABLES = {"de": "ung sch ein der ich keit lich für".split(), "en": "the ing tion and er was of sh".split(), "fr": "eau que les ère tion oux ment des".split()}


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.choice([1, 2, 3]))) for _ in range(n))


def rows(n=40):
    rng = random.Random(3)
    return [(i, prose(rng, lang), lang, f"{'a' if i % 3 else 'b'}.host{i % 4}.com") for i, lang in enumerate(sorted(SYLLABLES) * n)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string"))


def test_held_out_accuracy(spark, model):
    rng = random.Random(99)
    held = [(i, prose(rng, lang, 12), None, None, lang) for i, lang in enumerate(sorted(SYLLABLES) * 40)]
    docs = spark.createDataFrame(held, "doc_id long, text string, lang string, source string, truth string")
    got = langid.identify(docs, model).collect()
    assert sum(r["language"] == r["truth"] for r in got) >= 0.95 * len(got) and sum(r["accepted"] for r in got) >= 0.95 * len(got)


def test_evidence_is_fused(spark, model):
    data = [(1, "xq", "de", None, None), (2, "xq", None, None, "http://h.com/fr/1"), (3, "xq", None, None, "https://h.de/x"), (4, "12 34 !!", "de", None, None), (5, None, "de", None, None), (6, "the the the", "zz", None, None), (7, "zqzxkj wvqxzk kjxqz " * 30, "en", None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, url string").selectExpr("*", "1 fit", "2 prior")
    got = {r["doc_id"]: r for r in langid.identify(docs, model, url="url").collect()}
    assert [got[i]["language"] for i in (1, 2, 3, 6)] == ["de", "fr", "de", "en"]
    assert not got[4]["accepted"] and not got[5]["accepted"] and not got[7]["accepted"] and got[6]["accepted"]
    assert langid.identify(docs, model).columns == [*docs.columns, "language", "posterior", "accepted"]
    odd = docs.selectExpr("*", "'x' Language", "1 E", "2 v", "3 Text_", "4 c2")
    assert langid.identify(odd, model).columns == [*docs.columns, "E", "v", "Text_", "c2", "language", "posterior", "accepted"]
    long = spark.createDataFrame([(1, "the ing tion " * 100_000, None, None), (1, "the ing tion " * 100_000, None, None), (2, "", "de", None)], "doc_id long, text string, lang string, source string")
    assert sorted((r["doc_id"], r["language"], r["accepted"]) for r in langid.identify(long, model).collect()) == [(1, "en", True)] * 2 + [(2, "de", False)]


def test_host_priors_are_smoothed(spark):
    own = [("a.x.com", [1.0, 0.0])] * 30 + [("b.x.com", [0.0, 1.0])] + [(None, [0.5, 0.5])]
    got = {r["host"]: list(r["prior"]) for r in langid.host_priors(spark.createDataFrame(own, "host string, own array<double>"), F.col("host"), 2).collect()}
    whole = [(30.5 + 1) / 34, (1.5 + 1) / 34]
    parent = [(30 + 20 * whole[0]) / 51, (1 + 20 * whole[1]) / 51]
    assert got["a.x.com"] == pytest.approx([(30 + 20 * parent[0]) / 50, 20 * parent[1] / 50])
    assert got["b.x.com"] == pytest.approx([20 * parent[0] / 21, (1 + 20 * parent[1]) / 21])
    assert got[None] == pytest.approx([(0.5 + 20 * whole[0]) / 21, (0.5 + 20 * whole[1]) / 21])


def test_empty(spark, model):
    docs = spark.createDataFrame(rows(1), "doc_id long, text string, lang string, source string")
    assert langid.identify(docs.where("false"), model).count() == 0
    nothing = langid.train(docs.where("false"))
    assert [r["accepted"] for r in langid.identify(docs, nothing).collect()] == [False] * 3


def test_regions_of_codes_and_host_suffixes_count(spark):
    named = spark.createDataFrame([(i, t, {"de": "de-AT", "en": "eng", "fr": "fr_CA"}[x], s) for i, t, x, s in rows()], "doc_id long, text string, lang string, source string")
    model = langid.train(named)
    assert model.languages == ["de", "eng", "fr"]
    data = [(1, "xq", "DE-ch", None), (2, "xq", "eng", None), (3, "xq", None, "news.example.fr")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["language"] for r in langid.identify(docs, model).collect()} == {1: "de", 2: "eng", 3: "fr"}


def test_pages_have_every_evidence(spark, tmp_path):
    page = lambda text, lang="": f'<!DOCTYPE html><HTML class="x"{lang}><body><article><h1>{text[:20]}</h1><p>{text}</p></article></body></html>'
    data = [(i, f"http://a.host{i % 4}.com/x", page(t, f" lang='{x}'")) for i, t, x, _ in rows()]
    data += [(1000, "http://other.com/fr/1", page("xq")), (1001, None, page("xq", ' lang="de-AT"')), (1002, "http://h.com", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    assert [tuple(r) for r in langid.page_texts(pages).where("page_id in (0, 1001)").select("page_id", "lang", "host").orderBy("page_id").collect()] == [(0, "de", "a.host0.com"), (1001, "de-AT", None)]
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in queries.op6_page_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(data) and all(got[i]["language"] == x for i, _, x, _ in rows())
    assert got[1000]["language"] == "fr" and got[1001]["language"] == "de" and not got[1002]["accepted"]


def test_fitting_counts_whole_texts_of_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    data = [(i, "abc " * 2000 + f"word {i} zq", "aa") for i in range(9)] + [(20, "other text that is long enough", "bb")] * 3 + [(30, "rare label of this document", "cc"), (31, "x", "dd"), (32, None, "aa"), (33, "no label at all, but a text", " ")]
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    counts = {g: np.exp(x) for g, x in model.log.items()}
    size = len(counts) + 1
    # Five of the nine texts of aa, each with 2000 times " ab"; the three equal rows of bb once.
    total = 5 * (2000 * 3 + 4 + 2)
    assert counts[" ab"][0] == pytest.approx((5 * 2000 + 1) / (total + size)) and counts["zq "][0] == pytest.approx(6 / (total + size))
    assert counts["tha"][1] == pytest.approx(2 / (len("".join("other text that is long enough".split())) + size))


def test_equal_evidence_goes_to_the_first_language(spark, model):
    docs = spark.createDataFrame([(i, "xq", None, f"h{i}.net") for i in range(3)], "doc_id long, text string, lang string, source string")
    got = langid.identify(docs, langid.Model(["aa", "bb"], {"xq ": np.ones(2)})).collect()
    assert [r["language"] for r in got] == ["aa"] * 3 and [r["posterior"] for r in got] == pytest.approx([0.5] * 3)


def plain_identify(data, model):
    """{id: (language, posterior, accepted)} of rows (id, text, lang, source)."""
    names, n = model.languages, len(model.languages)
    lls, fits, sums = {}, {}, {}
    soft = lambda x: np.exp(x - max(x)) / sum(np.exp(x - max(x)))
    for i, text, _, host in data:
        words = [w for w in langid._LETTERS.findall((text or "").lower()) for w in langid.grams(w)]
        ll = sum((model.log.get(w, model.unseen) for w in words), np.zeros(n))
        lls[i], fits[i] = np.maximum(langid.TEMPER * (ll - max(ll)), -langid.MOST), max(ll) / len(words) if words else None
        if words:
            sums[host] = sums.get(host, np.zeros(n)) + soft(lls[i])
    parent = lambda h: ".".join(h.split(".")[-2:]) if h and h.count(".") > 1 else ""
    total = sum(sums.values())
    whole = (total + 1) / (sum(total) + n)
    out = {}
    for i, _, lang, host in data:
        own, over = sums.get(host), sum((v for h, v in sums.items() if parent(h) == parent(host)), np.zeros(n))
        middle = (over + langid.PRIOR * whole) / (sum(over) + langid.PRIOR) if parent(host) else whole
        prior = np.full(n, 1 / n) if own is None else (own + langid.PRIOR * middle) / (sum(own) + langid.PRIOR)
        vote = np.log([langid.TRUST if lang == x else (1 - langid.TRUST) / (n - 1) for x in names]) if lang in names else np.zeros(n)
        post = soft(lls[i] + vote + np.log(prior))
        out[i] = (names[int(np.argmax(post))], max(post), fits[i] is not None and max(post) >= langid.MIN_POSTERIOR and fits[i] >= model.usual - langid.MIN_FIT)
    return out


def test_against_plain_version_as_there_is_no_sql(spark, model):
    rng = random.Random(8)
    data = [(i, prose(rng, x, rng.choice([1, 2, 30])), rng.choice(["de", "en", None, "zz"]), rng.choice(["a.x.com", "b.x.com", "y.com", None])) for i, x in enumerate(sorted(SYLLABLES) * 30)]
    data += [(900, None, "de", "a.x.com"), (901, "12", None, "new.com"), (902, "zqzxkj wvqxzk " * 30, "en", "y.com")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), model).collect()}
    want = plain_identify(data, model)
    assert set(got) == set(want)
    for i, (language, posterior, accepted) in want.items():
        assert (got[i]["language"], got[i]["accepted"]) == (language, accepted) and got[i]["posterior"] == pytest.approx(posterior)
    assert all(isinstance(s, str) for s in queries.SQL.values()) and "op6_language_id" not in queries.SQL
