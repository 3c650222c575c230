import duckdb
import pytest

from skyloom.llm import urlfilter
from skyloom.llm.urlfilter import RULES

CASES = [
    (1, "https://WWW.Example.com/en/x?q#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "http://example.com/en", "example.com", "/en", "com/", "allow"),
    (4, "http://example.com", "example.com", "", None, "allow"),
    (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://xnet/es/1", "xnet", "/es/1", None, "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, "a://b?c://d/", "b", "", None, "allow"),
    (10, "x://example.org#/en/", "example.org", "", None, "allow"),
    (11, "http://my.www.example.com/en/1\n2", "my.www.example.com", "/en/1\n2", "www.example.com/en/", "allow"),
    (11, "://ÄB.com/", "Äb.com", "/", "com/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u, *_ in CASES], "page_id long, url string, html string").selectExpr("*", "1 host", "2 path")
    got = {tuple(r)[:5] for r in urlfilter.judged_pages(pages).collect()}
    assert got == {(i, h, p, r, v) for i, _, h, p, r, v in CASES}
    assert urlfilter.judged_pages(pages.where("false")).count() == 0


def plain_rank(links, seeds, rounds=300, d=urlfilter.DAMPING):
    total = {}
    for (s, _), w in links.items():
        total[s] = total.get(s, 0) + w
    rank = {h: 1 / len(seeds) for h in seeds}
    for _ in range(rounds):
        new = {h: (1 - d) / len(seeds) for h in seeds}
        for (s, t), w in links.items():
            if s in rank:
                new[t] = new.get(t, 0) + d * rank[s] * w / total[s]
        rank = new
    return rank


def test_distrust_runs_against_links(spark):
    link = lambda *hosts: "".join(f'<p><A class="x" HREF="http://{h}/y">l</a>' for h in hosts)
    rows = [
        (1, "http://bad.net/es/", link("good.com")),
        (2, "http://farm.org/1", link("bad.net", "bad.net") + '<a href="/local">'),
        (3, "http://far.org/1", link("farm.org")),
        (4, "http://good.com/1", link("shop.org", "good.com")),
        (5, "http://shop.org/1", link("bad.net", *["good.com"] * 30)),
        (6, "http://alone.org/1", "<a href='mailto:x'>"),
    ]
    got = {r["page_id"]: r for r in urlfilter.judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    links = {("bad.net", "good.com"): 1, ("farm.org", "bad.net"): 2, ("far.org", "farm.org"): 1, ("good.com", "shop.org"): 1, ("shop.org", "bad.net"): 1, ("shop.org", "good.com"): 30}
    trust, distrust = plain_rank(links, ["good.com"]), plain_rank({(t, s): w for (s, t), w in links.items()}, ["bad.net"])
    for r in got.values():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0), abs=1e-4) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0), abs=1e-4)


def test_hosts_with_both_verdicts_are_seeds(spark):
    rows = [(i, f"http://half.example.com/en/{i}", None) for i in range(3)]
    rows += [(3, "http://half.example.com/ok", '<a href="http://read.org/">'), (4, "http://farm.org/1", '<a href="http://half.example.com/">'), (5, "http://read.org/1", None), (6, "http://half.example.com", None)]
    got = {r["page_id"]: r for r in urlfilter.judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i]["verdict"] for i in (0, 3, 4, 5)} == {0: "block", 3: "allow", 4: "block", 5: "allow"}
    links = {("half.example.com", "read.org"): 1, ("farm.org", "half.example.com"): 1}
    trust, distrust = plain_rank(links, ["half.example.com"]), plain_rank({(t, s): w for (s, t), w in links.items()}, ["half.example.com"])
    for r in got.values():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0), abs=1e-4) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0), abs=1e-4)


def test_a_seed_weighs_its_share_of_urls(spark):
    rows = [(1, "http://a.example.com/en/1", None), (2, "http://a.example.com/2", None), (3, "http://b.net/es/", None)]
    got = {r["host"]: r for r in urlfilter.judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["a.example.com"]["trust"] == pytest.approx(0.15) and got["a.example.com"]["distrust"] == pytest.approx(0.05) and got["b.net"]["distrust"] == pytest.approx(0.1)


def test_links_with_the_scheme_of_the_page(spark):
    html = """<a href="//b.org/x?u=http://c.org/"><a href='HTTP://d.org'><a href="/local//e.org">"""
    pages = spark.createDataFrame([("a.org", html)], "host string, html string")
    assert {r["dst"] for r in urlfilter.host_links(pages).collect()} == {"b.org", "d.org"}


def test_long_chains_and_the_sql(spark, tmp_path):
    """Distrust reaches hosts 18 single links from a blocked one, and the SQL says the same where hosts link."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">l</a>' for h in hosts)
    rows = [(0, "http://c0.net/es/", None), (1, "http://good.com/", link("z.org"))]
    rows += [(100 + i, f"http://c{i}.org/", link("c0.net" if i == 1 else f"c{i - 1}.org")) for i in range(1, 21)]
    rows += [(200 + i, f"http://m{i}.example.com/{'en/' if i % 2 else ''}", link("x.org", "good.com")) for i in range(6)] + [(300, None, None), (301, "http://x.org", '<a href="//y.org/1">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judged_pages(pages).collect()}
    assert got[118] == "block" and got[119] == "allow"
    pages.write.parquet(str(tmp_path / "pages"))
    with duckdb.connect() as con:
        con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
        want = {r[0]: r[4] for r in con.execute(urlfilter.sql()).fetchall()}
    assert got == want
