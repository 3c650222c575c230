"""URL filters: rules by host and path, then trust carried over host links.

split_urls cuts host and path; rules (host, path prefix, allow or block) fit a host and its subdomains, and the longest rule
decides. Urls without a rule are judged by link-graph propagation over the graph of hosts:
- trust is personalised PageRank that restarts at hosts with allowed urls, along links (who is linked from trusted hosts is trusted);
- distrust is personalised PageRank that restarts at hosts with blocked urls, along reversed links (who links to them is distrusted).
A seed weighs the share of its urls with a rule that are allowed (blocked), so a host with both sends both.
A host is blocked if its distrust is over MIN_DISTRUST times the restart of a wholly blocked host and exceeds its trust.

Everything is DataFrame or SQL functions. Links are counted by host pair before any shuffle of them; a round joins ranks with
the pairs on one host and sums by the other, combined before the shuffle, so a host in a third of all links is summed in parts
and its pairs may be split by the skewed-join rule. Ranks have a row for each host. A round carries on only what the last one
added, and rounds go on until all that is still to come is under FINE of the threshold (it shrinks by DAMPING at least in
every round), so a verdict is that of the limit unless a host is nearer to the threshold than that. Each round's ranks are written.

Cases: a null url, or one without ://, has empty host and path, no rule and verdict allow (it has no host to distrust).
Null html has no links. Repeated rows give a row each; repeated links count once for each page row. No links, no seeds or an
empty table: no distrust, so allow. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import written

#: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING, MIN_DISTRUST, FINE, SQL_ROUNDS = 0.85, 0.05, 1e-2, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to /, ? or # (A-Z lower-cased), and then up to ? or #; both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule (host and path) that fits and its verdict, both null where none fits. Rules of equal length: the first by name."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links of pages (host, html) with a host (after a scheme, or the page's by //), by pair of hosts; links within a host are left out."""
    target = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), target.alias("url"))
    url = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    return links.select("src", host_and_path(url)[0].alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def page_rank(links: DataFrame, seeds: DataFrame, rest: float, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: host, rank, all but `rest` of it. links: src, dst, weight; seeds: host, share (sums to 1). A host without links out passes nothing on."""
    total = links.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = written(links.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")), "flow")
    ranks = seeds.select("host", (F.col("share") * (1 - damping)).alias("rank"), (F.col("share") * (1 - damping)).alias("new"))
    if flow.isEmpty():
        return ranks.select("host", "rank")
    coming = 1.0
    while coming * damping / (1 - damping) > rest:
        moved = ranks.where("new > 0").join(flow, ranks["host"] == flow["src"]).select(F.col("dst").alias("host"), (damping * F.col("new") * F.col("part")).alias("rank"))
        both = ranks.select("host", "rank", F.lit(0.0).alias("new")).unionByName(moved.withColumn("new", F.col("rank")))
        ranks = written(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new")), "ranks")
        coming = ranks.agg(F.sum("new").alias("s")).first()["s"] or 0.0
    return ranks.select("host", "rank")


def judged_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (0 where unknown), for every row of pages."""
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select("page_id", F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    rule, by_rule = longest_rule(F.col("host"), F.col("path"), rules)
    links = written(host_links(split.select("host", "html")), "links")
    urls = split.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    by_host = written(urls.where("host <> '' and by_rule is not null").groupBy("host").agg(F.sum(F.when(F.col("by_rule") == "allow", 1).otherwise(0)).alias("allowed"), F.count("*").alias("n")), "seeds")
    weights = {"allow": F.col("allowed") / F.col("n"), "block": (F.col("n") - F.col("allowed")) / F.col("n")}
    n = by_host.agg(*[F.sum(w).alias(k) for k, w in weights.items()]).first()
    share = lambda k: by_host.where(weights[k] > 0).select("host", (weights[k] / (n[k] or 1.0)).alias("share"))
    least = MIN_DISTRUST * (1 - DAMPING) / (n["block"] or 1.0)
    trust = page_rank(links, share("allow"), FINE * least).withColumnRenamed("rank", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = page_rank(back, share("block"), FINE * least).withColumnRenamed("rank", "distrust")
    scores = written(trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    bad = (F.col("distrust") > least) & (F.col("distrust") > F.col("trust"))
    joined = urls.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(F.col("by_rule"), F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return joined


def sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same in DuckDB's SQL, with SQL_ROUNDS rounds written out (after which 0.85**64, 3e-5, of the rank is still to come)."""
    lines = ",\n".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    cut = lambda c: f"CASE WHEN strpos({c}, '://') > 0 THEN substr({c}, strpos({c}, '://') + 3) ELSE '' END"
    host = lambda c: f"translate(regexp_extract({c}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    ctes = [
        f"rules(h, p, v) AS (VALUES {lines})",
        f"rest AS (SELECT page_id, html, coalesce({cut('url')}, '') AS r FROM pages)",
        f"split AS (SELECT row_number() OVER () AS n, page_id, html, {host('r')} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)",
        "fits AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p) AS place FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))",
        "judged AS MATERIALIZED (SELECT s.n, page_id, html, host, path, rule, v FROM split s LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON s.n = f.n)",
        "found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\\s>]+)', 1)) AS url FROM split WHERE host <> '')",
        "whole AS (SELECT src, CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END AS url FROM found)",
        f"named AS (SELECT src, {host(cut('url'))} AS dst FROM whole)",
        "links AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM named WHERE dst <> '' AND dst <> src GROUP BY ALL)",
        "seen AS MATERIALIZED (SELECT host, count(*) FILTER (v = 'allow') / count(*) AS allow, count(*) FILTER (v = 'block') / count(*) AS block FROM judged WHERE host <> '' AND v IS NOT NULL GROUP BY host)",
    ]
    for name, seed, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        ctes += [
            f"{name}_flow AS MATERIALIZED (SELECT {src} AS a, {dst} AS b, w / sum(w) OVER (PARTITION BY {src}) AS part FROM links)",
            f"{name}_0 AS MATERIALIZED (SELECT host, {1 - DAMPING} * {seed} / (SELECT sum({seed}) FROM seen) AS r, {1 - DAMPING} * {seed} / (SELECT sum({seed}) FROM seen) AS new FROM seen WHERE {seed} > 0)",
        ]
        ctes += [f"{name}_{i} AS MATERIALIZED (SELECT host, sum(r) AS r, sum(new) AS new FROM (SELECT host, r, 0 AS new FROM {name}_{i - 1} UNION ALL SELECT b, {DAMPING} * new * part, {DAMPING} * new * part FROM {name}_{i - 1} JOIN {name}_flow ON host = a) GROUP BY host)" for i in range(1, SQL_ROUNDS + 1)]
    bad = f"coalesce(d.r, 0) > {MIN_DISTRUST * (1 - DAMPING)} / coalesce((SELECT sum(block) FROM seen), 1) AND coalesce(d.r, 0) > coalesce(t.r, 0)"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN t_{SQL_ROUNDS} t ON j.host = t.host LEFT JOIN d_{SQL_ROUNDS} d ON j.host = d.host"
