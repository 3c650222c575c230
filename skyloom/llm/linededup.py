"""Line dedup by site-relative frequency: a line that stands on more than MAX_RATIO of a host's pages is boilerplate and goes.

A page's lines are cut at \\n and compared without white space at their ends; blank lines stay. For each host and distinct
line the pages that contain it are counted (a page counts once), each page's distinct lines being found inside its row, and
divided by the host's pages. Lines are known by two 64-bit hashes. A host's boilerplate has at most (mean lines of a page) /
MAX_RATIO members, so it is one short row for each host, which is joined to the pages by host; it is broadcast only if its
measured size is under BROADCAST_BYTES, otherwise Spark joins by shuffle and splits a hot host.

Counts are combined before the shuffle and keyed by (host, line), so a host in a third of all pages is spread by its lines,
and a line in a third of all pages is summed in parts.

Cases: a null host is a host of its own. Null text has no lines and stays null. A line on one page of a host (MIN_PAGES is 2)
repeats nothing and stays, whatever its share of the host's pages. Repeated rows count as pages of their own. A page may end up
empty. An empty table gives an empty result. All columns of the pages are kept, in order, whatever their names, but for one
named n_dropped (in any case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import numbered, others, written

MAX_RATIO, MIN_PAGES, BROADCAST_BYTES = 0.05, 2, 8 << 20
_BLANKS = " \t\r\x0b\x0c"


def _line_id(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, pages, lines (array of ids): the lines over the ratio of each host that has some."""
    key = F.col(f"`{host}`").alias("host")
    total = pages.groupBy(key).agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n"), _bare), lambda x: x != ""), _line_id))
    counts = pages.select(key, F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(total, counts["host"].eqNullSafe(total["host"])).where(F.col("n") > max_ratio * F.col("pages")).select(total["host"], "pages", "line")
    return over.groupBy("host", "pages").agg(F.collect_list("line").alias("lines"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with `text` freed of boilerplate lines, and n_dropped: how many lines went."""
    rows, place = numbered(pages)
    known = written(boilerplate(rows, place(host), place(text), max_ratio, min_pages), "boilerplate").select("host", "lines")
    size = known.agg(F.sum(F.size("lines"))).first()[0] or 0
    if size * 16 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    whole = F.col(place(text))
    joined = rows.join(known, F.col(place(host)).eqNullSafe(F.col("host")), "left")
    old = F.split(whole, "\n")
    kept = F.filter(old, lambda x: ~F.array_contains(F.col("lines"), _line_id(_bare(x))))
    some = F.col("lines").isNotNull() & whole.isNotNull()
    new = F.when(some, F.array_join(kept, "\n")).otherwise(whole)
    dropped = F.when(some, F.size(old) - F.size(kept)).otherwise(0).cast("int")
    columns = others(pages.columns, ("n_dropped",))
    return joined.select(*[new.alias(c) if c == place(text) else c for c in columns], dropped.alias("n")).toDF(*columns.values(), "n_dropped")


def sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """doc_id, text and n_dropped of documents in DuckDB's SQL."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
total AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
line AS (SELECT r, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS raw FROM pages WHERE text IS NOT NULL),
bare AS (SELECT r, source, i, raw, trim(raw, {blanks}) AS x FROM line),
seen AS (SELECT source, x, count(DISTINCT r) AS n FROM bare WHERE x <> '' GROUP BY source, x HAVING count(DISTINCT r) >= {min_pages}),
bad AS (SELECT s.source, s.x FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source WHERE s.n > {max_ratio} * t.n),
judged AS (SELECT b.r, b.i, b.raw, d.x IS NOT NULL AS gone FROM bare b LEFT JOIN bad d ON b.source IS NOT DISTINCT FROM d.source AND b.x = d.x),
whole AS (SELECT r, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_dropped FROM judged GROUP BY r)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE w.text END AS text, CAST(coalesce(w.n_dropped, 0) AS INTEGER) AS n_dropped FROM pages p LEFT JOIN whole w ON p.r = w.r"""
