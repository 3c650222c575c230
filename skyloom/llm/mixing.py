"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights: source i holds the share s_i of all tokens (white-space words); its weight is s_i^a / sum(s_j^a). The exponent a
between 0 (all sources alike) and 1 (as found) is bisected to meet a target: the largest at which the weights' entropy is at
least `entropy` (a share of the largest possible), or else the smallest at which no source is repeated more than `repeats`
times as often as the least repeated one. A round evaluates FAN exponents between the bounds in one aggregation over sources, so that a few
rounds stand for many halvings; only the FAN sums come to the driver, never a row for each source.

Realisation: budgets are the weights times `budget` tokens; without a budget the least repeated source is taken exactly once,
so that every document stays and the others are repeated. A source is read in blocks; block e is all its documents in a
permutation of its own (by a hash of id and e). The last block is cut: a document is in if its middle token lies inside the
budget. Positions within a block are sums over hash ranges, whose number grows with the source, and then within each range, so
no source is gathered in one task. A range that holds more than HOT rows all the same (rows that share an id, or have none, share
a hash) is split once more, by where its rows were read. mix_at, the share of the source's budget before a row, orders the
whole mix: every stretch of it holds sources by their weights.

Only DataFrame functions are used. Documents of no tokens weigh one token, so that they have a place. Ids, sources and token
counts are written once, and weights and ranges are made from them; texts are read twice.

Cases: a null source is a source of its own. Null text is of no tokens. Rows with null or equal ids are documents of their own;
their order is by hash, id and length. One source, or an empty table: weight 1, or no rows. Columns of the input are kept in order;
those named like a new column (in any case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import numbered, others, written

REPEATS, FAN, FINE, RANGE_ROWS, HOT = 2.0, 64, 3, 4096, 1 << 16


def word_count(text: Column) -> Column:
    """White-space words of a text, one at least."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def exponent(shares: DataFrame, entropy: float | None = None, repeats: float = REPEATS) -> float:
    """shares: share of each source. Entropy falls as the exponent grows: the largest that meets `entropy` is taken. So does the
    ratio of repetitions: the smallest that keeps within `repeats`. Exact to FAN**-FINE."""
    low, high = 0.0, 1.0
    for _ in range(FINE):
        step = (high - low) / FAN
        tried = shares.select("share", F.explode(F.expr(f"sequence(0, {FAN})")).alias("k")).withColumn("a", F.lit(low) + F.col("k") * F.lit(step)).withColumn("w", F.pow("share", "a"))
        repeated = F.pow("share", F.col("a") - 1)
        sums = tried.groupBy("k", "a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.count("*").alias("n"), (F.max(repeated) / F.min(repeated)).alias("ratio"))
        met = F.col("ratio") <= repeats + 1e-9 if entropy is None else F.log("z") - F.col("wl") / F.col("z") >= entropy * F.log("n") - 1e-9
        good = [r["k"] for r in sums.where(met).select("k").collect()]
        if entropy is None:
            k = min(good, default=FAN)
            if not k:
                return low
            low, high = low + (k - 1) * step, low + k * step
        else:
            k = max(good, default=0)
            if k == FAN:
                return high
            low, high = low + k * step, low + (k + 1) * step
    return high if entropy is None else low


def weights(counted: DataFrame, entropy: float | None = None, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """source, tokens, docs, weight, budget (tokens to draw) of each source. counted: source, n (tokens) of each document."""
    held = written(counted.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "sources")
    total = held.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not total:
        return held.select("source", "tokens", "docs", F.lit(1.0).alias("weight"), F.lit(0.0).alias("budget"))
    shares = held.withColumn("share", F.col("tokens") / F.lit(float(total)))
    a = exponent(shares, entropy, repeats)
    raised = shares.withColumn("w", F.pow("share", F.lit(a)))
    z = raised.agg(F.sum("w").alias("z"), F.min(F.col("w") / F.col("tokens")).alias("least")).first()
    drawn = F.col("w") / F.lit(z["least"]) if budget is None else F.col("w") / F.lit(z["z"]) * F.lit(float(budget))
    return written(raised.select("source", "tokens", "docs", (F.col("w") / F.lit(z["z"])).alias("weight"), drawn.alias("budget")), "weights")


KEY = ["of", "block", "range"]


def _taken(rows: DataFrame, w: DataFrame, seed: int) -> DataFrame:
    """rows (id, source, n and others) once for each block that they are drawn in, with their source's weights, hash and range."""
    joined = rows.join(w, rows["source"].eqNullSafe(w["of"]))
    # A budget within a millionth of a token of whole blocks is whole blocks.
    blocks = F.greatest(F.ceil(F.col("budget") / F.col("tokens") - 1e-9), F.lit(0))
    taken = joined.where("budget > 0").withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    taken = taken.withColumn("hash", permuted(F.col("id"), F.col("block"), seed))
    return taken.withColumn("range", F.floor(F.col("hash") / F.lit(float(1 << 48)) * F.col("ranges")))


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, joined by keys that may be null."""
    other = right.select(*[F.col(c).alias("on_" + c) for c in keys], *[c for c in right.columns if c not in keys])
    on = [left[c].eqNullSafe(other["on_" + c]) for c in keys]
    return left.join(other, on, how).drop(*["on_" + c for c in keys])


def mixed(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", entropy: float | None = None, repeats: float = REPEATS, budget: float | None = None, seed: int = 0) -> DataFrame:
    """docs drawn by weight, a row for each time that a document is taken: its columns, then weight, block (0, 1, ...) and mix_at."""
    added = ("weight", "block", "mix_at")
    whole, place = numbered(docs)
    columns = others(docs.columns, added)
    facts = [F.col(place(id_column)).alias("id"), F.col(place(source)).alias("source"), word_count(F.col(place(text))).alias("n")]
    narrow = written(whole.select(*facts), "counted")
    w = weights(narrow, entropy, repeats, budget).withColumnRenamed("source", "of").withColumn("ranges", F.greatest(F.ceil(F.col("docs") / RANGE_ROWS), F.lit(1)))
    sums = written(_taken(narrow, w, seed).groupBy(*KEY).agg(F.sum("n").alias("in"), F.count("*").alias("rows")), "ranges")
    taken = _taken(whole.select(*columns, *facts, F.monotonically_increasing_id().alias("read")), w, seed)
    keys = [*KEY, "part"]
    hot = sums.where(F.col("rows") > HOT)
    if hot.isEmpty():
        taken, sums = taken.withColumn("part", F.lit(0)), sums.withColumn("part", F.lit(0))
    else:
        # Ranges of over HOT rows: fewer than there are rows to HOT, so they may be broadcast.
        parts = F.broadcast(hot.select(*KEY, F.ceil(F.col("rows") / RANGE_ROWS).alias("parts")))
        split = lambda df: _on(df, parts, KEY, "left").withColumn("part", F.coalesce(F.expr("pmod(read, parts)"), F.lit(0)).cast("int"))
        taken = split(taken)
        again = split(_taken(whole.select(*facts, F.monotonically_increasing_id().alias("read")), w, seed)).where("parts is not null")
        sums = sums.where(F.col("rows") <= HOT).select(*KEY, F.lit(0).alias("part"), "in").unionByName(again.groupBy(*keys).agg(F.sum("n").alias("in")))
    before = Window.partitionBy("of", "block").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select(*keys, F.coalesce(F.sum("in").over(before), F.lit(0)).alias("before")), "starts")
    within = Window.partitionBy(*keys).orderBy("hash", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = _on(taken, starts, keys).withColumn("at", F.col("block") * F.col("tokens") + F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    cut = placed.where(F.col("at") + F.col("n") / 2 <= F.col("budget") + 1e-6 * F.col("tokens"))
    return cut.select(*columns, "weight", F.col("block").cast("int").alias("block"), (F.col("at") / F.col("budget")).alias("mix_at")).toDF(*columns.values(), *added)


def permuted(id_column: Column, block: Column, seed: int) -> Column:
    """48 bits of the md5 of id, block and seed."""
    name = F.concat_ws("-", F.coalesce(id_column.cast("string"), F.lit("null")), block.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def sql(repeats: float = REPEATS, seed: int = 0) -> str:
    """doc_id, source, block, weight and mix_at (rounded to 9 places) of documents in DuckDB's SQL, for a repetition limit without a budget."""
    ctes = [
        r"d AS (SELECT doc_id, source, greatest(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0), 1) AS n FROM documents)",
        "held AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source)",
        "shares AS (SELECT *, tokens / CAST((SELECT sum(tokens) FROM held) AS DOUBLE) AS share FROM held)",
        "b0 AS (SELECT CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, false AS done)",
    ]
    for i in range(1, FINE + 1):
        ctes += [
            f"g{i} AS (SELECT k, low, (high - low) / {FAN} AS step, max(pow(share, low + k * ((high - low) / {FAN}) - 1)) / min(pow(share, low + k * ((high - low) / {FAN}) - 1)) AS ratio FROM shares, range(0, {FAN + 1}) t(k), b{i - 1} GROUP BY ALL)",
            f"k{i} AS (SELECT coalesce(min(k) FILTER (ratio <= {repeats} + 1e-9), {FAN}) AS k, any_value(low) AS low, any_value(step) AS step FROM g{i})",
            f"b{i} AS (SELECT CASE WHEN done OR k = 0 THEN b.low ELSE c.low + (k - 1) * step END AS low, CASE WHEN done THEN b.high WHEN k = 0 THEN c.low ELSE c.low + k * step END AS high, done OR k = 0 AS done FROM k{i} c, b{i - 1} b)",
        ]
    return "WITH " + ",\n".join(ctes) + f""",
raised AS (SELECT *, pow(share, (SELECT high FROM b{FINE})) AS w FROM shares),
weights AS (SELECT source, tokens, w / sum(w) OVER () AS weight, w / min(w / tokens) OVER () AS budget FROM raised),
taken AS (SELECT doc_id, d.source, n, tokens, weight, budget, unnest(range(0, CAST(ceil(budget / tokens - 1e-9) AS BIGINT))) AS block FROM d JOIN weights w ON d.source IS NOT DISTINCT FROM w.source),
placed AS (SELECT *, block * tokens + coalesce(sum(n) OVER (PARTITION BY source, block ORDER BY ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), '-', block, '-{seed}')), 1, 12))::BIGINT, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM taken)
SELECT doc_id, source, CAST(block AS INTEGER) AS block, round(weight, 9) AS weight, round(place / budget, 9) AS mix_at FROM placed WHERE place + n / 2 <= budget + 1e-6 * tokens"""
