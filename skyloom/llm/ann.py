"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact Euclidean distance.

Equal vectors form a class that is hashed once; a class keeps its K+1 smallest ids, which is all that any answer can use.
Every class is a row in each of TABLES tables, under the key of its slots. A query visits, in each table, its own bucket and
then buckets one or more slots away in the order of their estimated success (lsh.py). Buckets are dealt into blocks of at most
BLOCK classes and queries visit all blocks of a bucket, ASKED of them at most to a copy of the block, so no task gathers a bucket or
its queries; a block compares its queries with its classes in double precision on the original vectors and hands on the K+1
best of each. The merged candidates of all tables
are ranked once more. No pair but those few becomes a row.

Fitting: width and number of probes come from a bounded sample (SAMPLE classes, those with the smallest hashes). The width is
WIDTH times the median distance to the K-th neighbour within the sample; probes are added in order until RECALL of the
sample's own neighbours are met. Where PROBES probes do not meet it, slots are widened by half until they do (slots as wide as
the data hold everything in one bucket, which is an exact search), so that no data is left with less. Neighbours in all data are
nearer than in the sample, so recall there is higher. Every class is indexed; nothing else depends on the sample.

Cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor do null ids. Vectors
are compared with those of the same number of components only (one index for each such number). Rows with the query's
id are its own and no candidates; a row that is repeated counts once. Ties go to the smaller id. Fewer than K candidates: all
that were found. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_schema, released, runs, written
from skyloom.llm.lsh import Hashes, probe_keys, probe_sets

K, TABLES, FUNCTIONS, WIDTH, PROBES, RECALL, SAMPLE, BLOCK, ASKED = 10, 4, 4, 1.3, 81, 0.94, 4096, 4096, 2048


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to the row y, from differences in double precision."""
    return np.sqrt(np.square(x - y).sum(axis=1))


def fit(sample: np.ndarray, k: int = K, queries: int = 200) -> tuple[Hashes, list[tuple[int, ...]]]:
    """The hashes and the probes for vectors like the sample's."""
    sets = probe_sets(FUNCTIONS, PROBES)
    n = min(queries, len(sample))
    found = np.stack([distances(sample, sample[i]) for i in range(n)])
    k = min(k, len(sample) - 1)
    if k < 1:
        return Hashes(sample.shape[1], TABLES, FUNCTIONS, 1.0), sets
    order = np.argsort(found, axis=1, kind="stable")
    width = WIDTH * float(np.median(np.take_along_axis(found, order[:, k : k + 1], 1))) or 1.0
    while True:
        hashes = Hashes(sample.shape[1], TABLES, FUNCTIONS, width)
        keys, probes = hashes.keys(hashes.slots(sample)[0]), probe_keys(hashes, sample[:n], sets)
        met = np.full((n, k), len(sets))
        for i in range(n):
            for t in range(TABLES):
                hit = keys[order[i, 1 : k + 1], t][:, None] == probes[i, t]
                met[i] = np.minimum(met[i], np.where(hit.any(axis=1), hit.argmax(axis=1), len(sets)))
        share = np.array([(met <= p).mean() for p in range(len(sets))])
        if share[-1] >= RECALL:
            return hashes, sets[: int(np.argmax(share >= RECALL)) + 1]
        width *= 1.5


def best(x: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in x of the k rows nearest to the query, ties to smaller ids, and their distances."""
    rough = np.square(x).sum(axis=1) - 2 * (x @ query)
    if len(x) > 4 * k:
        limit = np.partition(rough, k)[k]
        near = np.flatnonzero(rough <= limit + 1e-6 * (1 + np.abs(limit) + np.square(query).sum()))
    else:
        near = np.arange(len(x))
    d = distances(x[near], query)
    order = np.lexsort((ids[near], d))[:k]
    return near[order], d[order]


FOUND = "query_id long, class_id long, score double"


def _search(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, class_id, score: of each query the k+1 nearest classes found. classes, queries: id, vector, of one length."""
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    if not sample.num_rows:
        return classes.sparkSession.createDataFrame([], FOUND)
    hashes, sets = fit(_matrix(sample.column(0).combine_chunks()), k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = hashes.keys(hashes.slots(_matrix(batch.column(1)))[0])
                of = pa.array(np.repeat(np.arange(batch.num_rows), TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TABLES, dtype=np.int32), batch.num_rows)), pa.array(keys.ravel()), batch.column(0).take(of)], schema=arrow_schema("t int, key long, id long"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                keys = probe_keys(hashes, _matrix(batch.column(1)), sets)
                n = TABLES * len(sets)
                tables = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), len(sets)), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(tables), pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n)))], schema=arrow_schema("t int, key long, id long"))

    kind = "t int, key long, id long"
    entries, visits = written(classes.mapInArrow(released(index), kind), "entries"), written(queries.mapInArrow(released(probe), kind), "visits")
    sized = lambda df, size, name: df.groupBy("t", "key").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = written(sized(entries, BLOCK, "n").join(sized(visits, ASKED, "copies"), ["t", "key"]), "buckets")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    members = entries.join(blocks, ["t", "key"]).select("t", "key", dealt("n").alias("block"), every("copies").alias("copy"), F.lit(False).alias("asks"), "id")
    asked = visits.join(blocks, ["t", "key"]).select("t", "key", every("n").alias("block"), dealt("copies").alias("copy"), F.lit(True).alias("asks"), "id")
    rows = members.join(classes, "id").unionByName(asked.join(queries, "id")).select("t", "key", F.expr("block * 65536L + copy").alias("block"), "asks", "id", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            asks = block.column(3).to_numpy(zero_copy_only=False)
            if asks.any() and not asks.all():
                x, ids = _matrix(block.column(5)), block.column(4).to_numpy()
                held, names = x[~asks], ids[~asks]
                out = [(q, *best(held, names, y, k + 1)) for q, y in zip(ids[asks], x[asks], strict=True)]
                n = [len(at) for _, at, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, _, _ in out]), n)), pa.array(np.concatenate([names[at] for _, at, _ in out])), pa.array(np.concatenate([d for _, _, d in out]))], schema=arrow_schema(FOUND))

    found = rows.repartition("t", "key", "block").sortWithinPartitions("t", "key", "block").mapInArrow(released(compare), FOUND)
    once = found.groupBy("query_id", "class_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "class_id"))
    return once.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def nearest(table: DataFrame, asks: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found of each row for which `asks` (of the id) holds."""
    vector = F.transform(F.col(f"`{vector_column}`"), lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast("double"))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("vector"), asks.alias("asks")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = written(rows, "vectors")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    some = rows.select("id", "vector").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    members = written(some.withColumn("class_id", F.min("id").over(Window.partitionBy("vector"))), "members")
    out = []
    for (n,) in sorted(members.select(F.size("vector")).distinct().collect()):
        of = lambda df: df.where(F.size("vector") == n)  # noqa: E731, B023
        classes = of(members).where("id = class_id").select("id", "vector")
        queries = of(rows).where("asks").select("id", "vector").distinct()
        found = _search(classes, queries, k)
        out.append(found.join(of(members).select("class_id", F.col("id").alias("vec_id")), "class_id"))
    if not out:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    pairs = reduce(DataFrame.unionByName, out).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
