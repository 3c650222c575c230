"""Near-duplicate documents: SetSketch registers, banded; estimates by likelihood; links confirmed on full shingle sets.

1. One map computes each whole text's set of 5-word shingles (64-bit hashes), a 128-bit id of the set, and REGISTERS SetSketch
   registers: register i is floor(1 - log_BASE(x)), x the smallest of exponential values that the set's members have under
   hash i, held within 16 bits. Registers of a union are the larger ones of its parts, and two sets agree in a register with a
   probability near their Jaccard similarity. Documents with equal sets form a class; from here on a class has one row.
2. BANDS runs of ROWS registers each give a bucket key. A pair at similarity 0.75 shares no bucket with probability 2e-6.
3. A bucket elects as pivot the member that is in most company over all its buckets, so that the source of a group of edited
   copies is taken rather than one of the copies. Members pair with pivots only: as many pairs as rows, whatever the group.
4. A pair whose joint likelihood (of the counts of larger, smaller and equal registers, given both set sizes) still rises
   beyond similarity JUDGED, five standard errors lower than the threshold, goes on; its link is decided on the full sets.
5. Connected components of the links. A pivot's group that is in one component is finished. In the others, members outside
   the pivot's component are held against the whole group on full sets, in blocks of bounded size (never all pairs as rows:
   a block counts common shingles through an inverted index and emits links that join components, fewer than it has
   members). So every pair that shares a bucket is either compared or known to be connected, and no cap is needed.

Cost: a group of n copies that link to their source takes n comparisons; r members that do not link to it take r times n
counts inside blocks, spread over tasks.

Cases: a text without words (or null) has n_shingles 0 and its own component. A null doc_id takes no part: component_id is
null and it is kept. Rows that share a doc_id share a node, so all their links count for it, whatever their texts; each row is
returned. Classes have numbers of their own, and a class is held by a text of its own set. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import SHINGLE_WORDS, SIMILARITY_PERCENT, WordHash, arrow_schema, byte_words, mix64, released, runs, shingles, written
from skyloom.llm.graph import components

BANDS, ROWS, BASE, RATE, TOP = 48, 5, 1.001, 20.0, 65535
REGISTERS = BANDS * ROWS
JUDGED = 0.60
#: Shingles to a block of a group that is not yet connected.
BLOCK_SHINGLES = 400_000
#: Members to a block of pairs with one pivot.
MEMBERS = 256
#: Ids of classes with company and of their documents (16 bytes each) are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
_RNG = np.random.Generator(np.random.PCG64(20240101))
_XOR, _MUL = _RNG.integers(0, 2**64, REGISTERS, np.uint64), _RNG.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 2**63, (BANDS, ROWS + 1), np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = WordHash()


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    return shingles(_HASH.of(byte_words(text)), k)


def registers(members: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(members), 64):
        block = members[i : i + 64, None] ^ _XOR
        block *= _MUL
        np.minimum(least, block.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, judged: float = JUDGED) -> np.ndarray:
    """Whether the most likely similarity of each row's pair is at least `judged`: the log likelihood is concave, so its slope there tells."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    x, y = u - v * judged, v - u * judged
    scale, log = (BASE - 1) / BASE, math.log(BASE)
    p, q = -np.log1p(-np.maximum(x, 1e-12) * scale) / log, -np.log1p(-np.maximum(y, 1e-12) * scale) / log
    dp, dq = scale / log / (1 - x * scale), scale / log / (1 - y * scale)
    slope = -up * v * dp / p - down * u * dq / q + same * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)
    return (x > 0) & (y > 0) & (slope >= 0)


def linked(common: np.ndarray | int, n_a, n_b, percent: int = SIMILARITY_PERCENT):
    return 100 * common >= percent * (n_a + n_b - common)


def set_id(members: np.ndarray) -> tuple[int | None, int | None]:
    digest = xxhash.xxh3_128_digest(members.tobytes()) if len(members) else b""
    return (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)) if digest else (None, None)


def with_sets(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns named in `keep`, and the id of the text's set (null if empty), of each row."""
    schema = ", ".join(["doc_id long, text string", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "set_a long, set_b long"])
    names = ["doc_id", "text", *keep, "set_a", "set_b"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [set_id(shingle_set(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(released(name), schema)


SKETCHES = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (the id of the set; null if empty) and sketch (16-bit registers) of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                n, a, b, regs = [], [], [], []
                for text in part.column(1):
                    members = shingle_set(text.as_py())
                    n.append(len(members))
                    own = set_id(members)
                    a.append(own[0])
                    b.append(own[1])
                    regs.append(registers(members).tobytes() if len(members) > 2 else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())], schema=arrow_schema(SKETCHES))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(sketch), SKETCHES)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def bands(reps: DataFrame) -> DataFrame:
    """id, key for each band of each sketch."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = _regs(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = mix64(((regs + np.uint64(1)) * _MIX[:, :ROWS]).sum(axis=2, dtype=np.uint64) + _MIX[:, ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.view(np.int64).ravel())], schema=arrow_schema("id long, key long"))

    return reps.select("id", "sketch").mapInArrow(released(band), "id long, key long")


def _likely_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (id, pivot) that pass the likelihood test."""
    x = reps.select("id", F.col("n_shingles").alias("n_a"), F.col("sketch").alias("a"))
    y = reps.select(F.col("id").alias("pivot"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("b"))
    percent = SIMILARITY_PERCENT
    both = pairs.join(x, "id").join(y, "pivot").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("id", "pivot", "n_a", "n_b", "a", "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
                keep = pa.array(likely(_regs(batch.column(4)), _regs(batch.column(5)), n_a, n_b))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=arrow_schema("id long, pivot long"))

    return both.mapInArrow(released(test), "id long, pivot long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b among the pairs (id, pivot), decided on the full sets. A pivot's members are dealt into blocks of about
    MEMBERS; its text goes once to each block, before them, and a task holds one pivot's set at a time."""
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("n"))
    members = pairs.join(blocks, "pivot").select("pivot", F.expr("cast(pmod(xxhash64(id), n) as int)").alias("block"), F.lit(1).alias("member"), "id")
    heads = blocks.select("pivot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(0).alias("member"), F.col("pivot").alias("id"))
    rows = members.unionByName(heads).join(texts, "id").select("pivot", "block", "member", "id", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for p, member, i, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own = shingle_set(x.as_py())
                if not member:
                    of = own
                elif linked(len(np.intersect1d(own, of, assume_unique=True)), len(own), len(of)):
                    a.append(i)
                    b.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow_schema("a long, b long"))

    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "member").mapInArrow(released(confirm), "a long, b long")


def _block_links(ids: np.ndarray, of: np.ndarray, seeks: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that join components, of the rows that seek to all rows of a block. of: their components so far."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    values, place = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(values) + 1))
    owner = owner[order]
    ends = np.cumsum(n)
    label = of.copy()
    a, b = [], []
    for i in np.flatnonzero(seeks).tolist():
        mine = place[ends[i] - n[i] : ends[i]]
        lens = starts[mine + 1] - starts[mine]
        total = int(lens.sum())
        at = np.repeat(starts[mine] - (np.cumsum(lens) - lens), lens) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(linked(common, n[i], n) & (label != label[i])).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return a, b


def _remaining(groups: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b inside the groups (pivot, id; the pivot included) that are not in one component."""
    known = groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", F.coalesce("component", "id").alias("component")).join(reps.select("id", "n_shingles"), "id")
    known = written(known, "groups")
    own = known.where("id = pivot").select("pivot", F.col("component").alias("main"))
    marked = known.where("id <> pivot").join(own, "pivot").withColumn("seeks", F.col("component") != F.col("main"))
    size = marked.groupBy("pivot").agg(F.sum(F.col("seeks").cast("long")).alias("r"), F.count("*").alias("m"), F.sum("n_shingles").alias("all"), F.sum(F.when(F.col("seeks"), F.col("n_shingles")).otherwise(0)).alias("seeking"))
    size = size.where("r > 0 and m > 1").select("pivot", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("across"), F.ceil(F.col("seeking") / BLOCK_SHINGLES).cast("int").alias("down"))
    marked = marked.join(size, "pivot")
    deal = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    every = marked.select("pivot", "id", "component", F.lit(False).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), deal("across").alias("j"))
    seek = marked.where("seeks").select("pivot", "id", "component", F.lit(True).alias("seeks"), deal("down").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    rows = every.unionByName(seek).join(texts, "id").select("pivot", "i", "j", "id", "component", "seeks", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            seeks = block.column(5).to_numpy(zero_copy_only=False)
            sets = [shingle_set(x.as_py()) for x in block.column(6)]
            a, b = _block_links(block.column(3).to_numpy(), block.column(4).to_numpy(), seeks, sets)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow_schema("a long, b long"))

    return rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(released(compare), "a long, b long")


def _texts(docs: DataFrame, reps: DataFrame, several: DataFrame | None) -> DataFrame:
    """id and a text of its set for each class of reps. several: the doc_ids with more than one set, None if there are none."""
    named = reps.select("id", F.col("doc").alias("doc_id"), "set_a", "set_b")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = named.select("doc_id", "id") if several is None else named.join(several, "doc_id", "left_anti").select("doc_id", "id")
    pairs = F.broadcast(pairs) if reps.count() <= BROADCAST_ROWS else pairs
    texts = rows.join(pairs, "doc_id").select("id", "text").dropDuplicates(["id"])
    if several is None:
        return texts
    own = with_sets(rows.join(several, "doc_id", "left_semi")).join(named, ["doc_id", "set_a", "set_b"])
    return texts.unionByName(own.select("id", "text").dropDuplicates(["id"]))


def grouped_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """sketches of all rows; classes (set_a, set_b, id, doc: its smallest doc_id); links of classes; doc_ids with several sets, None if none."""
    sketched = written(sketches(docs), "sketches")
    differ = F.expr("min(set_a) <> max(set_a) or min(set_b) <> max(set_b) or count(set_a) > 0 and count(set_a) < count(*)")
    several = written(sketched.where("doc_id is not null").groupBy("doc_id").agg(differ.alias("d")).where("d").select("doc_id"), "several")
    several = None if several.isEmpty() else several
    first = F.min_by(F.struct(F.col("doc_id").alias("doc"), "n_shingles", "sketch"), "doc_id").alias("first")
    found = sketched.where("set_a is not null").groupBy("set_a", "set_b").agg(first)
    classes = written(found.select("set_a", "set_b", "first.*", F.monotonically_increasing_id().alias("id")), "classes")
    keyed = bands(classes.where("sketch is not null and doc is not null"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keyed.join(buckets, "key").select("key", "id", "size"), "members")
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    pivots = members.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("pivot"))
    groups = written(members.join(pivots, "key").select("pivot", "id").distinct(), "pivots")
    needed = written(groups.select("id").distinct(), "needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    reps = written(classes.where("sketch is not null").join(needed, "id", "left_semi"), "sketches")
    texts = written(_texts(docs, reps, several), "texts")
    pairs = written(_likely_pairs(groups.where("id <> pivot"), reps), "pairs")
    links = written(_confirmed(pairs, texts), "links")
    more = written(_remaining(groups, components(links), reps, texts), "links")
    return sketched, classes.select("set_a", "set_b", "id", "doc"), links if more.isEmpty() else links.union(more), several


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity 0.75 or more), kept, for each row of docs."""
    sketched, classes, links, several = grouped_rows(docs)
    rows = sketched.select("doc_id", "n_shingles", "set_a", "set_b")
    if several is not None:
        shared = written(rows.join(several, "doc_id", "left_semi").join(classes, ["set_a", "set_b"]).select("doc_id", "id").distinct(), "shared")
        links = links.union(shared.join(shared.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b"))
    labels = components(links).withColumnRenamed("node", "id").join(classes.select("id", "doc"), "id")
    labels = labels.join(labels.groupBy("component").agg(F.min("doc").alias("least")), "component").select("id", "least")
    known = rows.join(classes, ["set_a", "set_b"], "left").join(labels, "id", "left").withColumn("least", F.coalesce("least", "doc"))
    if several is not None:
        # A row without words has the component of the other rows of its doc_id.
        at = shared.join(classes.select("id", "doc"), "id").join(labels, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("least", "doc")).alias("of_id"))
        known = known.join(at, "doc_id", "left").withColumn("least", F.coalesce("least", "of_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "doc_id"))
    return known.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def chosen(docs: DataFrame) -> DataFrame:
    """doc_id, set_a, set_b: one set of each component of texts (a shared doc_id joins none), by the smallest doc_id; every doc_id of texts without words."""
    sketched, classes, links, _ = grouped_rows(docs)
    rows = sketched.where("doc_id is not null").select("doc_id", "set_a", "set_b")
    group = classes.join(components(links).withColumnRenamed("node", "id"), "id", "left").where("doc is not null").select(F.coalesce("component", "id").alias("group"), "doc", "set_a", "set_b")
    best = group.groupBy("group").agg(F.min_by(F.struct("doc", "set_a", "set_b"), F.struct("doc", "set_a", "set_b")).alias("b")).select(F.col("b.doc").alias("doc_id"), "b.set_a", "b.set_b")
    return best.unionByName(rows.where("set_a is null").distinct())
