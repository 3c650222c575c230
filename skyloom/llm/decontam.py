"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, overlap verified.

The test items are indexed: for each word the items that hold it, in blocks of BLOCK postings with the largest BM25 score in
the block. Every document is cut into passages of WINDOW words that overlap by half, and each is a query: all items that score
at least THRESHOLD of the item's own score (the item queried with itself) are retrieved. A passage counts a word once. WAND walks
postings in item order with each term's largest score as bound, and skips a pivot whose blocks' largest scores cannot reach the
lowest threshold. A document or passage is opened only if the telling words that it holds (all but an item's lowest-scoring
ones, COMMON of its score) can make up what the others together cannot. These bounds only skip what cannot
be retrieved, so the result is that of scoring everything.

Retrieved items are verified in the document around the passage: the item's question (its words up to the last sentence,
or the first half if it has one sentence) and answer (the rest) must each be contained in order to SIMILARITY, by the
share of their five-word shingles (shorter answers: of their words) found there.

The index holds test items only, and is sent to tasks in shards of at most SHARD_BYTES of item text, one pass over the
documents for each, one after another, so that tasks hold one shard. The statistics (item counts, mean length, longest item,
which sets the window) are those of all items, so shards do not change results. The driver holds one shard's texts and a count
for each distinct word of the items.

Cases: null or empty texts match nothing. Items without words are left out. Repeated documents or items match each on their
own; null ids are returned as null. Empty tables: no match, every document clean. Extra columns are kept, but for one named
item_ids (in any case).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import numbered, others, released, written

WINDOW, BLOCK, THRESHOLD, SIMILARITY, SHARD_BYTES, COMMON = 128, 16, 0.6, 0.75, 16 << 20, 0.3
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in (words(x) for x in _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    half = (len(whole) + 1) // 2
    return whole[:half], whole[half:]


def contained(part: list[str], text: list[str], k: int = 5) -> float:
    """The share of a part's k-word shingles that the text has; of its words in the text if it has fewer than k words."""
    k = k if len(part) >= k else 1
    if not part:
        return 1.0
    own = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
    there = {tuple(text[i : i + k]) for i in range(len(text) - k + 1)}
    return len(own & there) / len(own)


class Index:
    """A shard of the items' inverted index. n, mean, longest: items of all shards, their mean length and largest; df: word -> items of all shards."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, mean: float, df: dict[str, int], longest: int):
        self.ids = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.longest = longest
        lists: dict[str, list[tuple[int, float]]] = {}
        own = np.zeros(len(items))
        for d, ws in enumerate(tokens):
            for w in set(ws):
                tf = ws.count(w)
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
                lists.setdefault(w, []).append((d, score))
                own[d] += score
        self.limit = THRESHOLD * own
        self.least = float(self.limit.min()) if len(items) else math.inf
        # Telling words: all of an item's but the lowest-scoring ones, which come to COMMON of its own score together. Those
        # that a text has must make up what the others cannot.
        self.telling: dict[str, list[tuple[int, float]]] = {}
        self.needed = self.limit.copy()
        by_item: dict[int, list[tuple[float, str]]] = {}
        for w, posted in lists.items():
            for d, score in posted:
                by_item.setdefault(d, []).append((score, w))
        for d, scored in by_item.items():
            common = 0.0
            for score, w in sorted(scored):
                if common + score <= COMMON * own[d]:
                    common += score
                    self.needed[d] -= score
                else:
                    self.telling.setdefault(w, []).append((d, score))
        self.tellers = frozenset(self.telling)
        self.docs = {w: [d for d, _ in p] for w, p in lists.items()}
        self.scores = {w: [s for _, s in p] for w, p in lists.items()}
        self.most = {w: max(s) for w, s in self.scores.items()}
        self.block_most = {w: [max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for w, s in self.scores.items()}

    def possible(self, terms: set[str]) -> bool:
        """Whether the telling words among the terms leave any item within reach of its limit."""
        held: dict[int, float] = {}
        for w in terms & self.tellers:
            for d, score in self.telling[w]:
                held[d] = held.get(d, 0.0) + score
        return any(score >= self.needed[d] - 1e-9 for d, score in held.items())

    def search(self, terms: list[str]) -> list[int]:
        """Places of the items that reach their limit for the distinct terms, by block-max WAND."""
        lists = [[self.docs[w][0], w, 0] for w in terms if w in self.docs]
        found, least = [], self.least
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for i, (_, w, _) in enumerate(lists):
                bound += self.most[w]
                if bound >= least - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
                pivot += 1
            # Where each list up to the pivot would stand at doc, its block's largest score.
            block, after = 0.0, math.inf
            for _, w, at in lists[: pivot + 1]:
                docs = self.docs[w]
                k = at // BLOCK
                while k * BLOCK + BLOCK - 1 < len(docs) - 1 and docs[k * BLOCK + BLOCK - 1] < doc:
                    k += 1
                end = docs[min(k * BLOCK + BLOCK, len(docs)) - 1]
                if end >= doc:
                    block += self.block_most[w][k]
                    after = min(after, end + 1)
            if block < least - 1e-9:
                # No item before `after`, nor before the next list's, can reach the limit.
                goal = min(after, lists[pivot + 1][0] if pivot + 1 < len(lists) else math.inf)
                goal = max(goal, doc + 1)
            elif lists[0][0] == doc:
                score = sum(self.scores[w][at] for d, w, at in lists[: pivot + 1])
                if score >= self.limit[doc] - 1e-9:
                    found.append(doc)
                goal = doc + 1
            else:
                goal = doc
            for x in lists[: pivot + 1]:
                docs, at = self.docs[x[1]], x[2]
                while at < len(docs) and docs[at] < goal:
                    at += 1
                x[2], x[0] = at, docs[at] if at < len(docs) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def matches(self, text: str | None) -> list[int]:
        """Places of the items that are retrieved by a passage of the text and verified around it."""
        ws = words(text)
        if not ws or not self.possible(set(ws)):
            return []
        window = max(WINDOW, 2 * self.longest)
        step = window // 2
        hits: set[int] = set()
        for a in range(0, max(len(ws) - step, 1), step):
            b = min(a + window, len(ws))
            terms = set(ws[a:b])
            if not self.possible(terms):
                continue
            terms &= self.most.keys()
            near = None
            for d in self.search(sorted(terms)):
                if d not in hits:
                    near = near or ws[max(0, a - step) : b + step]
                    if all(contained(part, near) >= SIMILARITY for part in self.parts[d]):
                        hits.add(d)
        return sorted(hits)


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The index in shards of about shard_bytes of text. The driver holds one shard's texts at a time, and the words' counts."""
    plain = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    n, mean_of, longest, df = 0, 0, 0, {}
    for row in plain.toLocalIterator():
        ws = words(row["t"])
        n, mean_of, longest = n + bool(ws), mean_of + len(ws), max(longest, len(ws))
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in plain.toLocalIterator():
        if words(row["t"]):
            held.append((row["id"], row["t"]))
            size += len(row["t"])
            if size > shard_bytes:
                yield Index(held, n, mean_of / n, df, longest)
                held, size = [], 0
    if held:
        yield Index(held, n, mean_of / n, df, longest)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs with item_ids (array of long, ascending): the test items that are verified in each; empty where clean."""
    rows, place = numbered(docs)
    columns = others(docs.columns, ("item_ids",))
    out = rows.select(*columns, F.array().cast("array<long>").alias("found"))
    shared = None
    for index in indexes(items):
        if shared:
            # One shard at a time: the results so far are written and the last one's index is given up.
            out = written(out, "marked")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = _marked(out, shared, place(text))
    return out.toDF(*columns.values(), "item_ids")


def _marked(docs: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """docs with the matches of a shard's index added to the last column."""
    at = docs.columns.index(text)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            new = [sorted([*old, *(own.ids[d] for d in own.matches(x.as_py()))], key=lambda i: (i is not None, i or 0)) for x, old in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.list_(pa.int64()))], names=batch.schema.names)

    return docs.mapInArrow(released(mark), docs.schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a verified test item; a column named item_ids is not kept."""
    return contamination(docs, items, text).where(F.size("item_ids") == 0).drop("item_ids")
