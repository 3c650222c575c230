"""Language ID by Bayesian evidence fusion: text likelihoods, declared markup language, address suffix and host priors.

For each document the log posterior of a language is the sum of
- text: log likelihood of its words' character trigrams under a naive Bayes model (add-one smoothed), tempered to TEMPER of its
  size and held to MOST, since neighbouring trigrams are not independent;
- declared: log(TRUST) if the declared language is this one, else log of the rest over the others; none if undeclared or unknown;
- suffix: the same for a language segment of the address's path (/en/) or a country suffix of the host, with less trust; a row
  without an address has its host for one;
- host: log of the host's prior, smoothed in three levels: all documents, then the host's parent domain, then the host, each
  level counting as PRIOR documents for the next.
Priors come from a grouped aggregation of the documents' text posteriors (summed by host before the shuffle, so a hot host is
summed in parts) and hold one row for each host.

A document is rejected if its text says nothing (no letters), if the best language's posterior is below MIN_POSTERIOR, or if
its words are unlike any known language: a mean log likelihood for each trigram more than MIN_FIT below what the model's own
training rows have.

Fitting: languages are the LANGUAGES labels with the most documents; the model is counted on a bounded sample, PER_LANGUAGE
texts of each language by hashes of id and text, read whole where they are: only trigram counts come to the driver. Everything else covers all documents.

Cases: null or empty text has only the other evidence and is rejected; null language, url or host give no evidence of
their kind (a null host is one host). Labels and declared codes count by their first subtag (pt-BR is pt). Unknown codes give none. Ties go to the first language by name. Repeated rows
and ids give a row each. Without a labelled document every row is rejected with language null. Extra columns are kept, but for
those named like a new one (in any case).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_schema, numbered, others, released, written
from skyloom.llm.maintext import main_texts
from skyloom.llm.urlfilter import host_and_path

LANGUAGES, PER_LANGUAGE, SHORTEST = 256, 400, 20
TEMPER, MOST, TRUST, TRUST_SUFFIX, PRIOR, MIN_POSTERIOR, MIN_FIT = 0.1, 12.0, 0.9, 0.7, 20.0, 0.6, 4.0
_LETTERS = re.compile(r"[^\W\d_]+")
HELD = 100_000


class Model:
    """Trigram counts by language; a word's trigrams are those of the word between two spaces, lower-cased."""

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray]):
        self.languages = languages
        totals = sum(counts.values()) if counts else np.zeros(len(languages))
        size = len(counts) + 1
        self.unseen = np.log(1 / (totals + size))
        self.log = {g: np.log((c + 1) / (totals + size)) for g, c in counts.items()}
        own = sum(float(c @ self.log[g]) for g, c in counts.items())
        #: The mean log likelihood of the sample's trigrams under their own language.
        self.usual = own / float(totals.sum()) if counts else 0.0

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """Log likelihood of each language, and the number of trigrams."""
        words = Counter(_LETTERS.findall(text.lower()))
        if not words:
            return np.zeros(len(self.languages)), 0
        held = _held(self)
        if held.n + len(words) > len(held.rows):
            held.forget(len(words))
        places = np.fromiter((held.place(w, self) for w in words), np.int64, len(words))
        total = np.fromiter(words.values(), float, len(words)) @ held.rows[places]
        return total[:-1], int(total[-1])


class _Held(dict):
    """Words that a worker has met: their place in rows (log likelihoods, number of trigrams). All go when rows are full."""

    def __init__(self, languages: int):
        self.rows, self.n = np.empty((max(1000, 4 * HELD // (4 + languages)), languages + 1)), 0

    def forget(self, wanted: int) -> None:
        self.clear()
        self.n = 0
        if wanted > len(self.rows):
            self.rows = np.empty((wanted, self.rows.shape[1]))

    def place(self, word: str, model: Model) -> int:
        at = self.get(word)
        if at is None:
            own = grams(word)
            row = self.rows[self.n]
            row[:-1] = sum((model.log.get(g, model.unseen) for g in own), np.zeros(len(model.languages)))
            row[-1] = len(own)
            at = self[word] = self.n
            self.n += 1
        return at


_HELD: dict[tuple, _Held] = {}


def _held(model: Model) -> _Held:
    """What this worker holds for a model; one model at a time."""
    key = (*model.languages, len(model.log), model.usual)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = _Held(len(model.languages))
    return _HELD[key]


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def first_subtag(code: Column) -> Column:
    """The language of a code, lower-cased, without region or script; null if empty."""
    found = F.lower(F.trim(F.split(code, "[-_]")[0]))
    return F.when(found != "", found)


COUNTS = "l string, gram string, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trigrams of each label's texts (l, t), counted batch by batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = found.setdefault(label, Counter())
            for word, n in Counter(_LETTERS.findall(text.as_py().lower())).items():
                for gram in grams(word):
                    own[gram] += n
        rows = [(label, gram, n) for label, own in found.items() for gram, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], schema=arrow_schema(COUNTS))


def train(docs: DataFrame, language: str = "lang", text: str = "text", order: str = "doc_id") -> Model:
    """The model of the bounded sample of labelled rows. Equal rows count once."""
    label, whole = first_subtag(F.col(f"`{language}`").cast("string")), F.col(f"`{text}`").cast("string")
    rows = docs.select(label.alias("l"), F.xxhash64(F.col(f"`{order}`"), whole).alias("h"), whole.alias("t")).where(F.col("l").isNotNull() & (F.length("t") >= SHORTEST))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    names = sorted(sizes)
    if not names:
        return Model([], {})
    # Only hashes that a label's number divides are ranked: about four times as many as are wanted, however many there are.
    every = F.create_map(*[F.lit(x) for l in names for x in (l, max(1, sizes[l] // (4 * PER_LANGUAGE)))])
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    drawn = rows.where(F.col("l").isin(names)).where(F.pmod("h", every[F.col("l")]) == 0)
    kept = drawn.select("l", "h").distinct().withColumn("p", place).where(F.col("p") <= PER_LANGUAGE)
    # At most LANGUAGES * PER_LANGUAGE rows of two columns.
    texts = rows.join(F.broadcast(kept.select("l", "h")), ["l", "h"]).dropDuplicates(["l", "h"]).select("l", "t")
    counts: dict[str, np.ndarray] = {}
    for r in texts.mapInArrow(released(_counted), COUNTS).groupBy("l", "gram").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["gram"], np.zeros(len(names)))[names.index(r["l"])] = r["n"]
    return Model(names, counts)


def softmax(ll: np.ndarray) -> np.ndarray:
    """Of each row."""
    e = np.exp(ll - ll.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


EVIDENCE = "struct<text_ll array<double>, own array<double>, fit double>"


def evidence(model: Model):
    """A function of texts: text_ll (log likelihoods, tempered), own (the posteriors by them alone) and fit (mean log likelihood of
    the best language for each trigram; null without letters)."""

    @F.arrow_udf(EVIDENCE)
    def score(texts: pa.Array) -> pa.Array:
        ll, fits = np.zeros((len(texts), len(model.languages))), np.full(len(texts), np.nan)
        for i, x in enumerate(texts):
            found, n = model.score(x.as_py() or "")
            if n:
                best = float(found.max())
                ll[i], fits[i] = np.maximum(TEMPER * (found - best), -MOST), best / n
        return pa.StructArray.from_arrays([_lists(ll), _lists(softmax(ll)), pa.array(fits, mask=np.isnan(fits))], names=["text_ll", "own", "fit"])

    # Not to be computed again for each of its fields or for a filter on them.
    return score.asNondeterministic()


def votes(codes: pa.Array, languages: list[str], trust: float) -> np.ndarray:
    """Log evidence of declared codes, 0 for all languages if a code is none of them."""
    place = {x: i for i, x in enumerate(languages)}
    at = np.array([place.get(c, -1) for c in codes.to_pylist()], np.int64)
    out = np.zeros((len(at), len(languages)))
    known = np.flatnonzero(at >= 0)
    out[known] = math.log(max((1 - trust) / max(1, len(languages) - 1), 1e-9))
    out[known, at[known]] = math.log(trust)
    return out


VERDICT = "struct<language string, posterior double, accepted boolean>"


def fused(model: Model):
    """A function of text_ll, prior, declared code, suffix code and fit: the language with the largest posterior, and whether it is accepted."""
    names, usual = model.languages, model.usual

    @F.arrow_udf(VERDICT)
    def fuse(text_ll: pa.Array, prior: pa.Array, declared: pa.Array, suffix: pa.Array, fit: pa.Array) -> pa.Array:
        of = lambda x: x.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), len(names))
        post = softmax(of(text_ll) + np.log(of(prior)) + votes(declared, names, TRUST) + votes(suffix, names, TRUST_SUFFIX)) if len(fit) else np.zeros((0, len(names)))
        best, fits = post.argmax(axis=1), fit.to_numpy(zero_copy_only=False).astype(float)
        top = post[np.arange(len(fit)), best]
        accepted = (top >= MIN_POSTERIOR) & (np.nan_to_num(fits, nan=-np.inf) >= usual - MIN_FIT)
        return pa.StructArray.from_arrays([pa.array(names).take(pa.array(best)), pa.array(top), pa.array(accepted)], names=["language", "posterior", "accepted"])

    return fuse.asNondeterministic()


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text), lang (the html element's) and host (the url's; null where there is none) of every row of pages."""
    lang = F.regexp_extract(F.col("html").cast("string"), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z0-9_-]+)""", 1)
    host = host_and_path(F.col("url").cast("string"))[0]
    named = pages.select("page_id", "url", "html", F.when(lang != "", lang).alias("lang"), F.when(host != "", host).alias("host"))
    return main_texts(named, ("lang", "host")).drop("n_chars")


def suffix_language(url: Column) -> Column:
    """The language segment that an address's path begins with, or else the last label of its host, lower-cased."""
    segment = F.lower(F.regexp_extract(url, r"^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    label = F.lower(F.regexp_extract(url, r"^[^:]*://[^/?#:]*\.([A-Za-z]{2})(?::\d+)?(?:[/?#]|$)", 1))
    return F.when(segment != "", segment).when(label != "", label)


def host_priors(scored: DataFrame, host: Column, n: int) -> DataFrame:
    """host, prior (array): smoothed by parent domain and by all documents. scored holds `own`, the text posteriors."""
    by_host = written(scored.select(host.alias("host"), "own").groupBy("host").agg(*[F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(n)]), "hosts")
    by_host = by_host.withColumn("parent", F.when(F.size(F.split("host", r"\.")) > 2, F.substring_index("host", ".", -2)).otherwise(F.lit("")))
    by_parent = by_host.groupBy("parent").agg(*[F.sum(f"s{i}").alias(f"p{i}") for i in range(n)])
    row = by_host.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).first()
    total = [row[f"s{i}"] or 0.0 for i in range(n)]
    whole = [(x + 1) / (sum(total) + n) for x in total]
    size = lambda p: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0"))
    middle = lambda i: (F.col(f"p{i}") + PRIOR * whole[i]) / (size("p") + PRIOR)
    joined = by_host.join(by_parent, "parent")
    return joined.select("host", F.array(*[(F.col(f"s{i}") + PRIOR * F.when(F.col("parent") == "", whole[i]).otherwise(middle(i))) / (size("s") + PRIOR) for i in range(n)]).alias("prior"))


def identify(docs: DataFrame, model: Model, text: str = "text", declared: str | None = "lang", host: str | None = "source", url: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (those of its columns named in `keep`) with language, posterior and accepted (boolean).

    Only texts go to Python, once; the columns that are kept are written with the evidence.
    """
    added = ("language", "posterior", "accepted")
    rows, place = numbered(docs)
    columns = {c: name for c, name in others(docs.columns, added).items() if keep is None or name in keep}
    if not model.languages:
        return rows.select(*columns, F.lit(None).cast("string").alias("v0"), F.lit(0.0).alias("v1"), F.lit(False).alias("v2")).toDF(*columns.values(), *added)
    named = lambda c: (F.col(place(c)) if c else F.lit(None)).cast("string")
    at = suffix_language(F.coalesce(named(url), F.concat(F.lit("http://"), named(host))))
    known = rows.select(*columns, named(host).alias("host"), first_subtag(named(declared)).alias("declared"), at.alias("suffix"), evidence(model)(named(text)).alias("e"))
    known = written(known.select(*columns, "host", "declared", "suffix", "e.*"), "evidence")
    priors = host_priors(known.where("fit is not null").select("host", "own"), F.col("host"), len(model.languages)).withColumnRenamed("host", "of_host")
    flat = F.array(*[F.lit(1.0 / len(model.languages))] * len(model.languages))
    joined = known.join(priors, known["host"].eqNullSafe(priors["of_host"]), "left")
    out = joined.withColumn("v", fused(model)("text_ll", F.coalesce("prior", flat), "declared", "suffix", "fit"))
    return out.select(*columns, "v.language", "v.posterior", "v.accepted").toDF(*columns.values(), *added)
