"""The registered queries over the text tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import ann, decontam, langid, linededup, maintext, mixing, neardup, tokencount, tokenfile, urlfilter
from skyloom.llm.common import shared_dir, table, written

#: The vocabulary is a parameter of the operators; the queries take the public byte-level one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_ids", (F.size("item_ids") == 0).alias("kept"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(table(spark, sf_dir, "pages"))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(docs, path, TOKENIZER)
    return tokenfile.read_digests(spark, path)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "block", F.round("weight", 9).alias("weight"), F.round("mix_at", 9).alias("mix_at"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return langid.identify(docs, langid.train(docs), keep=["doc_id"]).select("doc_id", "language", "posterior", "accepted")


def op6_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = written(langid.page_texts(table(spark, sf_dir, "pages")), "texts")
    model = langid.train(pages, order="page_id")
    return langid.identify(pages, model, host="host", url="url", keep=["page_id"]).select("page_id", "language", "posterior", "accepted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_decontamination": op2_decontamination,
    "op3_main_text": op3_main_text,
    "op4_token_files": op4_token_files,
    "op5_source_mix": op5_source_mix,
    "op6_language_id": op6_language_id,
    "op6_page_language": op6_page_language,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
}

SQL: dict[str, str] = {
    "op5_source_mix": mixing.sql(),
    "op7_line_dedup": linededup.sql(),
    "op10_url_filter": urlfilter.sql(),
}
