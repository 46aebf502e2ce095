"""A training-data pipeline over `documents`, five stages of the numbered operators.

Each stage works on all rows that the one before kept. Texts in no known language go; of each group of near
duplicates (word 5-shingles, Jaccard 0.8) the document with the least id stays; documents that hold a benchmark
window go; secrets are replaced by a mark; what is left is packed into windows of 2048 tokens.

All stages but the last return the columns of their input, whatever those are called; the last one returns the
pieces. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm import decontaminate, lang_id, ngram_join, packing, secrets
from captionlake.llm.common import drop_rows, fresh, stored

LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are identified as one of the languages of the table. Null texts and texts without a letter
    go. Repeated rows stay or go together; without any row with a language all rows go."""
    model = lang_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), train=F.lit(True))
    lang, score = fresh("language_found", docs.columns), fresh("language_score", docs.columns)
    found = lang_id.identify(docs, model, lang_col=lang, score_col=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates. Rows that share a doc_id stay or go
    together; rows with a null doc_id, a null text or a text without words stay."""
    found = ngram_join.near_duplicates(docs, words=5, num=80, den=100)
    gone = stored(found.where("component_id <> doc_id").select("doc_id"))
    return drop_rows(docs, gone, {"doc_id": F.col("doc_id").cast("long")})


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. A row is known by its doc_id and its text, so rows with
    a null doc_id, and rows that share one, are judged each by its own text. Null texts stay; an empty benchmark drops
    nothing."""
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    gone = stored(found.where(F.size("spans") > 0).select("id", "h"))
    return drop_rows(docs, gone, {"id": F.col("doc_id").cast("long"), "h": F.xxhash64("text")})


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark; no row goes. A column n_chars is set to the new length. Null texts
    stay null."""
    spans = fresh("secret_spans", docs.columns)
    clean = secrets.redact(secrets.scan(docs, spans_col=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens; one row per piece. A null text has its end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Models and tokenizers can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
