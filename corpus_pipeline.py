"""The corpus pipeline: documents that are good, distinct, mixed and encoded.

``STAGES`` lists the stages in order. Each function takes (spark, docs, sf_dir)
and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Defined cases: as the operators' docstrings say. In short: null texts count as
empty; documents without words are kept by the first stage if most documents
are good, are copies of each other in the second, stay in the third and are
never repeated for size in the fourth; null ids and sources are kept; an empty
table passes through; extra columns are carried to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import bpe, exact_dedup, mixing, near_dedup, quality
from scorecraft.llm.common import stage, table

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer keeps."""
    return quality.keep_good(docs)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8."""
    return near_dedup.drop_near_duplicates(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target needs."""
    return mixing.mix(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, n_tokens, ids`` (little-endian unsigned
    32-bit) and ``decoded_sha256``, the digest of the text decoded from them."""
    lexicon = bpe.compile_lexicon(docs, public_tokenizers.path(TOKENIZER))
    kept = docs.select("doc_id", "lang", "source", "n_chars", "text")
    rows = bpe.decode(bpe.encode(kept, lexicon).drop("text"), lexicon)
    return rows.select(
        "doc_id", "lang", "source", "n_chars", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

# SQL expresses neither the fitted scorer nor the encoding; tests/llm holds the
# pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return docs
