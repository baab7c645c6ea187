"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import (
    bpe, exact_dedup, lm, merkle, mixing, near_dedup, quality, sharding, topk, toxicity, url_filter, warc,
    whitening,
)
from scorecraft.llm.common import fold, lower_ascii, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled splitters: documents into 40 shards of near equal bytes."""
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-threshold histograms: how many words of each document the mix takes."""
    rows = mixing.repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__ssize").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__times")).alias("taken"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful streaming deduplication of the documents."""
    return exact_dedup.dedup_table(spark, f"{sf_dir.rstrip('/')}/documents.parquet").drop("file", "row")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels and the scorer trained on them, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs).select(F.col("__c0").alias("doc_id"), "votes", "posterior", "score", "kept")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches over 4-word shingles, exact at 0.8."""
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path rules, then trust and distrust over the host graph."""
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the 50k byte-level BPE."""
    docs = table(spark, sf_dir, "documents")
    lexicon = bpe.compile_lexicon(docs, public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "text"), lexicon).drop("text"), lexicon)
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram backoff automaton, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    rows = lm.score_texts(docs, train=fold(F.col("doc_id")) != 1)
    return rows.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four of five folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 0
    rows = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), docs.filter(~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of the documents by source, with checked proofs."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents")
    leaves = merkle.document_leaves(docs, tampered, lower_ascii(F.col("text")))
    return merkle.proofs(merkle.build_manifest(leaves)).withColumnRenamed("id", "doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 8 whitened components of largest variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC, normalised and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


REGISTRY = {
    f.__name__: f
    for f in (
        op1_sharding, op2_mixing, op3_exact_dedup, op4_quality, op5_near_dedup,
        op6_url_filter, op7_bpe, op8_lm, op9_toxicity, op10_topk, op11_merkle, op12_whitening,
        op13_warc,
    )
}
