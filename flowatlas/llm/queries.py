"""The registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowatlas.llm import (
    alignment, chat, clustering, exact_dedup, fingerprints, html_extract, licenses, lm_score, mixing, near_dedup, packing, quality, toxicity,
)
from flowatlas.llm.common import table

#: The chain's categories: poor text, abuse, abuse within poor text.
CATEGORIES = ["poor", "toxic", "toxic_poor"]


def chain_labels(labels: DataFrame) -> DataFrame:
    poor, toxic = 1 - F.col("quality"), F.col("toxic")
    return labels.select("doc_id", poor.alias("poor"), toxic.alias("toxic"), (poor * toxic).alias("toxic_poor"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def aligned_tokenizers() -> tuple[str, str, str, str]:
    import public_tokenizers as tokenizers

    return (*[tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")], tokenizers.PATTERN)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license labels of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learned from those that are not held out."""
    return lm_score.scored(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), chain_labels(table(spark, sf_dir, "labels")), CATEGORIES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mixture takes."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision for every document."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", F.exp("log_ppl").alias("perplexity"), F.exp("threshold").alias("threshold"), "kept")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads back from every formatted conversation, and from one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.digests(rows.unionByName(odd))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and the links' counts of every document's tokens by two tokenizers."""
    return alignment.aligned(table(spark, sf_dir, "documents"), aligned_tokenizers())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extraction, op2_document_fingerprints, op3_license_scans, op4_lm_scoring, op5_toxicity, op6_best_fit_packing, op7_exact_dedup,
        op8_source_mixing, op9_quality_classifier, op10_simhash_near_dedup, op11_centroid_clustering, op12_chat_formatting, op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in found}
