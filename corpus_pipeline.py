"""A corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, source mixing, best-fit packing.

Every stage but the last returns the columns of ``documents``, further ones included, whatever their names; each is
written as Parquet in the shared checkpoint folder and read again as the next one's input. Stages tell rows apart by a
hash of the whole row, so rows that repeat or lack a doc_id are documents of their own, and of rows equal in all columns
one stays. Null texts count as empty, and an empty table passes every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowatlas.llm import exact_dedup, mixing, packing, quality, similar
from flowatlas.llm.common import keyed, only, shared_folder, stable, table
from flowatlas.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold.

    A null language is one of its own; documents without text go; rows that repeat are judged each.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then that of the smallest doc_id.

    Null and empty texts are one group; null ids lose ties. Rows of one id with different texts all stay.
    """
    return only(keyed(docs), stable(exact_dedup.decisions(docs).select("k1", "k2", "kept")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word similarities of 0.8 or more.

    Links come from the walk of the fingerprints' tries and are confirmed by the whole shingle sets. Null and empty
    texts are one group; null ids come last, and rows that tie in doc_id are ordered by their hashes.
    """
    kept = stable(similar.near_copies(docs).where("kept").select("k1", "k2").distinct())
    return keyed(docs).join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each pass over a document, cut to the words that the pass takes; n_chars follows the cut.

    Null and empty texts have no words and are never drawn. A null source is a source of its own.
    """
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. Null and empty texts are just the end token."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("source mixing", mixed), ("best-fit packing", packed)]

#: SQL can't express XXH64 fingerprints and their trie join, the tokenizer, or the language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages, read from what the last one wrote.

    The stages' folders lie in the shared checkpoint folder and go when that is cleared.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
