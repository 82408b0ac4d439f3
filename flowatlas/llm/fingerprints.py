"""Document fingerprints as Merkle trees over paragraphs and sections, in DataFrame operations only.

A section is a line with its end, and its paragraphs are the sentence-like pieces of it, of at most ``PIECE`` characters;
side by side they are the text. A paragraph's hash covers its text, a section's the hashes of its paragraphs, the root
the hashes of the sections. Equal roots mean equal texts; where roots differ, one goes on to the sections whose hashes
the other tree doesn't have, and in them to such paragraphs, which locates the edits wherever text was put in or taken out.

A fingerprint is the string ``root:section.paragraphs;section.paragraphs...``: each section's hash and, side by side,
those of its paragraphs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.llm.common import whole_text

#: Characters of a leaf at most, and hex digits of a leaf's and a section's hash.
PIECE, LEAF, SECTION = 200, 12, 16
#: Documents per bucket when neighbours by doc_id are looked up, and buckets at most (the bound of what is broadcast).
BUCKET, BUCKETS = 1024, 65536


def _short(x: Column, digits: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def leaves_of(text: Column) -> Column:
    """The pieces of a text in order; side by side they are the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)[^\n.!?]{{1,{PIECE}}}[.!?]*\n?|[.!?]+\n?|\n"), F.lit(0)), lambda x: F.length(x) > 0)


def sections_of(text: Column) -> Column:
    """The lines of a text with their ends; side by side they are the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)), lambda x: F.length(x) > 0)


def add_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with {name}_tree (sections with their hash and their paragraphs' hashes) and {name} (the fingerprint) of the text column."""
    hashes = F.transform(sections_of(F.col(text)), lambda line: F.transform(leaves_of(line), lambda x: _short(x, LEAF)))
    df = df.withColumn(f"{name}_leaves", hashes)
    df = df.withColumn(f"{name}_tree", F.transform(f"{name}_leaves", lambda x: F.struct(_short(F.concat_ws("", x), SECTION).alias("section"), x.alias("leaves"))))
    df = df.withColumn(f"{name}_leaves", F.flatten(f"{name}_leaves")).withColumn(f"{name}_sections", F.col(f"{name}_tree.section"))
    below = F.transform(f"{name}_tree", lambda s: F.concat(s["section"], F.lit("."), F.concat_ws("", s["leaves"])))
    return df.withColumn(name, F.concat(F.sha2(F.concat_ws("", f"{name}_sections"), 256), F.lit(":"), F.concat_ws(";", below)))


def likeness(a: str, b: str) -> Column:
    """Dice's coefficient of two trees' different leaves; 1 for two empty texts."""
    x, y = F.array_distinct(f"{a}_leaves"), F.array_distinct(f"{b}_leaves")
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(f"{a}_leaves", f"{b}_leaves")) / F.greatest(total, F.lit(1)))


def changed_sections(a: str, b: str) -> Column:
    """How many different sections of ``b`` tree ``a`` doesn't have, at any place."""
    return F.size(F.array_except(f"{b}_sections", f"{a}_sections"))


def changed_paragraphs(a: str, b: str) -> Column:
    """How many different paragraphs, in the changed sections of ``b``, tree ``a`` doesn't have; the other sections have none."""
    return F.size(F.array_except(f"{b}_leaves", f"{a}_leaves"))


def _at_or_below(bounds: Column, x: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= x))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document beside the next one by descending doc_id (after the last: the first).

    Documents are dealt into buckets by quantiles of doc_id, which hold alike however uneven the ids are, and sorted
    there, so a text crosses the network once; the last of a bucket meets the first of the next one because the latter
    is sent to both. Rows that repeat a doc_id follow each other by hash and text; rows without a doc_id come after all
    others, by hash, in buckets of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    buckets = max(1, min(BUCKETS, docs.count() // BUCKET))
    bounds = sorted(set(docs.select("doc_id").stat.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 1 / (8 * buckets)))) if buckets > 1 else []
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    spark = docs.sparkSession
    table = spark.createDataFrame([([p[0] for p in parts], parts)], "_coarse array<double>, _fine array<array<double>>")  # one row of at most BUCKETS numbers
    x, part = F.col("doc_id").cast("double"), F.col("_part")
    placed = docs.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(table)).withColumn("_part", _at_or_below(F.col("_coarse"), x))
    bucket = F.when(F.col("doc_id").isNull(), F.shiftright("_hash", 58) - 33).when(part == 0, 0).otherwise((part - 1) * step + _at_or_below(F.get("_fine", part - 1), x))
    docs = placed.withColumn("_bucket", bucket.cast("long")).drop("_part", "_coarse", "_fine")
    # a row per bucket: the first document (by descending doc_id) of each bucket goes to the bucket before too
    firsts = docs.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_hash")).alias("_first"))
    around = Window.orderBy(F.desc("_bucket"))
    before = F.coalesce(F.lag("_bucket").over(around), F.min("_bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marked = docs.join(F.broadcast(firsts.select("_bucket", "_first", before.alias("_also"))), "_bucket")
    own = F.struct(F.col("_bucket"), F.lit(False).alias("_copy"))
    is_first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_hash") == F.col("_first._hash"))
    sent = F.when(is_first, F.array(own, F.struct(F.col("_also").alias("_bucket"), F.lit(True).alias("_copy")))).otherwise(F.array(own))
    dealt = marked.select("doc_id", "text", "_hash", F.explode(sent).alias("_to")).select("doc_id", "text", "_hash", "_to.*")
    order = Window.partitionBy("_bucket").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("_hash"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not _copy").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edited_changed_sections, edited_changed_paragraphs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. Null texts are empty; a single document is its own next one. An empty text has a tree of no
    sections. An empty table gives no rows; further columns are ignored.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    df = with_next(docs).withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next")):
        df = add_tree(df, text, name)
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next").alias("near_next"), changed_sections("fingerprint", "edited_fingerprint").alias("edited_changed_sections"),
        changed_paragraphs("fingerprint", "edited_fingerprint").alias("edited_changed_paragraphs"),
    )
