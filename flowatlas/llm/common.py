"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowatlas.sources.store import shared_checkpoint, shared_folder  # noqa: F401

#: The six ASCII white-space characters; the same set as [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A word in the sense of most operators here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    return shared_checkpoint(df)


def whole_text(name: str = "text") -> Column:
    """The text column, with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns of a row key.
KEY = ["k1", "k2"]


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs``, ``row`` (all columns as one struct, so that no name can clash) and the row's key.

    The key is 128 bits of hash over all columns: rows share it just if they are equal in every column. Rows that
    repeat or lack a doc_id are told apart by it, and equal rows, which nothing tells apart, can stand for each other.
    """
    parts = []
    for field in docs.schema.fields:
        value = F.col(f"`{field.name}`")
        parts += [value.isNull(), value if field.dataType.typeName() not in ("map", "array", "struct", "variant") else value.cast("string")]
    every = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    return docs.select(*columns, every.alias("row"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))


#: Bits of a broadcast map of keys: 262 144 rows of 64 bits at most.
MAP = 1 << 24


def _bit(hashed: Column) -> tuple[Column, Column]:
    """The row of the map that a hash falls in, and its bit there."""
    bit = F.pmod(hashed, F.lit(MAP))
    return F.shiftright(bit, 6), (bit % 64).cast("int")


def bit_map(keys: DataFrame, hashed: Column) -> DataFrame:
    """(at, bits): which bits the hashes of ``keys`` fall in; bounded whatever the number of keys."""
    at, n = _bit(hashed)
    return stable(keys.groupBy(at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), n)).alias("bits")))


def _marked(hashed: Column) -> Column:
    """Whether the bit of a hash is set, beside the map's ``bits``."""
    return F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), _bit(hashed)[1]).bitwiseAND(F.lit(1)) == 1


def possible(rows: DataFrame, hashed: Column, words: DataFrame) -> DataFrame:
    """The rows whose bit of the map is set: all that have one of its keys, and some that share a bit with one."""
    return rows.join(F.broadcast(words), _bit(hashed)[0] == F.col("at")).where(_marked(hashed)).drop("at", "bits")


def only(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The columns of each row of ``keyed`` documents that ``decided`` (k1, k2, kept) keeps, once for each key.

    ``decided`` has a row for each of the documents. Rows whose key is there once and kept stay where they are; only those
    whose bit of the map is set, because their key or another one is in doubt, are sent to be looked up.
    """
    doubt = decided.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("all")).where("n > 1 or not all")
    key = F.col("k1")
    marked = rows.join(F.broadcast(bit_map(doubt, key)), _bit(key)[0] == F.col("at"), "left")
    unsure = _marked(key)
    kept = decided.where("kept").select(*KEY)
    looked_up = marked.where(unsure).join(kept, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
    return marked.where(~unsure).select("row.*").union(looked_up)
