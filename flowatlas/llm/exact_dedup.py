"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined three times: inside each map task (the partial aggregate), then among salted shares of a digest,
then among the salts' winners. Every time the grouping key holds the whole normalised text beside its digest, so that
rows are only ever combined when their full content is the same.

Only digests that hold over a thousandth of all rows are salted, so at most a thousand digests are: that is the proven
bound of the one broadcast table. Texts of other digests cross the network once; of salted ones a second time, one
text per salt.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.llm.common import KEY, WHITE_SPACE, keyed, stable, whole_text

#: A digest is salted from this share of the rows on, and never below LEAST_HOT rows.
HOT_SHARE, LEAST_HOT = 1000, 1000
#: Values of the bits of a row's key that break ties.
TIE = 2**26


def squeezed(text: Column) -> Column:
    """The text without any ASCII white space."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, *, salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they are identical without ASCII white space. Of equal texts the one with the most code
    points stays, then the smallest doc_id; just one row of each group is kept. A null text is the empty text, and all
    empty texts are copies of each other. A null doc_id loses every tie. Of rows that agree in doc_id and length, one is
    kept by a hash of the row, and of rows equal in all columns any one. An empty table gives no rows, and further
    columns of ``docs`` don't show in the result. Should two different texts ever share SHA-256, XXH64 and length, the
    query fails rather than merge them.
    """
    return decisions(docs, salts=salts).drop(*KEY)


def decisions(docs: DataFrame, *, salts: int = 32) -> DataFrame:
    """``exact_dedup`` with the key of each row (``common.keyed``) beside it."""
    rows = (
        keyed(docs, "doc_id", "text").select("doc_id", whole_text().alias("_t"), *KEY)
        .select("doc_id", *KEY, F.char_length("_t").alias("_n"), squeezed(F.col("_t")).alias("_body"))
        .withColumn("_sha", F.sha2("_body", 256))
        .withColumn("_xx", F.xxhash64("_body"))
        .withColumn("_len", F.octet_length("_body"))
    )
    # one number orders the candidates: code points, then the smaller doc_id (null ids last), then bits of the row's key
    tie = F.col("k1").bitwiseAND(F.lit(TIE - 1))
    id_place = F.coalesce(F.lit(Decimal(2**63)) - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    best = (F.col("_n").cast("decimal(10,0)") * F.lit(Decimal(2**65 * TIE)) + id_place * F.lit(Decimal(TIE)) + tie.cast("decimal(10,0)")).cast("decimal(38,0)")
    rows = rows.withColumn("_best", best).withColumn("_tie", tie)
    light = stable(rows.select("doc_id", *KEY, "_sha", "_xx", "_len", "_best", "_tie"))
    least = max(light.count() // HOT_SHARE, LEAST_HOT)
    hot = F.broadcast(light.groupBy("_sha").count().where(F.col("count") > least).select("_sha", F.lit(True).alias("_hot")))

    salt = F.pmod(F.col("_tie"), F.lit(salts)).cast("int")  # rows that could be one another's copies share their salt
    salted = (
        rows.join(hot, "_sha", "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt))
        .groupBy("_sha", "_xx", "_len", "_salt", "_body")
        .agg(F.max("_best").alias("_best"), F.count(F.lit(1)).alias("_rows"))
    )
    # what isn't salted is final; its text isn't sent again
    winners = (
        salted.select("_sha", "_xx", "_len", F.when(F.col("_salt").isNotNull(), F.col("_body")).alias("_body"), "_best", "_rows", F.when(F.col("_salt").isNull(), 1).otherwise(0).alias("_final"))
        .groupBy("_sha", "_xx", "_len", "_body")
        .agg(F.max("_best").alias("_best"), F.sum("_rows").alias("_rows"), F.sum("_final").alias("_final"))
    )
    # the winner's id, out of the number again
    rest = F.col("_win") % F.lit(Decimal(2**65 * TIE))
    place = ((rest - rest % F.lit(Decimal(TIE))) / F.lit(Decimal(TIE))).cast("decimal(20,0)")
    every_salt = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    classes = (
        winners.groupBy("_sha", "_xx", "_len")
        .agg(F.max("_best").alias("_win"), F.sum("_rows").alias("_rows"), F.max(F.col("_body").isNotNull()).alias("_hot"), F.sum(F.greatest("_final", F.lit(1))).alias("_texts"))
        .withColumn("_rows", F.when(F.col("_texts") == 1, F.col("_rows")).otherwise(F.raise_error(F.lit("two different texts share all digests"))))
        .select("_sha", "_xx", "_len", "_rows", "_win", F.when(place > 0, (F.lit(Decimal(2**63)) - place).cast("long")).alias("_keep"), every_salt.alias("_salt"))
    )
    found = light.join(hot, "_sha", "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).join(classes, ["_sha", "_xx", "_len", "_salt"])
    # rows equal in every column share the winner's number: the first of them is kept
    won = F.col("_best") == F.col("_win")
    place_there = F.row_number().over(Window.partitionBy("_sha", "_xx", "_len", "_salt").orderBy(F.desc(won), *KEY))
    return found.select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_rows").alias("group_size"), (won & (place_there == 1)).alias("kept"), F.col("_sha").alias("text_sha256"), *KEY
    )
