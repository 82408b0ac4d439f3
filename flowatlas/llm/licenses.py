"""License scans by an exact set-similarity join, in DataFrame operations only.

Every line of every text is a block; a block matches a template when it holds at least ``THRESHOLD`` of the template's
different words. With need = ceil(threshold * size), a matching block shares a word with the template's prefix: its
size - need + 1 rarest words. Rarity is measured over the whole corpus. Blocks too short to hold ``need`` words are
dropped (length filter), and a shared prefix word at place i leaves at most size - i words to share from there on,
and the block likewise (positional filter).

Beside it, phrases are found word by word: places where the words of a phrase follow one another.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import KEY, keyed, whole_text

#: What parts words: all of ASCII but digits and letters. Case is folded for A-Z only.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short grants as licenses are commonly stated in one line, with the label each gets.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "lgpl": "this library is licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mpl": "subject to the terms of the mozilla public license version 2 0",
    "reserved": "all rights reserved",
}
THRESHOLD = 0.8


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column) -> Column:
    """The words in their order, with empty ends where the text starts or ends between words.

    A split costs a fifth of extracting or counting the matches of a pattern for words.
    """
    return F.split(_ascii_lower(text), NO_WORD)


def corpus_ranks(blocks: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """The place of every template word in the order of rarity over all blocks; as many rows as templates have words."""
    counts = blocks.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rows")).collect()
    rows = {r["word"]: r["rows"] for r in counts}
    vocabulary = {w for t in templates.values() for w in t.split()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (rows.get(w, 0), w)))}


def template_matches(docs: DataFrame, *, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, key: list[str] | None = None) -> DataFrame:
    """doc_id, block, label, containment, text: every line that holds enough of a template. ``key`` names documents by other columns than doc_id.

    Null texts are empty and match nothing; rows that repeat a doc_id give their matches each; empty tables none.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    vocabulary = sorted({w for words in sets.values() for w in words})
    key = key or ["doc_id"]
    lines = docs.select(*key, F.posexplode(F.split(whole_text(), "\n")).alias("block", "text"))
    # words outside the templates can't be shared
    blocks = lines.withColumn("_words", F.array_intersect(split_words(F.col("text")), F.array(*map(F.lit, vocabulary))))
    ranks = corpus_ranks(blocks, templates)
    prefixes = []
    for label, words in sets.items():
        need = math.ceil(len(words) * threshold - 1e-9)
        prefixes += [(w, label, len(words), need, i) for i, w in enumerate(sorted(words, key=ranks.get)[: len(words) - need + 1])]
    prefix = docs.sparkSession.createDataFrame(prefixes, "word string, label string, size int, need int, place int")
    rank = F.create_map(*[F.lit(x) for w, i in ranks.items() for x in (w, i)])
    rare = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes})])
    ordered = F.transform(F.array_sort(F.transform("_words", lambda w: F.struct(rank[w].alias("rank"), w.alias("word")))), lambda x: x["word"])
    probes = blocks.where(F.arrays_overlap("_words", rare)).withColumn("_words", ordered).select(*key, "block", "text", "_words", F.posexplode("_words").alias("at", "word"))
    pairs = probes.join(F.broadcast(prefix), "word").where(F.size("_words") >= F.col("need"))  # length filter
    first = pairs.groupBy(*key, "block", "text", "_words", "label", "size", "need").agg(F.min(F.struct("place", "at")).alias("first"))
    possible = F.least(F.col("size") - F.col("first.place"), F.size("_words") - F.col("first.at"))  # positional filter
    whole = F.create_map(*[x for label, words in sets.items() for x in (F.lit(label), F.array(*map(F.lit, words)))])
    shared = F.size(F.array_intersect("_words", whole[F.col("label")]))
    return first.where(possible >= F.col("need")).withColumn("shared", shared).where("shared >= need").select(*key, "block", "label", (F.col("shared") / F.col("size")).alias("containment"), "text")


def phrase_places(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``docs`` but text, and n_words, n_base, first_word, last_word, _labels: the places where phrases stand, counted in words."""
    kept = [c for c in docs.columns if c != "text"]
    phrases = PHRASES if phrases is None else phrases
    w = F.col("_w")
    found = docs.select(*kept, F.array_remove(split_words(whole_text()), "").alias("_w"))

    def places(phrase: str) -> Column:
        """All starts of the phrase; places are only tried in texts that hold each of its words."""
        parts = phrase.split()
        here = lambda i: reduce(and_, [F.get(w, i + k) == part for k, part in enumerate(parts)])
        there = reduce(and_, [F.array_contains(w, part) for part in sorted(set(parts))])
        return F.when(there, F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)).otherwise(F.array().cast("array<int>"))

    spots = found.select(*kept, F.size(w).cast("long").alias("n_words"), *[places(p).alias(f"_p{i}") for i, p in enumerate(phrases)])
    every = F.concat(F.array().cast("array<int>"), *[F.col(f"_p{i}") for i in range(len(phrases))])
    labels = F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]), lambda x: x.isNotNull()))
    return spots.select(*kept, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("_labels"))


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the highest containment of a matching template, else 0. Null texts are
    empty: 0 words, no labels. Rows that repeat or lack a doc_id keep their own labels: rows are told apart by a hash of
    all columns. An empty table gives no rows; further columns are ignored.
    """
    rows = keyed(docs, "doc_id", "text").drop("row")
    found = template_matches(rows, templates=templates, threshold=threshold, key=KEY).groupBy(*KEY).agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))  # a set of labels: bounded by the templates
    joined = phrase_places(rows).join(found, KEY, "left")
    text = lambda x: F.concat_ws(",", F.array_sort(x))
    every = F.array_union("_labels", F.coalesce("_found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", text("_labels").alias("base_labels"), text(every).alias("labels"), score.alias("score"))
