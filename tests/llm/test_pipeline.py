import random

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowatlas.llm import queries, similar, sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    a, b = queries.queries()[name](spark, FOLDER).toPandas(), c.sql(sql.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    pd.testing.assert_frame_equal(a[columns].sort_values(columns).reset_index(drop=True), b[columns].sort_values(columns).reset_index(drop=True), check_dtype=False)


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            texts = docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("t"))
            assert texts.distinct().count() == sizes[-1]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def odd_documents(spark):
    rows = [(1, "same text here", "en", "a", 0), (1, "same text here", "en", "a", 0), (2, "same  text here", "en", None, 0), (3, None, None, "b", None), (None, "no id " * 3, "en", "b", 0), (4, "word " * 9000, "de", "c", 0), (5, "", "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_none(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_documents(spark)
    out = stage(spark, docs, FOLDER)
    rows = out.collect()
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if k < 4:
        assert out.columns == docs.columns
    if name == "exact dedup":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 2, 3, 4]  # the longest of the equal texts stays
    if name == "source mixing":
        assert any(r.doc_id is None for r in rows) and all(r.n_chars == len(r.text) for r in rows)


CLASHES = ["pass", "_words", "words", "_id", "_mid", "_lang", "kept", "log_ppl", "threshold", "_sha", "row", "k1", "k2", "node", "_row", "n", "a.b"]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_clashing_columns_and_rows_that_share_an_id(spark, k):
    """No text is lost with another one's id, and further columns come through unchanged."""
    name, stage = corpus_pipeline.STAGES[k]
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["the", "house", "and", "river", "of", "small", "light", "garden"]) for _ in range(40))
    one, two, three = line(), line(), line()
    rows = [(1, one), (5, one), (5, two), (None, one), (None, one.replace(" ", "  ", 1)), (None, three), (7, three + " end"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    found = out.collect()
    assert all(r[c] == c + ("none" if r.doc_id is None else str(r.doc_id)) for r in found for c in CLASHES)
    got = sorted((r.doc_id or 0, r.text or "") for r in found)
    if name == "exact dedup":
        assert got == sorted([(0, one.replace(" ", "  ", 1)), (5, two), (0, three), (7, three + " end"), (7, "")])
    if name == "SimHash near-dedup":
        assert got == sorted([(1, one), (5, two), (7, three + " end"), (7, "")])
    if name == "source mixing":
        assert sum(len(t.split()) for _, t in got) == int(1.5 * sum(len((t or "").split()) for _, t in rows))


def test_repeated_rows_leave_one(spark):
    docs = odd_documents(spark).where("doc_id = 1")
    assert corpus_pipeline.exact_copies(spark, docs, FOLDER).count() == 1


def brute_components(texts):
    """The smallest index reachable by five-word Jaccard similarities of 0.8 or more."""
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("group, large", [(8, 1 << 15), (2, 1 << 15), (2, 5)])
def test_near_copies_against_brute_force(spark, group, large):
    dice = random.Random(5)
    fresh = lambda n: [f"w{dice.randrange(5000)}" for _ in range(n)]
    common = fresh(60)
    texts = [fresh(dice.randrange(1, 200)) for _ in range(60)] + [common + fresh(25) for _ in range(10)]
    for base in texts[:25] + [texts[0]] * 12 + [texts[60]] * 8:  # edits that leave some pairs above and some below 0.8
        copy = list(base)
        for _ in range(dice.randrange(1, 5)):
            copy[dice.randrange(len(copy))] = "edit" + str(dice.randrange(10**6))
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", " ", texts[3][0].upper()]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    expected = brute_components(texts)
    assert len(set(expected)) < len(texts) - 10
    found = {r.doc_id: r.component_id for r in similar.near_copies(docs, group=group, large=large).collect()}
    assert [found[i] for i in range(len(texts))] == expected
    if group == 8:
        assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()) == sorted(set(expected))
