"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Slot k of the schedule gets the golden-ratio point k * phi (mod 1); the point falls into one source's share of the
cumulative weights. Slots are ranked within their source, and rank r draws block r of the source's shuffled word
stream, over and over. All ranks and running sums are made in two levels (chunk totals, then inside a chunk), so no
window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.llm.common import KEY, WORD, keyed, stable, whole_text

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The golden ratio's fraction in 31 bits; odd, so that multiples visit every point once.
GOLDEN, POINTS = 1327217885, 2**31
#: Slots and documents per chunk when ranks are made, and buckets of the cumulative weights when points are looked up.
CHUNK, DOCS_CHUNK, SHARES = 65536, 16384, 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each new name, the sum of a column over the earlier rows in ``order`` (a total order).

    Two levels: totals of ranges of the order, then inside a range; so no task holds all rows. Sums must be exact
    (whole numbers or decimals), else they would depend on how rows are dealt.
    """
    dealt = stable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(of).alias(f"_of_{name}") for name, of in sums.items()])
    starts = ranges.select("_range", *[F.coalesce(F.sum(f"_of_{name}").over(before(Window.orderBy("_range"))), F.lit(0)).alias(f"_start_{name}") for name in sums])  # a row per range
    inside = before(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.join(starts, "_range")
    return placed.select(*rows.columns, *[(F.col(f"_start_{name}") + F.coalesce(F.sum(of).over(inside), F.lit(0))).alias(name) for name, of in sums.items()])


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, _no (its place), source_size, target: ``share`` of all words by weight, at most ``repeats`` times a source.

    What a full source can't take is shared again by weight among the rest. That fixed point is found in one pass: in
    the order of size by weight, a source is full when its cap is within its share of what the earlier ones left. The
    input has a row per source.
    """
    sources = running(sized.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_no": "_one"}).drop("_one")
    sources = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_no") % len(weights) + 1).cast("int")))
    sources = sources.withColumn("_ratio", F.col("source_size") / F.col("_w"))
    sources = stable(running(sources, [F.col("_ratio"), F.col("_no")], {"_sizes": "source_size", "_weights": "_w"}))
    total, heavy = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    level = (F.lit(share * total) - repeats * F.col("_sizes")) / (F.lit(heavy) - F.col("_weights"))  # words a unit of weight
    full = repeats * F.col("_ratio") <= level
    # every source that isn't full sees the same level as the first of them
    first = sources.where(~full).agg(F.min(F.struct("_ratio", "_no", level.alias("level")))).first()[0]
    return sources.select("source", "_no", "source_size", F.when(full, (repeats * F.col("source_size")).cast("double")).otherwise(F.col("_w") * F.lit(first["level"] if first else 0.0)).alias("target"))


def ranked(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column) -> DataFrame:
    """``rows`` with _before: the sum of ``value`` over the earlier rows of the same keys, by chunk and then by order."""
    rows = rows.withColumn("_chunk", chunk).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_of")).withColumn("_start", F.coalesce(F.sum("_of").over(earlier), F.lit(0))).drop("_of")
    return rows.join(starts, [*keys, "_chunk"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_start", "_value", "_chunk")


def mix(docs: DataFrame, *, block: int = 1024, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> tuple[DataFrame, DataFrame]:
    """The mixture and the sized documents.

    The mixture has a row per stretch of a document that a slot draws: slot, source, doc_id, pass (0: first use),
    start (word of the document), n_words, and _row, k1 and k2. Ordered by slot it is the training order. The sized
    documents have _row, doc_id, source, size, source_size, target. _row tells all rows apart; k1 and k2 are the row's
    key (``common.keyed``).

    Null texts have size 0 and are never drawn; a null source is a source of its own, after all others. Each source's
    words reach its target rounded down to whole words: slots beyond it are dropped, and what the schedule is short of
    a source (a few slots, by its discrepancy) follows at the end. Rows that repeat or lack a doc_id are documents of
    their own. Order comes from hashes of whole rows, so reruns agree. An empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    key = F.xxhash64("k1", F.lit(seed))
    measured = keyed(docs, "doc_id", "source", "text").select("doc_id", F.col("source").cast("string").alias("source"), word_count(whole_text()).alias("size"), key.alias("_key"), *KEY)
    sized = stable(measured.withColumn("_row", F.monotonically_increasing_id()))  # fixed once it is written
    sources = (
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, repeats=repeats)
        .withColumn("_words", F.floor("target").cast("long"))
        .withColumn("_blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.expr("_words div greatest(source_size, 1)")).otherwise(0))
        .withColumn("_need", F.col("_passes") * F.col("_blocks") + F.ceil((F.col("_words") - F.col("_passes") * F.col("source_size")) / block).cast("long"))
    )
    sources = stable(running(sources, [F.col("_no")], {"_lo": "_need"}).withColumn("_hi", F.col("_lo") + F.col("_need")))
    whole = sized.withColumnRenamed("source", "_source").join(sources.select("source", "_no", "source_size", "target"), F.col("_source").eqNullSafe(F.col("source"))).drop("_source")

    # the schedule: point -> source by bucketed lookup of the cumulative needs
    slots = sources.agg(F.sum("_need")).first()[0] or 0
    width = max(1, -(-slots // SHARES))
    shares = sources.where("_need > 0").select("_no", "_lo", "_hi", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}"))).alias("_bucket"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.least(F.floor((F.col("id") % POINTS * GOLDEN % POINTS) * (slots / POINTS)), F.lit(slots - 1)).cast("long").alias("_at"))
    drawn = points.withColumn("_bucket", F.expr(f"_at div {width}")).join(shares, "_bucket").where("_at >= _lo and _at < _hi").select("slot", "_no")
    drawn = ranked(drawn, ["_no"], F.expr(f"slot div {CHUNK}"), ["slot"], F.lit(1)).withColumnRenamed("_before", "_rank")
    short = sources.join(drawn.groupBy("_no").agg(F.count(F.lit(1)).alias("_got")), "_no", "left").where("_need > coalesce(_got, 0)")
    tail = short.select("_no", F.explode(F.sequence(F.coalesce("_got", F.lit(0)), F.col("_need") - 1)).alias("_rank"))
    plan = drawn.unionByName(tail.select(F.lit(slots).cast("long").alias("slot"), "_no", "_rank")).join(sources.select("_no", "_need", "_blocks", "source_size", "_words"), "_no").where("_rank < _need")
    plan = plan.select(
        F.when(F.col("slot") == slots, slots + F.col("_rank")).otherwise(F.col("slot")).alias("slot"), "_no", F.expr("_rank div _blocks").alias("pass"), (F.col("_rank") % F.col("_blocks")).alias("_block"),
        F.greatest(F.lit(0), F.least(F.lit(block), F.col("_words") - F.expr(f"(_rank div _blocks) * source_size + (_rank % _blocks) * {block}"))).alias("_take"),
    )

    # the blocks: each document's stretch of its source's shuffled stream, cut at block borders
    chunks = max(1, -(-sized.count() // DOCS_CHUNK))
    placed = ranked(whole.where("size > 0"), ["_no"], F.shiftright("_key", 64 - chunks.bit_length()), ["_key", *KEY], F.col("size"))
    pieces = placed.select("_row", *KEY, "doc_id", "source", "_no", "_before", "size", F.explode(F.sequence(F.expr(f"_before div {block}"), F.expr(f"(_before + size - 1) div {block}"))).alias("_block"))
    begin, end = F.greatest(F.col("_before"), F.col("_block") * block), F.least(F.col("_before") + F.col("size"), (F.col("_block") + 1) * block)
    pieces = pieces.select("_row", *KEY, "doc_id", "source", "_no", "_block", (begin - F.col("_before")).alias("start"), (begin - F.col("_block") * block).alias("_in"), (end - begin).alias("_long"))
    mixture = plan.join(pieces, ["_no", "_block"]).withColumn("n_words", F.least(F.col("_long"), F.col("_take") - F.col("_in"))).where("n_words > 0")
    return mixture.select("slot", "source", "doc_id", "pass", "start", "n_words", "_row", *KEY), whole.select("_row", "doc_id", "source", "size", "source_size", "target")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each row the mixture takes, repeats counted.

    Each row has its own count, also where rows repeat or lack a doc_id; further as in ``mix``.
    """
    mixture, sized = mix(docs, **options)
    taken = mixture.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    return sized.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: a row for each pass over a document, its text cut to the words that the pass takes.

    All other columns stay as they are. A null or empty text is never drawn.
    """
    mixture, _ = mix(docs, **options)
    passes = mixture.groupBy(*KEY, "_row", "pass").agg(F.sum("n_words").alias("words")).drop("_row", "pass")
    rows = keyed(docs).dropDuplicates(KEY).join(passes, KEY)  # equal rows have a share each, which one row of them serves
    text = F.col("row.text")
    # whole words from the front: within a pass a document's stretches follow each other
    front = F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.greatest("words", F.lit(1)).cast("int"))
    cut = F.when(F.col("words") >= word_count(F.coalesce(text, F.lit(""))), text).otherwise(F.concat_ws("", front))
    return rows.select(*[cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
