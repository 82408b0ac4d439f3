"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of one- and two-word sequences are gathered over all training documents. A count c is kept as its level
1 + floor(log_BASE(c)): the sequence is entered once for each level up to its own, and a reader probes level after
level until one is missing. Smoothed probabilities mix the two-word estimate with the one-word estimate, both from
probed levels.

Sequences are dealt to filter segments by their hash, a segment for each ``SEGMENT_TEXT`` bytes of text, so a segment's
counts are summed and its bits set in one task whatever the size of the corpus. Each segment sizes itself by what it
holds, and every sequence is kept. The one-word filter is broadcast (at most ``MAX_WORDS`` bytes, else it is an error).
The pair filter is broadcast too while it has at most ``MAX_BYTES``; a larger one stays where its segments are, and the
documents' pairs are sent there once to be probed, with the same scores. Segments with many pairs are salted.

The exact one-word score beside it needs every word's count: frequent words (at most ``COMMON`` of them) are looked
up in the workers, the others are joined by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import stable

#: Bytes of text per filter segment, least segments (as a power of two), pairs probed in one task on average.
SEGMENT_TEXT, LEAST_SEGMENTS, SALTED = 8 << 20, 6, 1 << 21
#: Probes a level, bits an entry, base of the levels, levels probed at most, bytes of the filters that are broadcast.
PROBES, BITS, BASE, LEVELS, MAX_BYTES, MAX_WORDS = 4, 8, 2.0, 40, 128 << 20, 1 << 30
#: Words whose exact counts are broadcast.
COMMON = 1 << 18
#: Sequences gathered in a worker before they are sent on; words a worker remembers.
GATHER, REMEMBERED = 2 << 20, 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_memory: dict[bytes, bytes] = {}
END = xxhash.xxh64_digest(b"</s>", 1)[::-1]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Per text the 64-bit hashes of its words and of the end token, which no word can equal by another seed."""
    split = [(t or "").encode().lower().split() for t in texts]
    if len(_memory) > REMEMBERED:
        _memory.clear()
    for words in split:
        for w in {w for w in words if w not in _memory}:
            _memory[w] = xxhash.xxh64_digest(w, 0)[::-1]
    get = _memory.__getitem__
    return [np.frombuffer(b"".join(map(get, words)) + END, "<u8") for words in split]


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the two-word sequences; the first word follows the end token of nothing."""
    before = np.concatenate((np.frombuffer(END, "<u8"), words[:-1]))
    return stir(before * _MIX + np.uint64(1) ^ stir(words))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def positions(keys: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of a key at a level, probe by probe."""
    h = stir(keys ^ (np.uint64(0xD6E8FEB86659FD93) * np.asarray(level, np.uint64)))
    step = (h >> np.uint64(17)) | np.uint64(1)
    for _ in range(PROBES):
        yield (h >> np.uint64(8)) % np.asarray(bits, np.uint64)
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + step


def segment_of(keys: np.ndarray, power: int) -> np.ndarray:
    """The segment, of 2 ** power ones, of each key."""
    return (keys >> np.uint64(64 - power)).astype(np.int64)


def segment_power(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(LEAST_SEGMENTS, (size // SEGMENT_TEXT).bit_length())


def gathered(docs: DataFrame, power: int) -> DataFrame:
    """(segment, kind, keys, counts): packed sequences of the documents with their counts, summed as far as a worker goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def send() -> pa.RecordBatch:
            rows = []
            for kind, parts in enumerate(held):
                keys, counts = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
                cuts = np.searchsorted(segment_of(keys, power), np.arange(2**power + 1))
                rows += [(s, kind, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
                parts.clear()
            columns = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["segment", "kind", "keys", "counts"])

        for whole in batches:
            for k in range(0, whole.num_rows, 128):  # a batch's words at once would be far larger than its text
                for words in word_hashes(whole.slice(k, 128).column(0).to_pylist()):
                    held[0].append(words)
                    held[1].append(pairs_of(words))
                    size += 2 * len(words)
                if size > GATHER:
                    yield send()
                    size = 0
        yield send()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "segment int, kind int, keys binary, counts binary")


def _summed(shard: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    mine = [i for i, k in enumerate(shard.column("kind").to_pylist()) if k == kind]
    join = lambda name, t: np.frombuffer(b"".join(shard.column(name)[i].as_py() for i in mine), t)
    keys, at = np.unique(join("keys", "<u8"), return_inverse=True)
    return keys, np.bincount(at, join("counts", "<u4"), len(keys)).astype(np.int64)


def field_of(keys: np.ndarray, level: np.ndarray, entry: int = BITS) -> bytes:
    """The packed bits of the keys at all levels up to their own."""
    bits = int(max(64, entry * level.sum()))
    bits += -bits % 8
    field = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in positions(keys[level >= j], j, bits):
            field[at.astype(np.int64)] = True
    return np.packbits(field, bitorder="little").tobytes()


def build(docs: DataFrame, power: int, entry: int = BITS) -> DataFrame:
    """(segment, kind, key, count, packed): exact one-word counts, and for each segment a row with its filter of either kind.

    The count in a pair filter's row is that of pair occurrences whose pair would still be in the filter without them;
    their share of all tokens is the weight of the two-word estimate (left-one-out). Its key is the number of all
    pair occurrences.
    """

    def run(shard: pa.Table) -> pa.Table:
        segment = shard.column("segment")[0].as_py()
        keys, counts = _summed(shard, 0)
        pairs, many = _summed(shard, 1)
        still = int(many[many > 1].sum())  # occurrences whose pair would be known without them
        n = len(keys)
        packed = [None] * n + [field_of(keys, levels_of(counts), entry), field_of(pairs, levels_of(many), entry)]
        kind = np.append(np.zeros(n + 1, np.int32), np.int32(1))
        return pa.table({"segment": pa.array([segment] * (n + 2), pa.int32()), "kind": pa.array(kind), "key": pa.array(np.append(keys.view(np.int64), [0, int(many.sum())])), "count": pa.array(np.append(counts, [0, still])), "packed": pa.array(packed, pa.binary())})

    return gathered(docs, power).groupBy("segment").applyInArrow(run, "segment int, kind int, key long, count long, packed binary")


class Filter:
    """Segments as one bit field with each segment's first bit and size; segments that are not there are empty."""

    def __init__(self, segments: dict[int, bytes], power: int):
        every = range(2**power)
        sizes = np.array([8 * len(segments.get(s, b"")) for s in every], np.int64)
        self.power = power
        self.size = np.maximum(sizes, 1).astype(np.uint64)
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.uint64)
        self.empty = sizes == 0
        self.field = np.frombuffer(b"".join(segments.get(s, b"") for s in every) + bytes(8), np.uint8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes from 1 up until one is missing."""
        level = np.zeros(len(keys), np.int64)
        segment = segment_of(keys, self.power)
        left = np.flatnonzero(~self.empty[segment])
        for j in range(1, LEVELS + 1):
            size, first = self.size[segment[left]], self.first[segment[left]]
            there = np.ones(len(left), bool)
            for at in positions(keys[left], j, size):
                at += first
                there &= (self.field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            left = left[there]
            if not len(left):
                break
            level[left] = j
        return level


def estimate(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the geometric middle of its range, 0 for none."""
    return np.where(level > 0, np.where(level == 1, 1.0, BASE ** (level - 0.5)), 0.0)


def mixed(level: np.ndarray, single: np.ndarray, context: np.ndarray, weight: float, denominator: float) -> np.ndarray:
    """log10 probability of a token: from the estimates of its pair, itself and its context, the latter above 0 for a pair to count."""
    p_one = (single + 0.5) / max(denominator, 1.0)
    p_two = np.minimum(level / np.maximum(context, 1e-9), 1.0)
    return np.log10(np.minimum(np.where(context > 0, weight * p_two + (1 - weight) * p_one, p_one), 1.0))


class Batch:
    """Words of some documents: flat hashes, each document's first place, the hash before each word."""

    def __init__(self, texts: list[str | None]):
        words = word_hashes(texts)
        lengths = np.array([len(w) for w in words])
        self.n, self.lengths, self.starts = len(words), lengths, np.cumsum(lengths) - lengths
        self.flat = np.concatenate(words)
        self.before = np.concatenate([np.concatenate((np.frombuffer(END, "<u8"), w[:-1])) for w in words])
        self.pairs = np.concatenate([pairs_of(w) for w in words])
        self.doc = np.repeat(np.arange(self.n), lengths)
        self.one, self.at_one = np.unique(self.flat, return_inverse=True)

    def levels(self, words: Filter) -> tuple[np.ndarray, np.ndarray]:
        """The levels of each word and of the word before it."""
        level = words.level(self.one)
        there = np.searchsorted(self.one, self.before).clip(max=len(self.one) - 1)
        return level[self.at_one], np.where(self.one[there] == self.before, level[there], words.level(self.before) if (self.one[there] != self.before).any() else 0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 128):
            yield whole.slice(k, 128)


def _sent_to_segments(plain: DataFrame, filters: DataFrame, words: object, power: int, salts: dict[int, int], weight: float, denominator: float) -> DataFrame:
    """(doc_id, held_out, row, score): the score of all tokens with a known context, probed where the pair segments are."""
    token = [("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("one", "u1"), ("context", "u1"), ("held", "u1"), ("null", "u1")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(_batches(batches)):
            b = Batch(batch.column(1).to_pylist())
            one, context = b.levels(words.value[0])
            rows = np.zeros(len(b.flat), token)
            rows["key"], rows["one"], rows["context"] = b.pairs, one, context
            rows["doc"] = batch.column(0).fill_null(0).to_numpy()[b.doc]
            rows["row"] = batch.column(3).to_numpy()[b.doc]
            rows["held"], rows["null"] = batch.column(2).to_numpy(zero_copy_only=False)[b.doc], batch.column(0).is_null().to_numpy(zero_copy_only=False)[b.doc]
            rows = rows[context > 0]
            segment = segment_of(rows["key"], power)
            order = np.argsort(segment, kind="stable")
            cuts = np.searchsorted(segment[order], np.arange(2**power + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            salt = [number % salts.get(s, 1) for s in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(salt, pa.int32()), pa.array([rows[order[cuts[s] : cuts[s + 1]]].tobytes() for s in full], pa.binary())], names=["segment", "salt", "packed"])

    def probe(sent: pa.Table, kept: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(sent.column("packed").to_pylist()), token)
        model = Filter({s: bytes(f) for s, f in zip(kept.column("segment").to_pylist(), kept.column("filter").to_pylist())}, power)
        score = mixed(estimate(model.level(rows["key"])), estimate(rows["one"].astype(np.int64)), estimate(rows["context"].astype(np.int64)), weight, denominator)
        who, at = np.unique(rows[["doc", "row", "held", "null"]], return_inverse=True)
        ids = pa.array(who["doc"], pa.int64(), mask=who["null"].astype(bool))
        return pa.table({"doc_id": ids, "held_out": pa.array(who["held"].astype(bool)), "row": pa.array(who["row"]), "score": pa.array(np.bincount(at, score, len(who)).astype(float))})

    many = F.create_map(*[F.lit(x) for s, n in salts.items() for x in (s, n)]) if salts else None
    times = F.coalesce(many[F.col("segment")], F.lit(1)) if salts else F.lit(1)
    copies = filters.where("kind = 1").select("segment", F.explode(F.sequence(F.lit(0), times - 1)).alias("salt"), F.col("packed").alias("filter"))
    sent = plain.mapInArrow(deal, "segment int, salt int, packed binary")
    return sent.groupBy("segment", "salt").cogroup(copies.groupBy("segment", "salt")).applyInArrow(probe, "doc_id long, held_out boolean, row long, score double")


def scored(docs: DataFrame, *, max_bytes: int = MAX_BYTES, entry: int = BITS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod 5 is 1 are held out; the others are learned from. Tokens are the
    lower-cased (A-Z) words and one end. base_score is the exact add-half one-word score; score is the model's log10
    probability. Null and empty texts have just the end token. A null doc_id is never held out. Rows that repeat
    or lack a doc_id are documents of their own, told apart by a hash of the row; rows equal in all columns are scored
    once and come as often as they are there. With no training documents every word is unknown. An empty table gives no rows; further columns are ignored. Words are told apart by 64-bit hashes.
    The filters have ``entry`` bits for each sequence and level, so how full they are doesn't depend on the corpus.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"), row.alias("row"))
    power = segment_power(plain)
    built = stable(build(plain.where("not held_out"), power, entry))
    counts = built.where("packed is null").select("key", "count")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    # common words are those from a count level on that at most COMMON words reach; levels are a few hundred at most
    eighth = F.floor(F.log2("count") * 8).cast("int")
    there = {r["eighth"]: r["n"] for r in counts.groupBy(eighth.alias("eighth")).agg(F.count(F.lit(1)).alias("n")).collect()}
    edge, reached = 1 << 20, 0
    for level in sorted(there, reverse=True):
        reached += there[level]
        if reached > COMMON:
            break
        edge = level
    filters = built.where("packed is not null")
    gather = lambda kind: {r["segment"]: bytes(r["packed"]) for r in filters.where(f"kind = {kind}").select("segment", "packed").toLocalIterator()}
    sizes = filters.groupBy("kind").agg(F.sum(F.octet_length("packed")).alias("size"), F.sum("count").alias("count")).collect()
    size, again = {r["kind"]: r["size"] for r in sizes}, {r["kind"]: r["count"] for r in sizes}
    if size.get(0, 0) > MAX_WORDS:
        raise RuntimeError(f"the one-word filter has {size[0]} bytes; workers hold at most {MAX_WORDS}")
    weight = min(0.95, again.get(1, 0) / max(total, 1))
    common = counts.where(eighth >= edge).toPandas().sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((Filter(gather(0), power), common["key"].to_numpy(np.int64).view(np.uint64), common["count"].to_numpy(np.int64)))
    here = size.get(1, 0) <= max_bytes
    pairs_model = spark.sparkContext.broadcast(Filter(gather(1), power)) if here else None
    denominator = total + 0.5 * (distinct + 1)
    log_none = float(np.log10(0.5 / denominator)) if denominator else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_model, keys, known = shared.value
        for batch in _batches(batches):
            b = Batch(batch.column(1).to_pylist())
            one, context = b.levels(words_model)
            if here:
                two, at_two = np.unique(b.pairs, return_inverse=True)
                level = estimate(pairs_model.value.level(two))[at_two]
            else:  # tokens with a known context are scored where the pair segments are
                level = np.zeros(len(b.flat))
            log = mixed(level, estimate(one), estimate(context), weight, denominator)
            score = np.add.reduceat(log if here else np.where(context > 0, 0.0, log), b.starts)
            # the base: common words here, the others as (key, times) to be joined
            place = np.searchsorted(keys, b.one).clip(max=max(len(keys) - 1, 0))
            hit = keys[place] == b.one if len(keys) else np.zeros(len(b.one), bool)
            value = np.where(hit, np.log10((known[place] + 0.5) / denominator), 0.0) if len(keys) else np.zeros(len(b.one))
            base = np.add.reduceat(value[b.at_one], b.starts)
            n_known = np.add.reduceat(hit[b.at_one].astype(np.int64), b.starts)
            rare = ~hit[b.at_one]
            # rows: one per document that carries its own figures, then (document, rare word, times)
            pair, times = np.unique(b.doc[rare] * len(b.one) + b.at_one[rare], return_counts=True)
            owner, word = pair // len(b.one), b.one[pair % len(b.one)]
            n, m = b.n, len(word)
            take = pa.array(np.concatenate((np.arange(n), owner)))
            none = np.zeros(m, np.int64)
            columns = {
                "copies": (np.ones(n, np.int64), none), "key": (np.full(n, -1), word.view(np.int64)), "times": (np.zeros(n, np.int64), times), "tokens": (b.lengths, none), "known": (n_known, none),
                "base": (base, none.astype(float)), "score": (score, none.astype(float)),
            }
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 2, 3)), *(pa.array(np.concatenate(x)) for x in columns.values())], names=["doc_id", "held_out", "row", *columns])

    rows = plain.mapInArrow(run, "doc_id long, held_out boolean, row long, copies long, key long, times long, tokens long, known long, base double, score double")
    if not here:
        salts = {r["segment"]: -(-r["key"] // SALTED) for r in filters.where("kind = 1").where(F.col("key") > SALTED).select("segment", "key").collect()}
        far = _sent_to_segments(plain, filters, shared, power, salts, weight, denominator)
        none = F.lit(0).cast("long")
        rows = rows.unionByName(far.select("doc_id", "held_out", "row", none.alias("copies"), none.alias("key"), none.alias("times"), none.alias("tokens"), none.alias("known"), F.lit(0.0).alias("base"), "score"))
    rest = counts.where(eighth < edge).withColumnRenamed("count", "c")
    # a row that carries a document's own figures has no word; its key is its row's hash, so that no task gets them all
    rows = rows.withColumn("key", F.when(F.col("times") == 0, F.col("row")).otherwise(F.col("key")))
    joined = rows.join(rest, "key", "left")
    log = F.when(F.col("times") == 0, 0.0).when(F.col("c").isNull(), F.lit(log_none)).otherwise(F.log10((F.col("c") + 0.5) / F.lit(float(denominator or 1))))
    sums = joined.groupBy("doc_id", "held_out", "row").agg(
        F.sum("copies").cast("int").alias("copies"), F.sum("tokens").alias("n_tokens"), (F.sum("known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.col("times") * log)).alias("base_score"), F.sum("score").alias("score"),
    )
    one = sums.withColumns({c: (F.col(c) / F.col("copies")).cast(sums.schema[c].dataType) for c in ("n_tokens", "n_known", "base_score", "score")})
    one = one.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
