"""Near copies by SimHash: texts whose five-word shingle sets have a Jaccard similarity of at least 0.8.

Two sets that similar share a shingle among the first fifth (and one more) of each in any common order, so the blocks of
this SimHash join are those shared shingles instead of equal fingerprint bits. Shingles are ordered by level of
frequency, from counts by hash bucket (the order decides only the cost), and the first ones are dealt to shards with
their text's fingerprint. Inside a block the fingerprints' binary trie is walked against itself within ``BUDGET``
differing bits, and what the walk finds is compared by the whole sets, so that clean texts stay apart.

A pair with similarity 0.8 differs in at most 0.19 * 64 = 12 bits on average, and in more than ``BUDGET`` bits less than
once in a million, so the budget prunes strangers and practically no link.

Equal sets are one node. Up to ``GROUP`` nodes of a block are compared with each other. Of more, all are first compared
with ``CENTRES`` of them; then the trie is walked once more for pairs of nodes that these links don't connect, so no pair
is left out that could connect two components, and no links inside a component are listed. A pair is wanted in the block
of the first shingle that both share, where the places of that shingle bound what they can share after it; most pairs
are so found once. All pairs pass a parity sketch of the whole sets before any text is sent: the sketches of two sets
differ in at most as many bits as the sets differ in shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import KEY, keyed, stable
from flowatlas.llm.near_dedup import components, majority, shingle_hashes, trie_links

#: Words of a shingle; differing bits that are walked; nodes of a block compared with each other, and centres of more.
WIDTH, BUDGET, GROUP, CENTRES = 5, 28, 8, 2
#: Dealt shingles per shard, on average; nodes of a block that one task takes for its second walk.
SHARD, LARGE = 1 << 20, 1 << 12
#: Bits of a set's parity sketch.
SKETCH = 1024
#: Hash buckets of the shingle counts, in so many slices.
BUCKETS, SLICES = 1 << 20, 256
#: Bits of the broadcast map of texts to be compared; it only saves shuffling others' texts.
MAP = 1 << 23

_ROW = [("token", "<u8"), ("fp", "<u8"), ("node", "<i8"), ("place", "<u2"), ("size", "u1")]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; a text of fewer words is one shingle, an empty text has none."""
    return np.unique(shingle_hashes((text or "").encode().lower().split(), WIDTH))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 4/5, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def node_of(shingles: np.ndarray) -> int:
    """The digest that stands for a set, as a signed number."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), 0)], np.uint64).view(np.int64)[0])


def step_of(size: np.ndarray) -> np.ndarray:
    """Sizes on a scale where those within a factor of 5/4 are at most one step apart."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(1.25) + 1e-9).astype(np.uint8)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Bit by bit whether an odd number of the set's shingles falls on the bit."""
    at = (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(bool)).tobytes()


def may_be_alike(sketches: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of n shingles can be alike, by their sketches (rows of 64-bit words): alike sets differ in at most a ninth
    of both sizes together. That many different shingles leave a known mean of differing bits; six standard deviations
    above it are allowed.
    """
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        differ = np.bitwise_count(sketches[x] ^ sketches[y]).sum(1, dtype=np.int64)
        most = (n[x] + n[y]) // 9
        mean = SKETCH / 2 * -np.expm1(-2 * most / SKETCH)
        out[k : k + (1 << 16)] = (differ <= most) & (differ <= mean + 6 * np.sqrt(mean) + 1)
    return out


def _levels(texts: DataFrame) -> np.ndarray:
    """Level of frequency, 1 + floor(log2(count)), of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                at, many = np.unique(shingle_set(text.as_py()) % np.uint64(BUCKETS), return_counts=True)
                counts[at.astype(np.int64)] += many.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, SLICES)], pa.binary())], names=["slice", "packed"])

    def level(part: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(p.as_py(), np.uint32) for p in part.column("packed")], axis=0, dtype=np.int64)
        return pa.table({"slice": part.column("slice")[:1], "packed": pa.array([np.frexp(counts)[1].astype(np.uint8).tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(count, "slice int, packed binary").groupBy("slice").applyInArrow(level, "slice int, packed binary").collect()
    levels = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(r["packed"], np.uint8)
    return levels.reshape(-1)


def _nodes(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """One row per text: doc_id, its key, node (digest of the set), fingerprint, n (size), sketch and packed first shingles in their order."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, firsts, sketches = [], [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py())
                # by level, then by mixed hash; the hash alone decides who shares a bucket
                rank = (shared.value[(s % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                first = len(s) - (4 * len(s) + 4) // 5 + 1
                nodes.append(node_of(s))
                fps.append(majority(s))
                sizes.append(len(s))
                sketches.append(sketch_of(s))
                front = np.argpartition(rank, first - 1)[:first] if len(s) else np.empty(0, np.int64)
                firsts.append(s[front[np.argsort(rank[front])]].tobytes())
            arrays = [pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(firsts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *arrays], names=["doc_id", *KEY, "node", "fp", "n", "sketch", "firsts"])

    return texts.select("doc_id", *KEY, "text").mapInArrow(run, "doc_id long, k1 long, k2 long, node long, fp long, n int, sketch binary, firsts binary")


def _met(nodes: DataFrame, group: int) -> DataFrame:
    """(token, a, b): pairs to compare (token null), and members a of larger blocks with their token and its place in a (token, a, -1 - place)."""
    shards = max(8, -(-(nodes.agg(F.sum(F.octet_length("firsts"))).first()[0] or 0) // (8 * SHARD)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(3)]
            times = [len(f) for f in firsts]
            rows = np.empty(sum(times), _ROW)
            rows["token"] = np.concatenate(firsts) if firsts else []
            for name, column in (("node", batch.column(0).to_numpy()), ("fp", batch.column(1).to_numpy().view(np.uint64)), ("size", step_of(batch.column(2).to_numpy()))):
                rows[name] = np.repeat(column, times)
            # a place beyond the scale only lets more through
            rows["place"] = np.minimum(np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times), 65535) if len(rows) else []
            shard = (rows["token"] >> np.uint64(24)).astype(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array([rows[order[cuts[s] : cuts[s + 1]]].tobytes() for s in full], pa.binary())], names=["shard", "packed"])

    def meet(shard: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(x.as_py() for x in shard.column("packed")), _ROW)
        # what stands alone in its block meets nobody
        _, at, many = np.unique(rows["token"], return_inverse=True, return_counts=True)
        rows = rows[many[at] > 1]
        rows = rows[np.lexsort((rows["node"], rows["fp"], rows["token"]))]
        rows = rows[np.concatenate(([True], rows[1:] != rows[:-1]))] if len(rows) else rows
        starts = np.flatnonzero(np.concatenate(([True], rows["token"][1:] != rows["token"][:-1]))) if len(rows) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(rows)) if len(rows) else starts
        few = ends - starts <= group
        pairs, members = [trie_links(rows["fp"], starts[few], ends[few], 0, BUDGET)], [np.empty(0, np.int64)]
        seen: set[bytes] = set()
        for s, e in zip(starts[~few].tolist(), ends[~few].tolist()):
            every = np.arange(s, e)
            members.append(every)
            who = xxhash.xxh128_digest(rows["node"][s:e].tobytes())
            if who in seen:  # the same nodes have met their centres already
                continue
            seen.add(who)
            # the same centres in each block of these nodes, as far as may be
            for c in every[np.argsort(rows["node"][s:e].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:CENTRES]]:
                near = every[(np.bitwise_count(rows["fp"][s:e] ^ rows["fp"][c]) <= BUDGET) & (every != c)]
                pairs.append((np.full(len(near), c), near))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        fit = np.abs(rows["size"][a].astype(int) - rows["size"][b]) <= 1
        a, b = rows["node"][a[fit]], rows["node"][b[fit]]
        a, b = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        more = rows[np.concatenate(members)]
        token = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more["token"].view(np.int64))])
        other = np.concatenate((b, -1 - more["place"].astype(np.int64)))
        return pa.table({"token": token, "a": pa.array(np.concatenate((a, more["node"]))), "b": pa.array(other)})

    dealt = nodes.select("node", "fp", "n", "firsts").mapInArrow(deal, "shard long, packed binary")
    return dealt.groupBy("shard").applyInArrow(meet, "token long, a long, b long")


def _across(members: DataFrame, nodes: DataFrame, roots: DataFrame, large: int) -> DataFrame:
    """(a, b): pairs of a block's members (token, a, place) that may be alike but are in different components.

    Blocks of more than ``large`` members are cut into parts by node, and each two parts are walked in a task of their
    own, so no task holds more than two parts.
    """
    named = members.join(roots, members.a == roots.node, "left").select("token", "a", "place", F.coalesce("root", "a").alias("root"))
    blocks = named.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    parted = named.join(blocks.select("token", F.ceil(F.col("many") / large).cast("int").alias("parts")), "token").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    sets = nodes.select(F.col("node").alias("a"), "fp", "n", "sketch").dropDuplicates(["a"])
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = parted.join(sets, "a").withColumn("other", other).select("token", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "a", "place", "root", "fp", "n", "sketch")

    def walk(block: pa.Table) -> pa.Table:
        node, root, n, place = (block.column(c).to_numpy() for c in ("a", "root", "n", "place"))
        fp = block.column("fp").to_numpy().view(np.uint64)
        sketches = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint64).reshape(len(fp), -1)
        order = np.lexsort((root, fp))
        node, root, n, fp, sketches, left = node[order], root[order], n[order], fp[order], sketches[order], (n - place)[order]

        def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """If nothing before this shingle is shared, at most what is left of the shorter one is."""
            there = 9 * np.minimum(left[a], left[b]) >= 4 * (n[a] + n[b])
            there[there] = may_be_alike(sketches, n, a[there], b[there])
            return there

        a, b = trie_links(fp, np.array([0]), np.array([len(fp)]), 0, BUDGET, root, wanted)
        return pa.table({"a": pa.array(np.minimum(node[a], node[b])), "b": pa.array(np.maximum(node[a], node[b]))})

    return dealt.groupBy("token", "p", "q").applyInArrow(walk, "a long, b long").distinct()


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that may be alike by their sketches."""
    sets = nodes.select("node", "n", "sketch").dropDuplicates(["node"])
    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(i).to_numpy() for i in (2, 4)])
            sketches = np.frombuffer(b"".join(batch.column(3).to_pylist() + batch.column(5).to_pylist()), np.uint64).reshape(2 * m, SKETCH // 64)
            yield batch.filter(pa.array(may_be_alike(sketches, n, np.arange(m), np.arange(m, 2 * m)))).select(["a", "b"])

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are alike; texts travel, as they are smaller than their sets."""
    spark = texts.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.pmod("node", F.lit(MAP)).alias("bit"))
    words = ends.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    field = np.zeros(MAP // 64, np.int64)
    for r in words.collect():  # at most MAP / 64 rows
        field[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(np.unpackbits(field.view(np.uint8), bitorder="little").view(bool))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.array([node_of(shingle_set(t.as_py())) for t in batch.column(0)], np.int64)
            hit = shared.value[node % MAP]
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), batch.column(0).filter(pa.array(hit))], names=["node", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            same = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, held = a, shingle_set(x.as_py())
                same.append(alike(held, shingle_set(y.as_py())))
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    one = texts.select("text").mapInArrow(pick, "node long, text string").dropDuplicates(["node"])
    both = pairs.join(one.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(one.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return stable(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))


def near_copies(docs: DataFrame, *, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reachable by steps of similarity 0.8 or more),
    kept (true for one document of each component) and the row's key (``common.keyed``).

    Kept is the document of the smallest doc_id; null ids come last, rows of one id are ordered by their keys, and rows
    equal in all columns share their answer. Null and empty texts are alike. A component without ids has a null one. An
    empty table gives no rows; further columns only count in the key.
    """
    texts = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *KEY, F.col("text").cast("string").alias("text"))
    nodes = stable(_nodes(texts, _levels(texts)))
    met = stable(_met(nodes, group))
    links = _confirmed(stable(_sketched(met.where("token is null").select("a", "b").distinct(), nodes)), texts)
    roots = components(links)
    more = stable(_across(met.where("token is not null").select("token", "a", (-1 - F.col("b")).alias("place")), nodes, roots, large))
    if not more.isEmpty():
        links = links.unionByName(_confirmed(more, texts))
        roots = components(links)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    lows = nodes.groupBy("node").agg(F.min(place).alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = lows.groupBy("root").agg(F.min("low").alias("best"))
    named = lows.join(lowest, "root").select("node", "best")
    return nodes.select("doc_id", "node", *KEY).join(named, "node").select("doc_id", F.col("best.doc_id").alias("component_id"), ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("kept"), *KEY)
