"""SimHash near-duplicates by a binary trie self-join.

Two fingerprints within two bits agree on at least one of three bit blocks (22, 21 and 21 bits). So the trie is rooted
three times, each time with another block on top, and its top levels are shared out over the shards by that block,
where no bit may differ. Below, node pairs of the trie are walked down together, adding up differing bits, and a pair
is pruned once it is beyond the budget. Equal fingerprints meet as one.

A shard returns a spanning forest of the links it finds, never all pairs. A group below one top that holds over
``LARGE`` different fingerprints is linked by another exact way: fingerprints within two bits share a point at most
one bit from both, and at most 65 fingerprints share a point, so no task gets more of them together.
Components come from alternating star contractions on checkpointed links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import stable

SEED, SHINGLE, BUDGET, LARGE = 42, 3, 2, 1 << 15
#: Left rotations that put a block on top, and the blocks' widths.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Node pairs walked at once; fingerprints per shard and block, on average; value pairs below which two nodes are compared.
FRONTIER, SHARD, FEW = 1 << 19, 1 << 15, 64


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all shingles of ``width`` words, repeats included; fewer words are one shingle, none have none."""
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype="<u8")


def simhash(text: str | None) -> int:
    """The 64-bit majority fingerprint of all 3-word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes((text or "").encode().lower().split(), SHINGLE))  # bytes: only A-Z are lowered, only ASCII white space splits


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def turned(fps: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return fps if not by else (fps << np.uint64(by)) | (fps >> np.uint64(64 - by))


def trie_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, top: int, budget: int = BUDGET, labels: np.ndarray | None = None, also: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits; each range [start, end) of ``values`` is sorted and shares ``top`` bits.

    A trie node is a range of the sorted values; the walk keeps pairs of nodes at one depth with their differing bits.
    With ``labels``, only pairs of different labels are wanted, and node pairs that hold one label alone are pruned too.
    ``also(a, b)`` says which of the pairs found are kept, as they are found.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(al, ah, bl, bh):
        """Every index of one range with every index of the other, range pair by range pair."""
        for k in range(0, len(al), 1 << 15):
            low, other, wide = al[k : k + (1 << 15)], bl[k : k + (1 << 15)], (bh - bl)[k : k + (1 << 15)]
            times = (ah - al)[k : k + (1 << 15)] * wide
            of = np.repeat(np.arange(len(low)), times)
            at = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            a, b = low[of] + at // wide[of], other[of] + at % wide[of]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            near &= np.where((low == other)[of], a < b, True) if labels is None else np.where((low == other)[of], a < b, True) & (labels[a] != labels[b])
            a, b = a[near], b[near]
            if also is not None:
                near = also(a, b)
                a, b = a[near], b[near]
            found.append((a, b))

    changes = None if labels is None else np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))

    def wanted(al, ah, bl, bh):
        if labels is None:
            return np.ones(len(al), bool)
        return (changes[ah - 1] != changes[al]) | (changes[bh - 1] != changes[bl]) | (labels[al] != labels[bl])

    keep = ends - starts > 1
    keep[keep] &= wanted(starts[keep], ends[keep], starts[keep], ends[keep])
    stack = [(top, (starts[keep], ends[keep], starts[keep], ends[keep], np.zeros(keep.sum(), np.int64)))]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > FRONTIER:
            half = len(pairs[0]) // 2
            stack += [(depth, tuple(x[:half] for x in pairs)), (depth, tuple(x[half:] for x in pairs))]
            continue
        al, ah, bl, bh, off = pairs
        few = (ah - al) * (bh - bl) <= (FEW if depth < 64 else len(values) ** 2)
        if few.any():  # few forks are left: compare what is there at once
            compare(al[few], ah[few], bl[few], bh[few])
            al, ah, bl, bh, off = (x[~few] for x in (al, ah, bl, bh, off))
        if not len(al):
            continue
        if depth not in ones_at:
            ones_at[depth] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        ones = ones_at[depth]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        other = al != bl
        children = [(al, am, bl, bm, off), (am, ah, bm, bh, off), (al, am, bm, bh, off + 1), tuple(x[other] for x in (am, ah, bl, bm, off + 1))]
        al, ah, bl, bh, off = (np.concatenate(x) for x in zip(*children))
        keep = (ah > al) & (bh > bl) & (off <= budget) & ~((al == bl) & (ah - al == 1))
        keep[keep] &= wanted(al[keep], ah[keep], bl[keep], bh[keep])
        stack.append((depth + 1, tuple(x[keep] for x in (al, ah, bl, bh, off))))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every index the smallest index of its component."""
    label = np.arange(size)
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label[label] != label).any():
            label = label[label]
    return label


def fingerprint_links(fps: DataFrame, *, large: int = LARGE) -> DataFrame:
    """(a, b): links that connect just the fingerprints connected by steps of at most two differing bits."""
    shards = max(8, -(-fps.count() // SHARD))  # so a shard's size doesn't grow with the input

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [b.column(0).to_numpy() for b in batches]
        values = np.unique(np.concatenate(values).view(np.uint64)) if values else np.empty(0, np.uint64)
        rows = []
        for k, (by, width) in enumerate(BLOCKS):
            turn = turned(values, by)
            mixed = ((turn >> np.uint64(64 - width)) + np.uint64(k << 22)) * np.uint64(0x9E3779B97F4A7C15)
            shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows += [(int(s), k, turn[order[cuts[s] : cuts[s + 1]]].tobytes()) for s in range(shards) if cuts[s] < cuts[s + 1]]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int32()), "packed": pa.array([r[2] for r in rows], pa.binary())})

    def walk(shard: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for k, (by, width) in enumerate(BLOCKS):
            packed = [x.as_py() for x, b in zip(shard.column("packed"), shard.column("block").to_pylist()) if b == k]
            if not packed:
                continue
            values = np.unique(np.frombuffer(b"".join(packed), np.uint64))
            tops = values >> np.uint64(64 - width)
            starts = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1])))
            ends = np.append(starts[1:], len(values))
            back = turned(values, 64 - by)
            over = ends - starts > large
            a, b = trie_links(values, starts[~over], ends[~over], width)
            root = forest(len(values), a, b)
            linked = np.flatnonzero(root != np.arange(len(values)))
            out.append((back[root[linked]], back[linked]))
            for s, e in zip(starts[over], ends[over]):
                out.append((back[s:e], back[s:e]))  # linked to itself: still to be done, below
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
        return pa.table({"a": a, "b": b})

    dealt = fps.select("fp").mapInArrow(deal, "shard long, block int, packed binary")
    links = stable(dealt.groupBy("shard").applyInArrow(walk, "a long, b long"))
    large_fps = links.where("a = b").select(F.col("a").alias("fp")).distinct()
    points = large_fps.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("point"))
    shared = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65
    more = shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return links.where("a <> b").unionByName(more)


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node it is connected to; alternating star contractions."""
    edges = stable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        # large star: larger neighbours of a node go to its smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them; large's v is below its u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, *, large: int = LARGE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null or empty text has fingerprint zero and is linked like any other; texts of fewer than three words are one
    shingle. Copies share a fingerprint and so a component. Rows that repeat a doc_id are separate rows with their own
    fingerprints; a null doc_id names no component. An empty table gives no rows; further columns are ignored.
    """
    fps = stable(fingerprints(docs))
    roots = components(fingerprint_links(fps, large=large))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("_low"))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "_low", F.coalesce("root", "fp").alias("_root"))
    lowest = nodes.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = nodes.join(lowest, "_root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
