"""Alignment of two tokenizers' tokens by byte offsets, in Arrow tables inside tasks and Spark between them.

Documents are encoded in blocks of some megabytes of text. In a block, token ids are flattened with their parents'
indices, byte lengths become offsets by cumulative sums that start anew in each document, and the tokens' ends are
joined on (document, end) with a full outer hash join. Each row of that join is the end of a stretch of bytes that lies in one
token of either side, so the rows are just the links: A's id on a row without one is that of the next row that has one,
and so is B's. Rows with both sides end a group.

How many documents hold a pair linked is counted by block first and merged by Spark. The counts go back to the blocks
through a join on the pair and a grouping by block, one row for a pair of a block, so that no frequent pair, no long
document and no table of all pairs has to be in one place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import shared_folder

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 2_000_000
#: A document's number times this, plus an end's offset, is the key of the end.
SPAN = 2**40
#: A pair's number is A's id times this plus B's id.
PAIR = 2**32
#: A run of white space this long is left to the general tokenizer; the quick one's pattern recurses on it.
LONG_SPACE = re.compile(r"\s{4000}")

_ENCODED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, times array<int>, pairs array<long>, held array<int>"
)
_workers: dict[tuple[str, ...], "Encoders"] = {}


def _byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others are moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Encoders:
    """Both tokenizers of a worker, and the bytes of every id."""

    def __init__(self, byte_path: str, ranks_path: str, piece_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.byte_path = byte_path
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        level = _byte_level()
        with open(byte_path, encoding="utf-8") as f:
            entries = json.load(f)
        numbers = entries["model"]["vocab"] | {t["content"]: t["id"] for t in entries["added_tokens"]}
        names = sorted(numbers, key=numbers.get)
        self.a_bytes = pa.array([bytes(level[c] for c in n) if all(c in level for c in n) else n.encode() for n in names], pa.binary())
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)], pa.binary())

    @cached_property
    def whole(self):
        """The general tokenizer, for the few texts that need it."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.byte_path)
        found.encode_special_tokens = True
        return found

    def a(self, text: str) -> list[int]:
        """Ids of the byte-level vocabulary; the two libraries give the same ones (tested over all characters)."""
        if LONG_SPACE.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


def encoders(paths: tuple[str, ...]) -> Encoders:
    if paths not in _workers:
        _workers[paths] = Encoders(*paths)
    return _workers[paths]


def _nested(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, lists)])
    flat = np.fromiter((x for ids in lists for x in ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def _same_bytes(ids: pa.ListArray, table: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Whether each list's tokens spell the wanted bytes."""
    tokens = table.take(ids.values)
    ends = np.r_[0, np.cumsum(pc.binary_length(tokens).to_numpy())][ids.offsets.to_numpy()]
    spelt = memoryview(tokens.buffers()[2] or b"").cast("B")  # buffers count as signed bytes
    return np.array([spelt[s:e] == w for s, e, w in zip(ends[:-1], ends[1:], wanted)], bool)


def _ends(ids: pa.ListArray, table: pa.Array, name: str) -> pa.Table:
    """The id and the key (document, end offset) of each token."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    sums = pc.cumulative_sum(pc.cast(pc.binary_length(table.take(flat)), pa.int64()))
    before = pa.array(np.r_[0, sums.to_numpy()][ids.offsets.to_numpy()[:-1]])  # the sum at each document's start
    offset = pc.subtract(sums, before.take(parent))
    return pa.table({"key": pc.add(pc.multiply(pc.cast(parent, pa.int64()), SPAN), offset), name: flat})


def _joined(strings: pa.Array, group: np.ndarray, n: int, mark: str) -> pa.Array:
    """The strings of each of ``n`` groups, joined; ``group`` ascends."""
    offsets = np.r_[0, np.cumsum(np.bincount(group, minlength=n))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings), mark)


def align(a_ids: pa.ListArray, b_ids: pa.ListArray, encoded: Encoders) -> tuple[pa.Table, pa.Array]:
    """The links (doc, a, b, and whether they end a group) in order of the text, and each document's groups as a string.

    Both lists of a document must spell the same bytes.
    """
    left, right = _ends(a_ids, encoded.a_bytes, "a"), _ends(b_ids, encoded.b_bytes, "b")
    rows = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
    rows = rows.take(pc.sort_indices(rows["key"])).combine_chunks()
    key, a, b = (rows[name].combine_chunks() if rows[name].num_chunks != 1 else rows[name].chunk(0) for name in ("key", "a", "b"))
    doc = key.to_numpy() // SPAN
    has_a, has_b = a.is_valid().to_numpy(False), b.is_valid().to_numpy(False)
    both = has_a & has_b
    group = np.r_[0, np.cumsum(both)[:-1]] if len(both) else np.zeros(0, np.int64)
    n = int(both.sum())
    text = lambda ids, has: _joined(pc.cast(ids.drop_null(), pa.string()), group[has], n, ",")
    groups = pc.binary_join_element_wise(text(a, has_a), text(b, has_b), "|")
    links = pa.table({"doc": pa.array(doc), "a": pc.fill_null_backward(a), "b": pc.fill_null_backward(b), "last": pa.array(both)})
    return links, _joined(groups, doc[both], len(a_ids), ";")


def _block(number: int, ids: list[int | None], texts: list[str | None], encoded: Encoders) -> pa.RecordBatch:
    """The rows of one block; its pairs and how many of its documents hold each stand on the first row."""
    a_lists, b_lists = [encoded.a(" " + t) if t else [] for t in texts], encoded.b([t or "" for t in texts])
    b_lists = [b if t else [] for b, t in zip(b_lists, texts)]
    a_ids, b_ids = _nested(a_lists), _nested(b_lists)
    wanted = [(" " + t).encode() if t else b"" for t in texts]
    good = _same_bytes(a_ids, encoded.a_bytes, wanted) & _same_bytes(b_ids, encoded.b_bytes, wanted)
    if not good.all():
        a_ids, b_ids = _nested([x if g else [] for x, g in zip(a_lists, good)]), _nested([x if g else [] for x, g in zip(b_lists, good)])
    links, groups = align(a_ids, b_ids, encoded)
    pair = pc.dictionary_encode(pc.add(pc.multiply(pc.cast(links["a"], pa.int64()), PAIR), pc.cast(links["b"], pa.int64()))).combine_chunks()
    pair = pair.chunk(0) if isinstance(pair, pa.ChunkedArray) else pair
    n_docs, doc = len(texts), links["doc"].to_numpy()
    held = pa.table({"doc": links["doc"], "pair": pair.indices}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    order = np.lexsort((held["pair"].to_numpy(), held["doc"].to_numpy()))
    at, pairs, times = (held[name].to_numpy()[order] for name in ("doc", "pair", "count_all"))
    documents = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    cuts = np.r_[0, np.cumsum(np.bincount(at, minlength=n_docs))].astype(np.int32)
    width = np.dtype("<u2") if len(pair.dictionary) <= 2**16 else np.dtype("<u4")
    first = pa.array([0, len(pair.dictionary)] + [len(pair.dictionary)] * (n_docs - 1), pa.int32())
    packed, cut = pairs.astype(width).tobytes(), cuts * width.itemsize
    columns = [
        pa.array([number] * n_docs, pa.int64()), pa.array(ids, pa.int64()),
        pc.cast(a_ids.value_lengths(), pa.int64()), pc.cast(b_ids.value_lengths(), pa.int64()),
        pa.array(np.bincount(doc[links["last"].to_numpy()], minlength=n_docs), pa.int64()), pa.array(np.bincount(doc, minlength=n_docs), pa.int64()),
        pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(groups, a_ids.value_lengths().to_pylist())], pa.string()),
        pa.array([packed[s:e] for s, e in zip(cut[:-1], cut[1:])], pa.binary()),
        pa.ListArray.from_arrays(pa.array(cuts), pa.array(times, pa.int32())),
        pa.ListArray.from_arrays(first, pair.dictionary), pa.ListArray.from_arrays(first, pc.cast(documents["count_all"], pa.int32()).combine_chunks()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _ENCODED.split(", ")])


def _encode(paths: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, number = encoders(paths), TaskContext.get().partitionId() * 2**31
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1].encode()) if texts[-1] else 0
                if size >= BLOCK:
                    yield _block(number, ids, texts, encoded)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield _block(number, ids, texts, encoded)

    return run


def _finish(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their links."""
    n = len(counts)
    held, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = counts["place"].to_numpy()
    held[place], best[place] = counts["held"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
    width = np.dtype("<u2") if n <= 2**16 else np.dtype("<u4")
    links = np.frombuffer(b"".join(x.as_py() for x in rows["links"]), width)
    times = rows["times"].combine_chunks()
    doc, times = pc.list_parent_indices(times).to_numpy(), times.flatten().to_numpy()
    size = len(rows)
    totals = []
    for value in (best, held):
        sums = np.zeros(size, np.int64)
        np.add.at(sums, doc, value[links] * times)
        totals.append(pa.array(sums))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[rows[c] for c in names], *totals, rows["groups_sha256"]], [*names, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, paths: tuple[str, str, str, str]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``.

    ``paths`` are the byte-level vocabulary (A), its ranks, the piece model (B) and the pattern that splits text before
    A's merges. A null or empty text, and one that either tokenizer doesn't spell out byte for byte (B reads U+2581 as a
    space, for one), has no tokens: zeros and an empty hash. Rows that repeat or lack a doc_id are documents of their
    own. Very long texts are aligned whole, in a block of their own. Of pairs with equal counts all are their A id's best.
    An empty table gives no rows, and further columns of ``docs`` don't show.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(paths), _ENCODED).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(_ENCODED).parquet(folder)
    pairs = spark.read.schema(_ENCODED).parquet(folder).where(F.size("pairs") > 0).select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    pairs = pairs.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("held"))
    of_a = F.shiftright("pair", 32)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("held").alias("most"))  # a row for an id of A's vocabulary
    counts = counts.join(F.broadcast(most), of_a == F.col("a")).select("pair", "held", (F.col("held") == F.col("most")).alias("best"))
    found = pairs.select("block", "place", "pair").join(counts, "pair").select("block", "place", "held", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.drop("pairs", "held").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_finish, out)
