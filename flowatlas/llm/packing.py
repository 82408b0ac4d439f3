"""Best-fit packing of token sequences with several capacities at once.

Pieces are dealt to packing shards by hash; a shard holds a few thousand pieces whatever the size of the input, so the
packing of one shard fits a task, and shards lose at most part of a sequence each. In a shard, pieces go from long to
short to the open sequence of the best score among those that have room in every capacity.

The production limits on documents (4096) and attention cost (4096 squared) are what 4096 tokens can reach at most: as few
sequences as possible are asked for, and lower limits would cost sequences. There only tokens bind, and the other two
residuals decide among sequences with equal room. Smaller limits bind as they are given.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import stable

MAX_TOKENS = 4096
#: Pieces per packing shard, on average.
SHARD_PIECES = 4096
#: Tokens that follow each document.
END_ID = 1
#: Parts of words remembered by a worker; beyond it, it starts anew.
REMEMBERED = 1_400_000
#: Bytes of text that are encoded at once, or one text.
BLOCK = 8 << 20
#: Parts of words that are encoded in one call.
CALL = 100

#: A word of Latin-1 letters with ASCII punctuation behind it (no apostrophe): its parts never merge.
_PARTS = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
_CORE = re.compile("[a-zß-öø-ÿ]+")
_workers: dict[str, "WordTokens"] = {}


class WordTokens:
    """Ids of white-space separated words by a tokenizer that never joins across white space, remembered per worker.

    Letters and the punctuation behind them are separate pre-tokens and case doesn't count, so a word like ``Abc,`` is
    looked up by its parts; all other words are encoded whole. Words are split, told apart and put together as columns.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary for words that are one pre-token and already in their normal form
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # no word comes twice
        self.parts: dict[str, bytes] = {}

    def learn(self, parts: list[str]) -> None:
        """Add ``parts``: lower-case letters, or anything else that holds no white space."""
        cores = list(filter(_CORE.fullmatch, parts))
        for k in range(0, len(cores), CALL):
            part = cores[k : k + CALL]
            found = self.plain.encode(" ".join(part), add_special_tokens=False)
            packed = np.array(found.ids, "<u4").tobytes()
            cuts = (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(part)))).tolist()
            self.parts.update((c, packed[a:b]) for c, a, b in zip(part, [0, *cuts], cuts))
        whole = list(set(parts).difference(cores))
        for p, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            self.parts[p] = np.array(found.ids, "<u4").tobytes()

    def look_up(self, parts: pa.Array) -> pa.Array:
        """The ids of every part."""
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        found = parts.dictionary_encode()
        different = found.dictionary.to_pylist()
        ids = list(map(self.parts.get, different))
        if missing := [p for p, x in zip(different, ids) if x is None]:
            self.learn(missing)
            ids = [self.parts[p] if x is None else x for p, x in zip(different, ids)]
        return pa.array(ids, pa.large_binary()).take(found.indices)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit numbers."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        parts = pc.extract_regex(words.dictionary, _PARTS)
        first = pc.if_else(parts.is_valid(), pc.utf8_lower(pc.struct_field(parts, "core")), words.dictionary)
        second = pc.struct_field(parts, "tail").fill_null("")
        ids = pc.binary_join_element_wise(self.look_up(first), self.look_up(second), pa.scalar(b"", pa.large_binary())).take(words.indices)
        _, ends, packed = ids.buffers()
        cuts = np.frombuffer(ends, np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        return [packed[a:b].to_pybytes() for a, b in zip(cuts, cuts[1:])]


def tokenized(docs: DataFrame, path: str, *, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves): every document's ids and the end id, in pieces."""
    end = np.array([END_ID], "<u4").tobytes()
    step = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.setdefault(path, WordTokens(path)) if path not in _workers else _workers[path]
        for whole in batches:
            ends, k = np.cumsum(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while k < whole.num_rows:
                upto = int(np.searchsorted(ends, BLOCK + (ends[k - 1] if k else 0), "right"))
                batch = whole.slice(k, max(upto - k, 1))
                k += batch.num_rows
                rows: list[tuple] = []
                for doc_id, packed in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                    packed += end
                    rows += [(doc_id, i // step, i // 4, len(part := packed[i : i + step]) // 4, zlib.crc32(part), part if with_ids else None) for i in range(0, len(packed), step)]
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def best_fit(lengths: np.ndarray, *, max_tokens: int = MAX_TOKENS, max_docs: int = 4096, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """For every piece (longest first) its sequence and its offset there.

    A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Among the open
    sequences with room for the piece in all three, that with the smallest weighted norm of what would remain is taken.
    """
    max_cost = float(max_tokens) ** 2 if max_cost is None else float(max_cost)
    n = len(lengths)
    place, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    tokens, docs, cost, name = (np.empty(n, np.float64) for _ in range(4))
    wt, wd, wc = weights[0] / max_tokens**2, weights[1] / max_docs**2, weights[2] / max_cost**2
    opened = made = 0
    least = float(lengths[-1]) if n else 0
    for i, size in enumerate(lengths.tolist()):
        work = float(size) * size
        best = -1
        if opened:
            t, d, c = tokens[:opened] - size, docs[:opened] - 1, cost[:opened] - work
            norm = wt * t * t + wd * d * d + wc * c * c
            norm[(t < 0) | (d < 0) | (c < 0)] = np.inf
            best = int(norm.argmin())
            if norm[best] == np.inf:
                best = -1
        if best < 0:
            best, opened, made = opened, opened + 1, made + 1
            tokens[best], docs[best], cost[best], name[best] = max_tokens, max_docs, max_cost, made - 1
        place[i], offset[i] = name[best], max_tokens - tokens[best]
        tokens[best] -= size
        docs[best] -= 1
        cost[best] -= work
        if tokens[best] < least or docs[best] < 1 or cost[best] < least * least:  # closed: the last open one moves here
            opened -= 1
            for x in (tokens, docs, cost, name):
                x[best] = x[opened]
    return place, offset


def pack(pieces: DataFrame, *, shard_pieces: int = SHARD_PIECES, max_tokens: int = MAX_TOKENS, max_docs: int = 4096, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Full pieces are sequences by themselves. The others are packed shard by shard; the numbers of sequences are unique
    but have gaps. Shards are even whatever repeats: rows are dealt by their places too, so ``pieces`` must be a written
    table or a checkpoint.
    """
    spark = pieces.sparkSession
    shards = max(1, -(-pieces.where(F.col("length") < max_tokens).count() // shard_pieces))

    def run(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        place, offset = best_fit(shard.column("length").to_numpy(), max_tokens=max_tokens, max_docs=max_docs, max_cost=max_cost, weights=weights)
        return pa.table({**{c: shard.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": place * (2 * shards) + 2 * number, "offset": offset})

    short = pieces.where(F.col("length") < max_tokens).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    packed = short.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= max_tokens).select("doc_id", "piece", "start", "length", "ids_crc32", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is just the end id. Documents longer than a sequence are cut into full pieces and a rest.
    Rows that repeat a doc_id are packed like different documents. An empty table gives no rows; further columns are
    ignored.
    """
    return pack(stable(tokenized(docs, path, max_tokens=options.get("max_tokens", MAX_TOKENS))), **options)
