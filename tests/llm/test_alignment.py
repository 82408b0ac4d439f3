import hashlib
import random
import time
from collections import Counter

import pyarrow as pa
import pytest

from flowatlas.llm import alignment
from flowatlas.llm.queries import aligned_tokenizers

DOCS = "doc_id long, text string, block long, n_a string, pairs string"
ODD = [
    None, "", " ", "x", "a", "a  b", "\tTabs\n\n and  spaces ", "It's ÉTÉ, isn't it? 3.5% a b", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "é🙂 ｆｕｌｌ 漢字かな", "a\x00b\x7f",
    "word " * 20_000, " " * 9000 + "x", "aaaa" * 3000, "İ ſ K ß ŉ", "\r\n\r\n", "é combining", " 　​",
]


def brute(rows):
    """Every column by plain loops, with the libraries' own general encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_path, _, piece_path, _ = aligned_tokenizers()
    a_tok, sp = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    a_tok.encode_special_tokens = True
    level = alignment._byte_level()
    docs = []
    for i, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(level[c] for c in a_tok.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p := sp.id_to_piece(x)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a = b = a_bytes = b_bytes = []
        spans = []
        for ids, tokens in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for x, t in zip(ids, tokens):
                out.append((at, at + len(t), x))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for s, e, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, p, q = [], 0, 0
        for c in cuts:
            parts = []
            for side, at in ((0, p), (1, q)):
                end = at
                while end < len(spans[side]) and spans[side][end][1] <= c:
                    end += 1
                parts.append((",".join(str(x) for _, _, x in spans[side][at:end]), end))
            groups.append(parts[0][0] + "|" + parts[1][0])
            p, q = parts[0][1], parts[1][1]
        docs.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    held = Counter(pair for d in docs for pair in set(d[4]))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(*d[:4], len(d[4]), sum(held[p] == most[p[0]] for p in d[4]), sum(held[p] for p in d[4]), d[5]) for d in docs]


def check(spark, rows, parts=3):
    table = spark.createDataFrame([(i, t, 9, "clash", "clash") for i, t in rows], DOCS).repartition(parts)
    found = alignment.aligned(table, aligned_tokenizers()).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=order) == sorted(brute(rows), key=order)


def test_odd_texts(spark):
    check(spark, list(enumerate(ODD)))


def test_repeated_rows_and_ids(spark):
    check(spark, [(None, "one text here"), (None, "another text"), (5, "one text here"), (5, "one text here"), (5, None), (6, "")])


def test_many_blocks(spark, monkeypatch):
    r = random.Random(4)
    words = ["tokenizer", "été", "naïve", "1234", "x=y;", "THE", "the", "\n", "漢", "don't", "▁"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(120)]
    monkeypatch.setattr(alignment, "BLOCK", 700)
    check(spark, rows)
    check(spark, rows, parts=1)


def test_empty_table(spark):
    check(spark, [])


def test_documents_of_the_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_both_libraries_encode_alike():
    encoded = alignment.encoders(aligned_tokenizers())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f" a{c}b1{c}2 {c}{c} '{c} x  {c}\n" for c in chars]
    whole = encoded.whole.encode_batch_fast(texts, add_special_tokens=False)
    assert all(w.ids == encoded.a(t) for w, t in zip(whole, texts))


def test_alignment_takes_time_in_proportion():
    encoded = alignment.encoders(aligned_tokenizers())

    def seconds(n):
        start = time.perf_counter()
        alignment._block(0, [1], ["Some words of a text, repeated. " * n], encoded)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 30 * max(seconds(4000), 0.01)


@pytest.mark.parametrize("pairs", [3, 70_000])
def test_links_of_either_width(pairs):
    width = "<u2" if pairs <= 2**16 else "<u4"
    import numpy as np

    links = [np.array(x, width).tobytes() for x in ([0, pairs - 1], [1])]
    rows = pa.table({"block": [1, 1], "doc_id": [4, 5], **{c: [1, 1] for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": ["", ""], "links": links, "times": pa.array([[2, 1], [3]], pa.list_(pa.int32()))})
    counts = pa.table({"block": [1] * pairs, "place": pa.array(range(pairs), pa.int32()), "held": list(range(10, 10 + pairs)), "best": [k % 2 == 1 for k in range(pairs)]})
    found = alignment._finish(rows, counts).to_pydict()
    assert found["count_sum"] == [20 + 9 + pairs, 33] and found["n_best"] == [(pairs - 1) % 2, 3]
