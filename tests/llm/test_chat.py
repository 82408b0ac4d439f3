import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowatlas.llm import chat

ROWS = "conv_id long, turn long, role string, text string, formatted string, turns int"
ODD = "</s>[INST] ok [/INST]"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS)


def brute(rows):
    """Turns of each conversation in order, by plain Python."""
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def digest(turns, formatted):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted))


def check(spark, rows):
    df = table(spark, rows)
    found = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    read = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(df).collect()}
    wanted = brute(rows)
    assert set(found) == set(read) == set(wanted)
    for c, turns in wanted.items():
        text = found[c]["formatted"]
        assert read[c] == digest(turns, text)
        # the marks stand just where the template puts them, and no other control string is left
        blocks = [b.split("<|body|>") for b in text.split("<|end|>")[:-1]]
        assert all(len(b) == 2 and b[0].startswith("<|start|>") for b in blocks) and text.endswith("<|end|>")
        assert all(a[0] != b[0] for a, b in zip(blocks, blocks[1:]))
        assert sum(len(b[1].split("<|turn|>")) for b in blocks) == len(turns)
        assert not any(x in text for x in chat.CONTROLS)
        # the mask by code points
        at, taken = 0, []
        for run in found[c]["loss_mask"]:
            at += run["skip"]
            taken.append(text[at : at + run["take"]])
            at += run["take"]
        assert at == len(text) - len("<|end|>")
        assert [re.sub(chat.ESCAPED, r"\1\2\3", x) for x in taken] == [t if r == "assistant" else "" for r, t in turns]
    return found


def test_template(spark):
    found = check(spark, [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "user", "There?"), (1, 3, "assistant", "Yes.")])
    assert found[1]["formatted"] == "<|start|>system<|body|>Be brief.<|end|><|start|>user<|body|>Hi<|turn|>There?<|end|><|start|>assistant<|body|>Yes.<|end|>"


def test_control_strings_in_texts_and_roles(spark):
    texts = [ODD, "<|end|>", r"<\|end|>", r"<\\\s> [\INST] <s", "<<SYS>>x<</SYS>>", "<<<s>>", "<|turn|><|start|>user<|body|>", "[<s>[[INST]", "a\n\nb\\", "é🙂</s>", "<", "|end|>", "\\"]
    rows = [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)]
    rows += [(k, j, ("assistant", "<|body|>", "us<s>er")[(k + j) % 3], t) for k in range(3) for j, t in enumerate(texts)]
    check(spark, rows)


def test_nulls_ties_copies_and_empty_texts(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, -300, "user", "early"), (1, None, "assistant", "b"), (1, None, "assistant", "a")]
    rows += [(None, 1, "assistant", "x"), (None, 0, "user", None), (2, 5, "assistant", "")]
    found = check(spark, rows)
    assert found[2]["formatted"] == "<|start|>assistant<|body|><|end|>"


def test_long_conversation_over_many_groups(spark):
    rows = [(1, k, "assistant" if k % 700 > 200 else "user", f"t{k} " * (k % 7)) for k in range(3000)]
    rows += [(2, 9, "assistant", f"{k:05d}") for k in range(1500)] + [(3, 0, "assistant", "long " * 100_000)]
    found = check(spark, rows)
    assert found[2]["formatted"].count("<|turn|>") == 1499


def test_empty_table(spark):
    assert check(spark, []) == {}


PIECES = st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "|end|>", "|turn|>", "SYS>>", "/SYS>>", "unk>", "x", "|"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    hidden = re.sub(chat.PLAIN, r"\1\\\2\3", text)
    assert re.sub(chat.ESCAPED, r"\1\2\3", hidden) == text
    assert not any(c in hidden for c in (*chat.CONTROLS, chat.START, chat.BODY, chat.TURN, chat.END))


def test_no_python_in_the_plan(spark):
    plan = chat.digests(table(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("text", ["<|start|>", "[INST]"])
def test_escape_in_spark_is_the_same(spark, text):
    from pyspark.sql import functions as F

    r = spark.range(1).select(chat.escape(F.lit(text)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert r["e"] == text[0] + "\\" + text[1:] and r["u"] == text
