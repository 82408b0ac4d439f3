"""Chat formatting by relational operations: sorted turn structs, merged roles and concatenation in Spark expressions.

A formatted conversation is a sequence of blocks, one for each run of adjacent turns of one role::

    <|start|>role<|body|>text<|turn|>text<|end|>

Control strings inside roles and texts are escaped: behind the first character of whatever would read as one, however
many backslashes stand there already, one backslash more is put. So no control string is left in an escaped text, and
taking one backslash out again gives the text back, whatever it was.

A conversation may hold any share of the rows. Turns are first grouped by ``CHUNK`` turn numbers and merged inside the
groups; then the groups are put in order, and blocks of one role that meet at a border are merged. Only the second step
has a whole conversation in one row, as its formatted text must be.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a block's start, of the start of its texts, between two texts of a block, and of its end.
START, BODY, TURN, END = "<|start|>", "<|body|>", "<|turn|>", "<|end|>"
#: Control strings of common chat templates, escaped beside the marks. Fixed values.
CONTROLS = (
    "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
#: Turn numbers of a group.
CHUNK = 256
BLOCKS = "array<struct<role:string,texts:array<string>>>"


def _control(slashes: str) -> str:
    """Pattern of a control string with ``slashes`` behind its last ``<`` or ``[``; no match holds another one's start."""
    tails = sorted({re.split(r"[<\[]", c)[-1] for c in (START, BODY, TURN, END, *CONTROLS)})
    return r"([<\[])" + slashes + "(" + "|".join(re.sub(r"([|\]])", r"\\\1", t) for t in tails) + ")"


#: What is escaped, and what an escaped control string looks like.
PLAIN, ESCAPED = _control(r"(\\*)"), _control(r"\\(\\*)")


def escape(text: Column) -> Column:
    """The text with every control string in it broken up by one more backslash."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def _merge(blocks: Column, turn: Column) -> Column:
    """Fold one turn into the blocks: to the last one if the role is the same, else as a block of its own."""
    last, text = F.try_element_at(blocks, F.lit(-1)), F.array(escape(turn["text"]))
    longer = F.struct(turn["role"].alias("role"), F.concat(last["texts"], text).alias("texts"))
    fresh = F.struct(turn["role"].alias("role"), text.alias("texts"))
    same = (F.size(blocks) > 0) & (last["role"] == turn["role"])
    return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(fresh)))


def _merged(turns: Column) -> Column:
    """The blocks of sorted turns, folded in slices of ``CHUNK`` turns so that the fold stays linear."""
    none = F.array().cast(BLOCKS)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1)), F.lit(CHUNK)), lambda i: i <= F.size(turns))
    return F.flatten(F.transform(starts, lambda i: F.aggregate(F.slice(turns, i, F.lit(CHUNK)), none, _merge)))


def format_conversations(conversations: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask of each conversation of the rows ``conv_id, turn, role, text``.

    ``loss_mask`` has a run for each turn: ``skip`` code points of ``formatted`` that are not trained on, then ``take``
    that are: the whole text of a turn of ``loss_role``, nothing of other turns. Turns are ordered by turn, then role,
    then text; rows that repeat are turns of their own, and turns without a number come last. A null role or text is the
    empty one; rows without a conv_id are one conversation. Roles may be any text. An empty table gives no rows, and
    further columns don't show.
    """
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    groups = (
        rows.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("_chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
        .select("conv_id", F.col("_chunk").isNull().alias("_last"), "_chunk", _merged(F.col("_turns")).alias("_blocks"))
    )
    chats = groups.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_last", "_chunk", "_blocks"))).alias("_groups"))
    each = lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))
    chats = chats.select("conv_id", F.flatten(F.transform(F.flatten(F.col("_groups._blocks")), each)).alias("_turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_turns.role", F.lit(1), F.size("_turns") - 1))

    def piece(turn: Column, role_before: Column) -> Column:
        opening = F.concat(F.lit(START), escape(turn["role"]), F.lit(BODY))
        mark = F.when(role_before.isNull(), opening).when(role_before == turn["role"], F.lit(TURN)).otherwise(F.concat(F.lit(END), opening))
        return F.struct(mark.alias("mark"), turn["text"].alias("text"), (turn["role"] == loss_role).alias("loss"))

    chats = chats.select("conv_id", F.zip_with("_turns", before, piece).alias("_pieces"))
    formatted = F.concat(F.array_join(F.transform("_pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END))

    def run(p: Column) -> Column:
        mark, text = F.char_length(p["mark"]).cast("long"), F.char_length(p["text"]).cast("long")
        return F.struct((mark + F.when(p["loss"], 0).otherwise(text)).alias("skip"), F.when(p["loss"], text).otherwise(0).alias("take"))

    return chats.select("conv_id", formatted.alias("formatted"), F.transform("_pieces", run).alias("loss_mask"))


def _parts(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"), -1)


def read_turns(formatted: DataFrame) -> DataFrame:
    """The rows of ``format_conversations`` with ``turns``, read back from the formatted text.

    A turn is a struct of role, text and ``taken``, the text that the mask's run covers.
    """
    blocks = _parts(F.col("formatted"), END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    halves = F.transform(blocks, lambda b: _parts(F.substr(b, F.lit(len(START) + 1)), BODY))
    blocks = F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), _parts(h[1], TURN).alias("texts")))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))

    def plain(turn: Column, run: Column) -> Column:
        under = F.right(turn["text"], run["take"].cast("int"))  # a run's taken part is the end of its turn
        return F.struct(turn["role"].alias("role"), unescape(turn["text"]).alias("text"), unescape(under).alias("taken"))

    return formatted.withColumn("turns", F.zip_with(turns, "loss_mask", plain))


def digests(conversations: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """What reads back from each formatted conversation: its turns and the text under its mask, counted and hashed."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = read_turns(format_conversations(conversations, loss_role=loss_role))
    read = read.select("conv_id", "formatted", "turns", F.array_join("turns.taken", "").alias("_loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
