"""Chat formatting into budgeted windows, with DataFrame functions only.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside
roles and texts are escaped, and can be read back: a backslash becomes ``\\b``,
``\\c`` is put after the first character of a control string, and a line break in a
role becomes ``\\n``.

Windows follow from prefix sums of turn tokens, without walking the turns. The
token axis of a conversation is cut into cells of ``fresh`` tokens. A turn that
begins in a cell belongs to the cell's window if it ends within ``room`` tokens
of the cell's begin, else it has a window of its own. So a window's new turns fit into
``room`` unless a single turn does not. In front of them a window
repeats the leading system turn and as many whole earlier turns as fit into
``history`` tokens. A system turn of more than ``history`` tokens is repeated by
its first ``4 * history`` characters and a mark, ``CUT``; the window where it is new has
all of it. Assistant turns are the training targets; each is under the
loss mask in the one window where it is new, and repeated ones are masked.

Prefix sums are taken per (conversation, bucket of turns), so a conversation
with a third of all turns is many tasks; texts move once per window they are
in, and a window holds a bounded number of tokens.

Defined results: null roles and texts count as empty; turns go by number (null
first), then role and text; equal rows are turns of their own; rows with a null
conversation id are one conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nestfold.llm.base import key, query, table, unkey
from nestfold.operators.order import running
from nestfold.sources.storage import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns in this template or in others in wide use.
CONTROLS = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
FRESH, ROOM, HISTORY = 512, 1024, 512
CUT = "…"  # behind a system turn that is repeated in part
_MARKS = 4  # tokens of a turn besides role and text; keeps turns of no text countable
_BUCKET = 64  # turns of one window function


def _literal(text: str) -> str:
    return re.sub(r"([^\w\s/])", r"\\\1", text)


def escape(text: Column) -> Column:
    rest = "|".join(f"(?<={_literal(c[0])}){_literal(c[1:])}" for c in CONTROLS)
    first = "".join(sorted({_literal(c[0]) for c in CONTROLS}))
    doubled = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(doubled, f"([{first}])(?={rest})", "$1\\\\c")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Words, numbers and signs: a measure of tokens that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END + "\n"))


def _numbered(df: DataFrame) -> DataFrame:
    """Escaped turns with their place, and the tokens before and with them."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    base = df.select(
        key("conv_id").alias("conv"), key("turn").alias("turn"), role.alias("r"), text.alias("t"),
        F.replace(escape(role), F.lit("\n"), F.lit("\\n")).alias("role"), escape(text).alias("text"),
        (tokens(role) + tokens(text) + _MARKS).cast("long").alias("size"))
    bucket = F.floor(F.col("turn") / _BUCKET)
    placed = running(base, ["conv"], bucket, ["turn", "r", "t"], sums={"begin": F.col("size"), "place": F.lit(1).cast("long")})
    return placed.drop("r", "t").withColumn("end", F.col("begin") + F.col("size"))


def windows(df: DataFrame, fresh: int = FRESH, room: int = ROOM, history: int = HISTORY) -> DataFrame:
    """A row per window of conversations given as rows (conv_id, turn, role, text).

    ``window`` orders the windows of a conversation; ``formatted`` is the text,
    ``n_repeated`` how many of its turns are repeated, ``loss`` the (begin,
    length) in characters of the spans under the loss mask, ``n_tokens`` its size.
    """
    turns = materialize(_numbered(df), "turns")
    cell = F.floor(F.col("begin") / fresh)
    alone = (F.col("end") - cell * fresh > room).cast("long")
    own = turns.select("conv", "place", "begin", "end", "role", cell.alias("cell"), alone.alias("alone"))
    heads = own.groupBy("conv", "cell", "alone").agg(F.min("begin").alias("from"))
    # Only cells that begin within ``history`` tokens of a turn's end can repeat it.
    reach = own.select(
        "conv", "place", "begin", "end", F.explode(F.sequence(F.floor(F.col("end") / fresh), F.floor(
            (F.col("begin") + history) / fresh))).alias("cell"))
    earlier = (
        reach.filter(F.col("end") - F.col("begin") <= history).join(heads, ["conv", "cell"])
        .filter((F.col("end") <= F.col("from")) & (F.col("from") - F.col("begin") <= history))
        .select("conv", "place", "cell", "alone"))
    system = own.filter((F.col("place") == 0) & (F.col("role") == "system")).select("conv", "place", F.col("end").alias("system_end"))
    kept = (
        heads.join(system, "conv").filter(F.col("from") >= F.col("system_end")).select("conv", "place", "cell", "alone"))
    members = (
        earlier.unionByName(kept).distinct().withColumn("new", F.lit(False))
        .unionByName(own.select("conv", "place", "cell", "alone").withColumn("new", F.lit(True))))
    whole = members.join(turns.select("conv", "place", "role", "text", "size"), ["conv", "place"])
    long_ = ~F.col("new") & (F.col("size") > history)  # only a system turn is repeated beyond the history
    part = F.concat(F.substring("text", 1, 4 * history), F.lit(CUT))
    filled = whole.withColumn("text", F.when(long_, part).otherwise(F.col("text"))).withColumn(
        "size", F.when(long_, tokens(F.col("role")) + tokens(F.col("text")) + _MARKS).otherwise(F.col("size")))
    packed = filled.groupBy("conv", "cell", "alone").agg(
        F.array_sort(F.collect_list(F.struct("place", "new", "role", "text"))).alias("turns"),
        F.sum("size").alias("n_tokens"))
    parts = F.transform("turns", lambda x: _turn(x["role"], x["text"]))
    built = packed.withColumn("parts", parts).withColumn("lengths", F.transform("parts", lambda x: F.char_length(x)))
    starts = F.transform("turns", lambda x, i: F.aggregate(F.slice("lengths", 1, i), F.lit(0), lambda a, b: a + b))
    spans = F.transform(F.arrays_zip("turns", starts.alias("start")), lambda z: F.struct(
        (z["start"] + F.lit(len(BEGIN) + 1) + F.char_length(z["turns"]["role"])).alias("begin"),
        F.char_length(z["turns"]["text"]).alias("length"),
        (z["turns"]["new"] & (z["turns"]["role"] == "assistant")).alias("target")))
    return built.select(
        unkey("conv").alias("conv_id"), F.struct("cell", "alone").alias("window"), F.array_join("parts", "").alias("formatted"),
        F.size(F.filter("turns", lambda x: ~x["new"])).alias("n_repeated"),
        F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["begin"], s["length"])).alias("loss"),
        "n_tokens")


def read_back(formatted: Column) -> Column:
    """The (role, text) of all turns of a formatted text."""
    pieces = F.filter(F.split(formatted, _literal(END + "\n").replace("\n", "\\n")), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.substring(x, len(BEGIN) + 1, 1 << 30))
    return F.transform(bare, lambda x: F.struct(
        unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescape(x.substr(F.instr(x, "\n") + 1, F.char_length(x))).alias("text")))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, read from the windows: turns, texts under the loss mask, and sizes."""
    loss = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["begin"] + 1, s["length"])))
    read = made.withColumn("turns", F.slice(
        read_back(F.col("formatted")), F.col("n_repeated") + 1, F.char_length("formatted"))).withColumn("targets", F.array_join(loss, ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    whole = read.withColumn("said", said).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "said", "targets"))).alias("w"),
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(joined("targets")).cast("long").alias("loss_chars"),
        F.sha2(joined("targets").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")


@query("op1_chat_formatting")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that tries to break the template, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(windows(turns.unionByName(extra)))
