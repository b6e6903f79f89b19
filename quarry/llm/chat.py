"""Chat formatting by prefix-target expansion (native expressions only).

Every assistant turn becomes one example: all preceding turns are its context
and only that reply is under the loss mask.  A conversation that ends with
another role (or has no assistant turn) gets a last example without a target,
so the output always holds the whole conversation.

Template, per turn: ``<s>[INST] role [/INST] text </s>``.  Control strings
inside a role or text are escaped reversibly: each gets one more backslash in
front (``</s>`` -> ``\\</s>``, ``\\</s>`` -> ``\\\\</s>``); reading back takes
one away.  The template's own marks always follow a space or start a turn, so
an escaped text can hold none of them.

A conversation is one row of the result, hence must fit in memory; nothing
else is gathered.  Defined results: null text or role is the empty string;
rows of a conversation are ordered by (turn, role, text), null turns first,
repeated rows are kept; rows with null ``conv_id`` form one conversation; an
empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"
CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>)"
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\*)" + CONTROL, "$1$2")


def format_examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, example, last, formatted, loss_start, loss_end)``: the loss
    mask is the code-point range [loss_start, loss_end) of ``formatted``."""
    turns = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                 F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TRAINED_ROLE).alias("trained"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))).alias("heads"),
        F.transform("turns", lambda t: F.concat(escape(t["text"]), F.lit(CLOSE))).alias("bodies"))
    n = F.size("trained")
    ends = F.filter(F.sequence(F.lit(1), n),
                    lambda i: F.element_at("trained", i) | (i == n))
    ex = convs.select("conv_id", "trained", "heads", "bodies", n.alias("n"), F.posexplode(ends).alias("example", "p"))
    before = F.array_join(F.transform(F.slice(F.arrays_zip("heads", "bodies"), F.lit(1), F.col("p") - 1),
                                      lambda z: F.concat(z["heads"], z["bodies"])), "")
    ex = ex.select("conv_id", "example", (F.col("p") == F.col("n")).alias("last"),
                   F.element_at("trained", F.col("p")).alias("target"),
                   F.concat(before, F.element_at("heads", F.col("p"))).alias("context"),
                   F.element_at("bodies", F.col("p")).alias("body"))
    whole = F.length("context") + F.length("body")
    return ex.select(
        "conv_id", "example", "last", F.concat("context", "body").alias("formatted"),
        F.when(F.col("target"), F.length("context")).otherwise(whole).alias("loss_start"),
        F.when(F.col("target"), whole - len(CLOSE)).otherwise(whole).alias("loss_end"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string, unescaped."""
    blocks = F.split(formatted, CLOSE, -1)

    def one(b):
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), MID, 1)
        text = F.substr(b, F.length(role) + len(OPEN) + len(MID) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), one)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings and masks alone:
    ``(conv_id, turns, loss, formatted_chars, n_examples)``."""
    masked = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    return examples.select("conv_id", "example", masked.alias("masked"),
                           F.length("formatted").cast("long").alias("chars"),
                           F.when(F.col("last"), F.col("formatted")).alias("whole")) \
        .groupBy("conv_id").agg(
            F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"),
            F.sort_array(F.collect_list(F.struct("example", "masked"))).alias("m")) \
        .select("conv_id", parse_turns(F.col("whole")).alias("turns"),
                F.array_join(F.transform("m", lambda x: x["masked"]), "").alias("loss"),
                "formatted_chars", "n_examples")


def digests(back: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars")
