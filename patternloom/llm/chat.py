"""Chat formatting: conversations become one training string with a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import require

BEGIN, FINISH, OPEN, CLOSE, TURN = "<s>", "</s>", "[", "]", "<t>"
#: Escapes: a backslash always starts a pair, and no mark's first character outlives them.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))


def escape(text: Column) -> Column:
    """`text` without any character that starts a mark of the template; `unescape` undoes it."""
    for plain, pair in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescape(text: Column) -> Column:
    for plain, pair in reversed(ESCAPES):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, n_blocks, formatted, loss_mask array<struct<start, end>>).

    `formatted` is `<s>`, then for every run of adjacent turns of one role
    `[role]` and each text followed by `<t>`, then `</s>`; the marks' first
    characters are escaped inside roles and texts, so it can be read back.  The
    mask holds the code points (end exclusive) of the texts of `loss_role`.

    Turns go by turn, then role, then text (nulls first), so ties and repeated
    rows have one order and all stay.  Null roles and texts count as empty,
    null ids form a conversation of their own, extra columns are left out, and
    an empty table gives an empty table.  A conversation is one string, so its
    turns have to fit one task's memory.
    """
    require(turns, id_col, turn_col, role_col, text_col)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")).alias("t")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.element_at("ts", F.greatest(i, F.lit(1)))["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))).otherwise(F.lit("")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == F.lit(loss_role)).alias("learn"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("ts", piece).alias("ps"))
    formatted = F.concat(
        F.lit(BEGIN), F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(TURN))), ""), F.lit(FINISH)
    )
    # where every piece ends, as running sums
    sizes = F.transform("ps", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.lit(len(TURN)))
    state = F.struct(F.lit(len(BEGIN)).alias("sum"), F.array().cast("array<int>").alias("ends"))
    ends = F.aggregate(
        sizes,
        state,
        lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["ends"], F.array(acc["sum"] + n)).alias("ends")),
        lambda acc: acc["ends"],
    )
    spans = F.zip_with(
        "ps",
        "ends",
        lambda p, e: F.struct(p["learn"].alias("learn"), (e - F.lit(len(TURN)) - F.length(p["body"])).alias("start"), (e - F.lit(len(TURN))).alias("end")),
    )
    mask = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return pieces.select("conv_id", "ps", formatted.alias("formatted"), ends.alias("ends")).select(
        "conv_id",
        F.size("ps").cast("long").alias("n_turns"),
        F.size(F.filter("ps", lambda p: p["head"] != "")).cast("long").alias("n_blocks"),
        "formatted",
        mask.alias("loss_mask"),
    )


def read_back(formatted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What `format_conversations` was given: (conv_id, turns array<struct<role, text>>, loss_text), and the columns `keep`.

    It reads `formatted` and `loss_mask` alone.
    """
    require(formatted, "conv_id", "formatted", "loss_mask")
    f = F.col("formatted")
    body = F.substring(f, F.lit(len(BEGIN) + 1), F.length(f) - F.lit(len(BEGIN) + len(FINISH)))
    blocks = F.filter(F.split(body, r"\[", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, CLOSE, 1)
        texts = F.split(F.substring(block, F.length(role) + F.lit(len(CLOSE) + 1), F.length(block)), TURN, -1)
        own = F.slice(texts, F.lit(1), F.size(texts) - F.lit(1))
        return F.transform(own, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    under = F.transform("loss_mask", lambda m: unescape(F.substring(f, m["start"] + F.lit(1), m["end"] - m["start"])))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(under, "").alias("loss_text"), *keep)
