"""Chat formatting in Spark expressions.

A message is ``<s>role[INST]text[/INST]</s>``; adjacent turns of one role
share a message, their texts parted by ``[SEP]``. A control string inside a
role or text gets a backslash after its first character (one more where it has
some already), so it never reads as markup and comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import free_name

#: What follows the first character of a control string.
_TAIL = r"(/?INST\]|/?SYS\]|SEP\]|/?s>|/?SYS>>|\|im_start\|>|\|im_end\|>)"
OPEN, HEAD, SEP, CLOSE = "<s>", "[INST]", "[SEP]", "[/INST]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _TAIL, "$1$2$3")


def _running(lengths: Column) -> Column:
    """Running sums of an array by doubling: after step k each place holds
    the sum of its last 2**k values. n log n for a conversation of n turns."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int"), F.lit(0)))
    return F.aggregate(
        steps,
        lengths,
        lambda acc, k: F.transform(
            acc,
            lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0).cast("long")),
        ),
    )


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``n_turns``,
    ``n_messages`` and ``loss_spans``, an array of ``(start, end)`` code
    points in ``formatted``, one for each turn of ``loss_role``.

    Turns go by ``turn_col`` (null last), ties by role and text; repeated rows
    are turns of their own. Null texts and roles count as empty. Rows with a
    null conversation form one conversation. Extra columns are not read; an
    empty table gives an empty result. A conversation becomes one string, so
    its rows meet in one task; nothing else is gathered by it.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").isNull().alias("last"),
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    marked = sorted_.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.when(
                    F.coalesce(F.get("ts", i - 1)["role"] == t["role"], F.lit(False)), F.lit(SEP)
                )
                .otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD)))
                .alias("before"),
                escape(t["text"]).alias("text"),
                F.when(F.coalesce(F.get("ts", i + 1)["role"] == t["role"], F.lit(False)), F.lit(""))
                .otherwise(F.lit(CLOSE))
                .alias("after"),
                (t["role"] == loss_role).alias("loss"),
            ),
        ).alias("ms"),
    )
    joined = marked.select(
        "conv_id",
        "ms",
        F.array_join(
            F.transform("ms", lambda m: F.concat(m["before"], m["text"], m["after"])), ""
        ).alias("formatted"),
        F.transform(
            "ms",
            lambda m: (F.length(m["before"]) + F.length(m["text"]) + F.length(m["after"])).cast("long"),
        ).alias("lengths"),
    )
    ended = joined.select("*", _running(F.col("lengths")).alias("ends"))
    spans = F.transform(
        F.filter(
            F.transform(
                "ms",
                lambda m, i: F.struct(
                    (F.get("ends", i) - F.length(m["after"]) - F.length(m["text"])).alias("start"),
                    (F.get("ends", i) - F.length(m["after"])).alias("end"),
                    m["loss"].alias("loss"),
                ),
            ),
            lambda s: s["loss"],
        ),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )
    return ended.select(
        "conv_id",
        "formatted",
        F.size("ms").cast("long").alias("n_turns"),
        F.size(F.filter("ms", lambda m: m["after"] == CLOSE)).cast("long").alias("n_messages"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``,
    as they went in (null role or text: empty)."""
    messages = F.filter(F.split(formatted, r"\[/INST\]</s>"), lambda m: m != "")
    halves = F.transform(messages, lambda m: F.split(F.substring(m, len(OPEN) + 1, 2_147_483_647), r"\[INST\]"))
    return F.flatten(
        F.transform(
            halves,
            lambda h: F.transform(
                F.split(F.get(h, F.lit(1)), r"\[SEP\]"),
                lambda x: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


#: Code points in a block of a formatted text.
BLOCK = 4096


def with_loss_text(chats: DataFrame, out_col: str = "loss") -> DataFrame:
    """``chats`` plus all text under its loss spans, unescaped, nothing
    between. The text is cut into blocks first, so a span costs its own blocks
    and not the way to them: linear in the conversation."""
    text, spans = F.col("formatted"), F.col("loss_spans")
    blocks = free_name(chats, "blocks")
    cut = chats.withColumn(blocks, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    b = F.col(blocks)

    def under(s: Column) -> Column:
        first = F.floor(s["start"] / BLOCK)
        last = F.floor(s["end"] / BLOCK)
        near = F.array_join(F.slice(b, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescape(
            F.substring(near, (s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        )

    # the blocks are named twice, so the optimiser keeps them a column of
    # their own and does not cut the text again for each span
    found = F.when(F.size(b) > 0, F.array_join(F.transform(spans, under), "")).otherwise(F.lit(""))
    return cut.withColumn(out_col, found).drop(blocks)
