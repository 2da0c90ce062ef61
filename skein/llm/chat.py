"""Chat formatting of typed content parts, in DataFrame functions only.

A turn holds an ordered list of typed parts.  A visitor flattens them: text is escaped, every
image, audio or document part becomes a numbered placeholder, its reference is recorded, and
its expanded token count follows from its size.  Turns are wrapped in control strings; the same
strings inside texts are escaped with a backslash, reversibly, so turns can be read back.

Control strings hold no backslash.  Escaping doubles every backslash and then puts one behind
the first character of each control string.  Runs of backslashes of the original are thus even,
and single ones were inserted: removing one backslash of each pair, or a single one, restores
the text.  A control string may also come about where two text parts meet; a single backslash is
put between them there.  Placeholders begin with ``<`` and end with ``>``, behind or in front of
which no control string goes on, so none comes about at their edges.

Defined results: rows are ordered by turn, then role, then text (nulls first); repeated rows
are repeated turns; a null text is empty and a null role is the empty role; a null conversation
id is a conversation of its own; a part without a type is a text, null texts are empty; a part of
any type but text, image, audio and document becomes an ``other`` placeholder of no tokens, its
type is recorded as it is; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, BODY, END = "<|role|>", "<|body|>", "<|end|>"
#: Control strings of this template, and of common ones, that are escaped inside texts.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Parts that placeholders name.
ATTACHED = ("image", "audio", "document")
#: Neighbouring characters inside control strings.
_INSIDE = tuple(dict.fromkeys(c[i : i + 2] for c in CONTROL for i in range(len(c) - 1)))
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def _expanded(part: Column) -> Column:
    """Tokens that the placeholder of a part stands for."""
    ceil = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "image", F.greatest(F.lit(1), ceil(part["width"]) * ceil(part["height"])))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND)))
        .when(part["type"] == "document", F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE))
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """The flattened body of a turn, and its attachments in order of their placeholders."""
    numbered = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p, i: F.struct(i.alias("part"), p.alias("p")))
    is_text = lambda x: F.coalesce(x["p"]["type"], F.lit("text")) == "text"
    text = lambda x: F.coalesce(x["p"]["text"], F.lit(""))
    # An empty text has no edge.
    seen = F.filter(numbered, lambda x: ~is_text(x) | (text(x) != ""))
    name = lambda x: F.when(x["p"]["type"].isin(*ATTACHED), x["p"]["type"]).otherwise("other")

    def piece(x: Column, i: Column) -> Column:
        last = F.get(seen, i - 1)
        meets = F.coalesce(is_text(last) & F.concat(F.right(text(last), F.lit(1)), F.left(text(x), F.lit(1))).isin(*_INSIDE), F.lit(False)) & (i > 0)
        return F.when(is_text(x), F.concat(F.when(meets, "\\").otherwise(""), escape(text(x)))).otherwise(F.concat(F.lit("<|"), name(x), F.lit(":"), x["part"].cast("string"), F.lit("|>")))

    attachments = F.transform(
        F.filter(numbered, lambda x: ~is_text(x)), lambda x: F.struct(x["part"].alias("part"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), _expanded(x["p"]).alias("tokens"))
    )
    return F.array_join(F.transform(seen, piece), ""), attachments


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation.

    Columns: the conversation id, ``formatted``, ``loss_mask`` (runs of characters of
    ``formatted``, each with a flag whether they count for the loss), ``attachments`` (turn,
    part, type, reference, expanded tokens) and ``attachment_tokens``.

    Each row is flattened and escaped before rows meet; a conversation is one output value, so
    one task has to hold it, and nothing larger.
    """
    body, attachments = visit(F.col(parts_col))
    flat = turns.select(
        F.col(conv_col).alias("c"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), body.alias("body"), attachments.alias("attachments")).alias("t"),
    )
    grouped = flat.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(ROLE), escape(t["role"]), F.lit(BODY))
    runs = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(F.length(head(t)).cast("long").alias("chars"), F.lit(False).alias("loss")),
                F.struct(F.length(t["body"]).cast("long").alias("chars"), (t["role"] == trained_role).alias("loss")),
                F.struct(F.lit(len(END)).cast("long").alias("chars"), F.lit(False).alias("loss")),
            ),
        )
    )
    attached = F.flatten(
        F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    return grouped.select(
        F.col("c").alias(conv_col),
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        runs.alias("loss_mask"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns inside a formatted conversation, as array<struct<role, text>>."""
    chunks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape(F.substring_index(F.substring(c, len(ROLE) + 1, 2**31 - 1), BODY, 1)).alias("role"),
            unescape(F.substring_index(c, BODY, -1)).alias("text"),
        ),
    )


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped texts of the runs that count for the loss, cut out by the lengths of the runs.

    Three runs cover a turn with its end mark.  Cutting turn by turn keeps the work linear; runs
    whose lengths do not add up to their turn's raise.
    """
    turns = F.transform(F.filter(F.split(formatted, r"<\|end\|>", -1), lambda c: c != ""), lambda c, i: F.struct(F.slice(mask, i * 3 + 1, F.lit(3)).alias("runs"), c.alias("c")))
    chars = lambda t, k: t["runs"][k]["chars"].cast("int")
    fits = lambda t: chars(t, 0) + chars(t, 1) + chars(t, 2) == F.length(t["c"]) + len(END)
    kept = F.filter(turns, lambda t: F.when(fits(t), t["runs"][1]["loss"]).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")).cast("boolean")))
    return F.transform(kept, lambda t: unescape(F.substring(t["c"], chars(t, 0) + 1, chars(t, 1))))


def body_parts(body: Column) -> Column:
    """The parts of an escaped body, as array<struct<type, text>>: texts, and the placeholders' names as they are."""
    mark = r"<\|(?:image|audio|document|other):[0-9]+\|>"
    texts, marks = F.split(body, mark, -1), F.regexp_extract_all(body, F.lit(mark), F.lit(0))
    both = F.transform(texts, lambda t, i: F.array(F.struct(F.lit("text").alias("type"), unescape(t).alias("text")), F.struct(F.lit("mark").alias("type"), F.get(marks, i).alias("text"))))
    return F.filter(F.flatten(both), lambda x: x["text"] != "")
