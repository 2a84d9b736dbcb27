"""Conversations as one training text each, with typed content parts and a loss mask.

A turn's content is a list of parts: text, image, audio or document. One visitor walks the parts in
order. Texts are escaped and written out; every other part becomes a placeholder, and its reference
and the number of tokens it will expand to are recorded in the order of the placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What tokenizers may read as control strings, without their first character.
ANGLE, SQUARE = r"<(\|[a-z_]+\|>|/?s>)", r"\[(/?INST\])"
#: Tokens that media expand to: a patch of the image's side, a second of audio, a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    """Text in which no control string is left. Every ~ is followed by the digit that tells what it
    stands for, so `unescape` gives the text back."""
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, ANGLE, "~1$1"), SQUARE, "~2$1")


def unescape(text: Column) -> Column:
    for code, char in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """A single text part, for tables whose turns are plain texts."""
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *rest))


def placeholder(part: Column) -> Column:
    """What the visitor writes for a part; parts of no known kind are written as their text."""
    shown = escape(F.coalesce(part["text"], F.lit("")))
    for kind in KINDS:
        shown = F.when(part["kind"] == kind, F.lit(f"<|{kind}|>")).otherwise(shown)
    return shown


def expanded_tokens(part: Column) -> Column:
    """Tokens that a medium will take in place of its placeholder; unknown measures count as one unit."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    sound = F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * PER_SECOND)
    pages = F.coalesce(part["pages"], F.lit(1)) * PER_PAGE
    tokens = F.when(part["kind"] == "image", patches).when(part["kind"] == "audio", sound).otherwise(pages)
    return tokens.cast("long")


def format_parts(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """A row per conversation of `turns` (conv_id, turn, role, parts of type PART).

    formatted: the text; loss_spans: (start, length) in code points of what is trained, one for each
    turn of role `trained`; attachments: (kind, ref, tokens) in the order of placeholders.

    Turns stand in the order of turn, then role, then content, so rows that repeat a turn are kept in
    a fixed order, and null turns come first. A null role is an empty one, a null list of parts and a
    null text are empty texts. A conversation without rows does not appear. Other columns are left out.
    A conversation is one text, so its turns meet in one row; it must fit there.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    media = F.transform(
        F.filter(parts, lambda p: p["kind"].isin(*KINDS)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("~3")), F.lit("\n"))
    turn = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.array_join(F.transform(parts, placeholder), "").alias("shown"),
            head.alias("head"),
            media.alias("media"),
        ).alias("t"),
    )
    rows = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rows = rows.withColumn("pieces", F.transform("ts", lambda t: F.concat(t["head"], t["shown"], F.lit(END + "\n"))))
    # code points before each turn, by a running sum over the lengths
    step = F.transform(
        "ts",
        lambda t: F.struct(
            F.length(t["head"]).cast("long").alias("head"),
            F.length(t["shown"]).cast("long").alias("shown"),
            (t["role"] == trained).alias("on"),
        ),
    )
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.aggregate(
        step,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["shown"] + len(END) + 1).alias("at"),
            F.when(
                s["on"],
                F.array_append(acc["spans"], F.struct((acc["at"] + s["head"]).alias("start"), s["shown"].alias("length"))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.select(
        "conv_id",
        F.array_join("pieces", "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["media"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted texts and their masks: conv_id, turns (role, text), loss_text, attachments.

    Placeholders stay in the texts. This is the reverse of `format_parts` for texts, control strings
    inside texts included.
    """
    pieces = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substr(
                    p,
                    F.length(F.substring_index(p, "\n", 1)) + 2,
                    F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END),
                )
            ).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted", "attachments")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what `read_back` finds, a row per conversation."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
