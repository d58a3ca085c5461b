"""Chat formatting with typed content parts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, ROLE_END, TURN_END = "### ", "\n", "</turn>\n"
#: Control strings and their escapes. Each backslash in an escaped text starts one of these codes.
ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("###", "\\2"), ("<|", "\\3"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\4"))
PART = "struct<type:string,text:string,ref:string,units:int>"
#: Tokens that one unit of an attachment (a tile, a second, a page) expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(c: Column, codes=ESCAPES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes=ESCAPES) -> Column:
    """The inverse of escape: the backslash's own code goes last, so what it gives back is not read again."""
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _body(parts: Column) -> Column:
    """A turn's parts as text. Texts side by side are one before they are escaped, so that no control string forms where two meet."""
    kind = lambda p: p["type"].isin(*UNIT_TOKENS)
    text = lambda p: F.coalesce(p["text"], F.lit(""))
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
    return F.aggregate(
        parts,
        state(F.lit(""), F.lit("")),
        lambda a, p: F.when(kind(p), state(F.concat(a["done"], escape(a["open"]), F.lit("<|"), p["type"], F.lit("|>")), F.lit(""))).otherwise(state(a["done"], F.concat(a["open"], text(p)))),
        lambda a: F.concat(a["done"], escape(a["open"])),
    )


def _part_tokens(p: Column) -> Column:
    units, c = F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)), None
    for kind, n in UNIT_TOKENS.items():
        c = (F if c is None else c).when(p["type"] == kind, units * n)
    return c.otherwise(0)


def text_parts(text: Column) -> Column:
    """A plain text as the one part of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens, n_turns.

    ``parts_col`` holds an array of ``PART``; without it a turn is one text part. The parts of a turn are visited in order:
    texts, joined where they stand side by side, are escaped, an image, audio or document part becomes a placeholder, its reference goes to ``attachments`` (in
    the order of the placeholders) and its units times UNIT_TOKENS to ``attachment_tokens``. Other types count as text.
    ``loss_spans`` are (start, length) of the contents of ``loss_roles`` in code points of ``formatted``.

    Very long texts and conversations are formatted whole. Null texts, roles and parts are empty. Turns that tie are ordered by role, then content. Null turns come first; rows
    with a null conv_id are one conversation; repeated rows are turns each; an empty table gives no rows. A conversation
    is one row of the result, so it has to fit in one task. Other columns are ignored.
    """
    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) if parts_col else text_parts(F.col(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    attached = F.filter("parts", lambda p: p["type"].isin(*UNIT_TOKENS))
    flat = rows.select(
        "conv_id",
        F.struct(
            "turn", "role",
            _body(F.col("parts")).alias("body"),
            F.transform(attached, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"))).alias("refs"),
            F.aggregate("parts", F.lit(0), lambda a, p: a + _part_tokens(p)).alias("tokens"),
        ).alias("t"),
    )
    held = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"], ROLE_ESCAPES), F.lit(ROLE_END))
    size = lambda c: F.char_length(c).cast("long")
    spans = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + size(head(t)) + size(t["body"]) + len(TURN_END)).alias("at"),
            F.when(t["role"].isin(*loss_roles), F.concat(a["spans"], F.array(F.struct((a["at"] + size(head(t))).alias("start"), size(t["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return held.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(TURN_END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["refs"])).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("attachment_tokens"),
        F.size("ts").cast("long").alias("n_turns"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role,text>>; placeholders stay as they are."""
    return _turns(formatted, lambda body: unescape(body).alias("text"))


def _turns(formatted: Column, of_body) -> Column:
    pieces = F.filter(F.split(formatted, TURN_END, -1), lambda p: p != "")
    at = lambda p: F.instr(p, ROLE_END)
    role = lambda p: unescape(F.substr(p, F.lit(len(TURN) + 1), at(p) - F.lit(len(TURN) + 1)), ROLE_ESCAPES)
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), of_body(F.substr(p, at(p) + 1))))


def parse_parts(formatted: Column) -> Column:
    """The turns as array<struct<role, parts: array<struct<type, text>>>>: a placeholder is a part of its kind, told from equal text by the escapes.

    Texts of parts that stood side by side are one part; attachments have no text, their references are in ``attachments``,
    in the same order.
    """
    marks = [rf"<\|{kind}\|>" for kind in UNIT_TOKENS]
    cuts = "|".join([*(f"(?={m})" for m in marks), *(f"(?<={m})" for m in marks)])
    kind = lambda x: F.regexp_extract(x, rf"^<\|({'|'.join(UNIT_TOKENS)})\|>$", 1)
    part = lambda x: F.struct(F.when(kind(x) != "", kind(x)).otherwise("text").alias("type"), F.when(kind(x) == "", unescape(x)).alias("text"))
    return _turns(formatted, lambda body: F.transform(F.filter(F.split(body, cuts), lambda x: x != ""), part).alias("parts"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, spans in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
