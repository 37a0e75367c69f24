"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import table

#: A content part; fields that its type doesn't use are null.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
TURN_OPEN, TURN_CLOSE = "<turn>", "</turn>\n"
#: Tokens that an attachment takes: an image per tile of 512 x 512 plus one, audio per second, a document per page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 25, 1024


def escape(text: Column) -> Column:
    """Each control string starts with '<', so no text can hold one after this; `unescape` is its inverse."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """A role ends at the first line break, so its own are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _visit(part: Column) -> Column:
    """What one part puts in the text: its escaped text or its placeholder."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit("|>")))


def _tokens(part: Column) -> Column:
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / TILE)
    return (
        F.when(part["type"] == "image", tiles * TILE_TOKENS + 1)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("long")
    )


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) per conversation of messages(conv_id, turn, role, parts).

    A turn is `<turn>`, its role, a line break, its flattened parts and `</turn>` with a line break. The visitor
    writes the parts of a turn in order: escaped text, or a placeholder `<|type|>` for an image, an audio or a
    document, whose reference (turn's place, part's place, type, uri, tokens) goes to `attachments`.
    `loss_spans` are (start, length) pairs in code points of the flattened parts of each turn of `loss_role`.

    Turns are in the order of turn (null first), then role, then text. Null roles, texts and part lists are empty
    ones, an unknown type is a placeholder of one token, rows without conv_id are one conversation, repeated rows
    are turns of their own, and an empty table gives an empty result. Other columns are ignored.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    role = F.coalesce("role", F.lit(""))
    body = F.array_join(F.transform(parts, _visit), "")
    turns = messages.select("conv_id", "turn", role.alias("role"), body.alias("body"), F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text").alias("media"))
    head = F.concat(F.lit(TURN_OPEN), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv_id", "turn", "role", "body", "media", F.length(head).alias("lead"), F.concat(head, "body", F.lit(TURN_CLOSE)).alias("whole"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = turns.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        "whole",
        "media",
        F.when(F.col("role") == loss_role, F.struct((F.sum(F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "lead", F.length("body").alias("length"))).alias("loss"),
    )
    rows = F.sort_array(F.collect_list(F.struct("place", "whole", "media", "loss")))
    chats = placed.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["loss"].isNotNull()), lambda r: F.struct((F.coalesce(r["loss"]["before"], F.lit(0)) + r["loss"]["lead"]).cast("long").alias("start"), r["loss"]["length"].cast("long").alias("length")))
    media = F.flatten(F.transform("rows", lambda r: F.transform(r["media"], lambda p, k: F.struct(r["place"].alias("turn_place"), k.alias("part_place"), p["type"].alias("type"), p["uri"].alias("uri"), _tokens(p).alias("tokens")))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["whole"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda a, m: a + m["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    pieces = F.split(formatted, TURN_CLOSE)
    bodies = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.substring(p, len(TURN_OPEN) + 1, 1 << 30))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.lit(1 << 30))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def op4(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    nothing = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    part = F.struct(F.lit("text").alias("type"), F.col("text"), *[c.alias(n) for c, n in zip(nothing, ("uri", "width", "height", "seconds", "pages"))])
    chats = format_chats(rows.unionByName(own).select("conv_id", "turn", "role", F.array(part).alias("parts")))
    turns = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body,
  replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;') AS er FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS t,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '') AS l,
  sum(length(er) + length(body) + 15)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""
