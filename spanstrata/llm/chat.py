"""Chat formatting of typed content parts, with reversible escapes and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "\n</turn>\n"
#: Expanded tokens of one attachment: of an image by tiles, of audio by seconds, of a document by pages.
TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    r"""Puts ``\`` before each ``\`` and before every control string of the template."""
    return F.regexp_replace(text, r"(\\|###|</turn>|<\|)", r"\\$1")


def unescape(text: Column) -> Column:
    r"""Drops each ``\`` that starts an escape; the inverse of ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """Content of a turn that is text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")).cast(PART))


def visit(parts: Column) -> Column:
    """Flattens typed parts: ``body``, ``attachments`` (ordinal, type, ref, tokens, at) and ``tokens``.

    Text is escaped; every other part becomes a placeholder ``<|type n|>``, numbered from 0 in
    its turn, with the place where it stands in the body.  A null list, part, text or type
    counts as empty text; a type without a known cost expands to no tokens.
    """
    cost = F.create_map(*(x for k, v in TOKENS.items() for x in (F.lit(k), F.lit(v))))
    start = F.struct(F.lit("").alias("body"), F.array().cast("array<struct<ordinal:int,type:string,ref:string,tokens:bigint,at:int>>").alias("attachments"))

    def step(done, part):
        kind = F.coalesce(part["type"], F.lit("text"))
        n = F.size(done["attachments"])
        tokens = F.coalesce(part["units"], F.lit(1)) * F.coalesce(F.try_element_at(cost, kind), F.lit(0))
        mark = F.concat(F.lit("<|"), F.regexp_replace(kind, "[^a-z]", "_"), F.lit(" "), n.cast("string"), F.lit("|>"))
        one = F.struct(n.alias("ordinal"), kind.alias("type"), part["ref"].alias("ref"), tokens.cast("bigint").alias("tokens"), F.length(done["body"]).alias("at"))
        return F.struct(
            F.concat(done["body"], F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)).alias("body"),
            F.when(kind == "text", done["attachments"]).otherwise(F.concat(done["attachments"], F.array(one))).alias("attachments"),
        )

    empty = F.array().cast(f"array<{PART}>")
    return F.aggregate(F.coalesce(parts, empty), start, step)


def format_turns(turns: DataFrame, parts: Column | None = None) -> DataFrame:
    r"""One row per turn: ``conv_id, turn, role, piece, loss_start, loss_length, attachments, tokens``.

    ``piece`` is ``### role``, a line end, the flattened content, a line end, ``</turn>`` and a
    line end; a conversation is its pieces in the order of ``turn``, then role and text.  The
    loss mask of an assistant turn covers the content (``loss_start`` code points into the
    piece), of any other turn nothing.  ``%`` and line ends of a role are written ``%25`` and
    ``%0A``.  Null roles and texts count as empty; a null conv_id is a conversation of its own,
    a null turn comes first, repeated rows are repeated turns; no rows give no rows.  Other
    columns are ignored.
    """
    content = text_part(F.col("text")) if parts is None else parts
    role = F.coalesce("role", F.lit(""))
    seen = turns.select("conv_id", "turn", role.alias("role"), visit(content).alias("seen"))
    head = F.concat(F.lit(HEAD), _role_out(F.col("role")), F.lit("\n"))
    return seen.select(
        "conv_id", "turn", "role",
        F.concat(head, "seen.body", F.lit(END)).alias("piece"),
        F.when(F.col("role") == "assistant", F.length(head)).alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length("seen.body")).alias("loss_length"),
        F.col("seen.attachments").alias("attachments"),
        F.aggregate("seen.attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("tokens"),
    )


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``offset``, the code points of the conversation before each piece."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))


def conversations(pieces: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: each conversation as one text.

    ``loss`` lists for each turn the masked text's ``start`` and ``length`` in the turn's part
    of ``formatted`` (nulls: nothing masked), in order.
    """
    row = F.struct("turn", "role", "piece", "loss_start", "loss_length")
    rows = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select(
        "conv_id",
        F.array_join("rows.piece", "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["loss_start"].alias("start"), r["loss_length"].alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted_chars, turns`` from the formatted text alone: role, text and the text under the loss mask of each turn.

    An escaped text holds no ``</turn>`` without a ``\\`` before it, so the end mark after a
    line end separates the turns.
    """
    split = F.split("formatted", "\n</turn>\n", -1)
    parts = formatted.select("conv_id", "loss", F.length("formatted").cast("long").alias("formatted_chars"), F.slice(split, 1, F.size(split) - 1).alias("parts"))

    def turn(part, i):
        mask = F.element_at("loss", i + 1)
        return F.struct(
            _role_in(F.substring(F.regexp_extract(part, "^[^\n]*", 0), len(HEAD) + 1, 1 << 30)).alias("role"),
            unescape(F.regexp_extract(part, "(?s)^[^\n]*\n(.*)", 1)).alias("text"),
            unescape(F.when(mask["length"].isNotNull(), F.substr(part, mask["start"] + 1, mask["length"]))).alias("learnt"),
        )

    return parts.select("conv_id", "formatted_chars", F.transform("parts", turn).alias("turns"))
