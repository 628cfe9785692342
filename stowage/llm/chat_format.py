r"""Conversations as training texts: a visitor over typed content parts, a template with escapes, and a loss mask.

A conversation becomes ``<s>``, its turns in order, ``</s>``; a turn is ``<|im_start|>role<|im_sep|>body<|im_end|>``. A body is what the visitor makes
of the turn's parts, in order: a text part its escaped text, an image, audio or document part a placeholder. The k-th placeholder of a
conversation belongs to the k-th of its ``attachments``, which keep kind, reference, place and the number of tokens the placeholder stands for.

Escapes: ``\`` is doubled, and a control string inside a text gets a ``\`` after its first character, so no text holds one. Going back, every
``\`` goes and the character after it stays if it is one too. ``loss`` holds the spans (code points of the formatted text, end exclusive) of the text
parts of assistant turns.

Everything is a column expression; a conversation is ordered and put together in one grouping, and has to fit in a row, as its digest needs it whole.

Defined cases: null text or role is empty; a null list of parts, and one without parts, give an empty body; a null part is left out; a part of
unknown or null type counts as a document; sizes that are missing or below one count as the least. Turns come by number, a null number
last; rows with equal number by role, then text; repeated rows stay. A null ``conv_id`` is a conversation of its own. An
empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
TURN, SEPARATOR, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Strings that a text must not hold as they are: those of this template and turn marks of another common one.
CONTROL = (BEGIN, END, "[INST]", "[/INST]", TURN, SEPARATOR, TURN_END, *PLACEHOLDERS.values())
LEARNED_ROLE = "assistant"
# Tokens of a placeholder: image patches of so many pixels square, tokens a second of audio, tokens a page of a document.
PATCH, A_SECOND, A_PAGE = 28, 25, 256
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
ATTACHMENT = "struct<kind:string,ref:string,at:bigint,n_tokens:bigint>"
SPAN = "struct<start:bigint,end:bigint>"
REGEX_MARKS = "\\[]|/.()*+?^$"


def quoted(text: str) -> str:
    """A regular expression that stands for the text itself."""
    return "".join("\\" + c if c in REGEX_MARKS else c for c in text)


def opening() -> str:
    """Matches the first character of every control string."""
    firsts = sorted({c[0] for c in CONTROL})
    return "|".join(f"{quoted(a)}(?={'|'.join(quoted(c[1:]) for c in CONTROL if c[0] == a)})" for a in firsts)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), opening(), "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def expanded(part: Column) -> Column:
    """How many tokens a placeholder stands for."""
    least = lambda x: F.greatest(F.coalesce(x.cast("long"), F.lit(1)), F.lit(1))
    patches = lambda x: F.ceil(least(x) / PATCH)
    return (
        F.when(part["type"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["type"] == "audio", least(F.ceil(part["seconds"] * A_SECOND)))
        .otherwise(least(part["pages"]) * A_PAGE)
        .cast("long")
    )


def visited(parts: Column) -> Column:
    """(piece, kind, ref, n_tokens) of every part; kind is null for a text."""

    def visit(part: Column) -> Column:
        is_text = F.coalesce(part["type"] == "text", F.lit(False))
        kind = F.when(~is_text, F.when(part["type"].isin(*PLACEHOLDERS), part["type"]).otherwise("document"))
        mark = F.coalesce(*[F.when(kind == k, F.lit(p)) for k, p in PLACEHOLDERS.items()])
        return F.struct(
            F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(mark).alias("piece"),
            kind.alias("kind"),
            F.when(~is_text, part["ref"]).alias("ref"),
            F.when(~is_text, expanded(part)).alias("n_tokens"),
        )

    return F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), visit)


def laid_out(pieces: Column, start: Column, learned: Column) -> Column:
    """Attachments and loss spans of one turn whose body starts at ``start``."""
    nothing = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{ATTACHMENT}>").alias("attachments"), F.array().cast(f"array<{SPAN}>").alias("loss"))

    def step(held: Column, piece: Column) -> Column:
        end = held["at"] + F.length(piece["piece"])
        attachment = F.struct(piece["kind"].alias("kind"), piece["ref"].alias("ref"), held["at"].alias("at"), piece["n_tokens"].alias("n_tokens")).cast(ATTACHMENT)
        span = F.struct(held["at"].alias("start"), end.alias("end")).cast(SPAN)
        return F.struct(
            end.cast("long").alias("at"),
            F.when(piece["kind"].isNull(), held["attachments"]).otherwise(F.concat(held["attachments"], F.array(attachment))).alias("attachments"),
            F.when(piece["kind"].isNull() & learned, F.concat(held["loss"], F.array(span))).otherwise(held["loss"]).alias("loss"),
        )

    return F.aggregate(pieces, nothing, step)


def formatted(messages: DataFrame, parts: str | None = None) -> DataFrame:
    """(conv_id, formatted, loss, attachments, n_attachment_tokens) of conversations, a row each.

    ``messages`` has conv_id, turn, role and either text or, under the name ``parts``, an array of parts (see ``PART``).
    """
    if parts is None:
        text = F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")])
        content, last = F.array(text.cast(PART)), F.col("text")
    else:
        content = F.col(parts).cast(f"array<{PART}>")
        last = F.to_json(content)
    turns = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(last, F.lit("")).alias("__last"),
        visited(content).alias("pieces"),
    )
    turns = turns.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SEPARATOR))).withColumn("segment", F.concat("head", F.array_join("pieces.piece", ""), F.lit(TURN_END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "__last")
    before = F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        "segment",
        "pieces",
        (before + len(BEGIN) + F.length("head")).alias("start"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
    ).withColumn("out", laid_out(F.col("pieces"), F.col("start"), F.col("learned")))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "segment", "out.loss", "out.attachments"))).alias("turns"))
    return whole.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join("turns.segment", ""), F.lit(END)).alias("formatted"),
        F.flatten("turns.loss").alias("loss"),
        F.flatten("turns.attachments").alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def turns_of(text: Column) -> Column:
    """The turns (role, body) in a formatted text; texts come back unescaped, placeholders stay."""
    inner = F.substr(text, F.lit(len(BEGIN) + 1), F.length(text) - len(BEGIN) - len(END))
    cut = F.split(inner, quoted(TURN_END))

    def back(segment: Column) -> Column:
        halves = F.split(F.substr(segment, F.lit(len(TURN) + 1)), quoted(SEPARATOR), 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(F.slice(cut, 1, F.size(cut) - 1), back)


def learned_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and checksums of conversations, read back from what ``formatted`` made of them."""
    read = conversations.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
