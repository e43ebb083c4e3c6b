"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, and only
that reply is trainable.  A conversation is cut into pages of ``PAGE`` turn numbers, so that no
group of :func:`format_chats` grows without bound; an example of it holds the turns of its page up
to the reply, and the whole pages before it are the rows with ``closes`` set.
:func:`format_whole` joins those pages in front, so that every example holds all of its context;
what it writes grows with the square of a conversation's length, as the examples themselves do.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts every backslash
is doubled, and a backslash is put after the first character of every control string, so no
control string can arise there; :func:`unescape` undoes it exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a template uses, of this or of common other formats.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Turn numbers of a page.
PAGE = 64

_CONTROL_RE = "([<\\[])(?=(?:" + "|".join(re.escape(c[1:]) for c in CONTROL) + "))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_RE, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))


def _pages(turns: DataFrame, page: int) -> DataFrame:
    """(conv_id, page, segments, roles, lengths): the turns of each page in order."""
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pages = turns.groupBy(F.col("conv_id"), F.floor(F.col("turn") / page).cast("long").alias("page")).agg(
        F.sort_array(F.collect_list(said)).alias("said")
    )
    return pages.select(
        "conv_id", "page", F.transform("said", _turn).alias("segments"), F.transform("said", lambda t: t["role"]).alias("roles"),
        F.transform("said", lambda t: F.length(escape(t["text"]))).alias("lengths"),
    )


def _examples(pages: DataFrame, trainable: str) -> DataFrame:
    """The examples of pages that have (context, earlier, last): text and number of the turns before, and whether to close."""
    n = F.size("roles")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("roles", i) == trainable) | (F.col("last") & (i == n)))
    examples = pages.select("*", F.explode(ends).alias("at"))
    trained = F.element_at("roles", F.col("at")) == trainable
    chars = F.element_at("lengths", F.col("at"))
    formatted = F.concat("context", F.array_join(F.slice("segments", 1, F.col("at")), ""))
    return examples.select(
        "conv_id", "page", (F.col("earlier") + F.col("at")).alias("example"), formatted.alias("formatted"), trained.alias("trained"),
        chars.alias("chars"), (F.col("last") & (F.col("at") == n)).alias("closes"),
    ).select(
        "conv_id", "page", "example", "formatted",
        F.when(F.col("trained"), F.length("formatted") - len(END) - F.col("chars") + 1).cast("int").alias("loss_start"),
        F.when(F.col("trained"), F.col("chars")).otherwise(0).cast("int").alias("loss_chars"),
        "closes",
    )


def format_chats(turns: DataFrame, page: int = PAGE, trainable: str = "assistant") -> DataFrame:
    """(conv_id, page, example, formatted, loss_start, loss_chars, closes) from (conv_id, turn, role, text).

    One row for each turn of role ``trainable``, and one without a trained reply where a page
    ends with another turn.  ``example`` is the place of the last turn in the page, from 1;
    the code points ``[loss_start, loss_start + loss_chars)`` of ``formatted`` (from 1) are under the
    loss mask.  Null roles and texts count as empty; turns are ordered by number, then role
    and text, null numbers first (they make a page of their own).  Rows with a null
    conversation form one conversation.
    """
    alone = {"context": F.lit(""), "earlier": F.lit(0), "last": F.lit(True)}
    return _examples(_pages(turns, page).withColumns(alone), trainable)


def format_whole(turns: DataFrame, page: int = PAGE, trainable: str = "assistant") -> DataFrame:
    """The rows of :func:`format_chats`, each with all preceding turns of its conversation as context.

    ``example`` is the place of the last turn in the conversation; only the row that holds the
    whole conversation has ``closes`` set.
    """
    pages = settle(_pages(turns, page), "chat-pages")  # read as pages and as the context of later ones
    closed = F.struct("page", F.size("roles").alias("turns"), F.array_join("segments", "").alias("closed"))
    many = pages.groupBy("conv_id").agg(F.sort_array(F.collect_list(closed)).alias("all")).filter(F.size("all") > 1)
    each = many.select(F.col("conv_id").alias("conv"), F.posexplode("all").alias("at", "p"), "all")
    ahead = F.slice("all", F.lit(1), F.col("at"))
    each = each.select(
        "conv", F.col("p")["page"].alias("own"), F.array_join(F.transform(ahead, lambda p: p["closed"]), "").alias("context"),
        F.aggregate(ahead, F.lit(0), lambda total, p: total + p["turns"]).alias("earlier"), (F.col("at") + 1 == F.size("all")).alias("last"),
    )
    joined = pages.join(each, pages["conv_id"].eqNullSafe(each["conv"]) & pages["page"].eqNullSafe(each["own"]), "left")
    alone = {"context": F.coalesce("context", F.lit("")), "earlier": F.coalesce("earlier", F.lit(0)), "last": F.coalesce("last", F.lit(True))}
    return _examples(joined.withColumns(alone), trainable)


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string holds."""
    parts = F.slice(F.split(formatted, re.escape(TURN)), 2, 1 << 30)

    def back(p: Column) -> Column:
        halves = F.split(p, re.escape(TEXT))
        text = F.element_at(halves, 2)
        return F.struct(
            unescape(F.element_at(halves, 1)).alias("role"),
            unescape(F.substring(text, F.lit(1), F.length(text) - len(END))).alias("text"),
        )

    return F.transform(parts, back)


def reply(formatted: str = "formatted", start: str = "loss_start", chars: str = "loss_chars") -> Column:
    """The text under the loss mask, unescaped; empty where nothing is trained."""
    return F.coalesce(unescape(F.substring(F.col(formatted), F.col(start), F.col(chars))), F.lit(""))


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back: a row per conversation.

    Pages and replies are joined in order; the digests need the whole conversation in one value.
    """
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    page = F.struct("page", F.when(F.col("closes"), turns).alias("turns"))
    per = examples.select(
        "conv_id", "page", "example", "closes", page.alias("p"), reply().alias("reply"), F.length("formatted").alias("chars"),
        F.when(F.col("closes"), F.size(read_turns(F.col("formatted")))).otherwise(0).alias("n"),
    )
    per = per.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.when(F.col("closes"), F.col("p")))).alias("pages"),
        F.sort_array(F.collect_list(F.struct("page", "example", "reply"))).alias("replies"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return per.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("pages", lambda p: p["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
