"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, turn, kind, role, text). They are folded by conversation in order of seq:

* ``delta``: its text is appended to the message of its turn;
* ``edit``: its text replaces what the message of its turn holds so far;
* ``regenerate``: the message of its turn starts again with its text, and what was written before it in later turns is
  dropped; such a turn may be written again.

A message's role is that of its last event that names one. The template writes one block a message,
``### role:`` newline, text, ``</turn>`` newline. Inside roles and texts a backslash becomes ``\\b``, ``#`` becomes ``\\h``
and ``<`` becomes ``\\l`` (in roles also a line feed ``\\n``), so a block mark never occurs inside and reading undoes it.

A null role, text or kind counts as '', '' and ``delta``; a null turn sorts first, as a turn of its own. Events with equal seq
are ordered by kind, role and text; repeated rows are repeated events. Empty texts keep their block. An empty log gives
no row. Other columns are not read.

``log_of_turns`` makes a log of a table of finished turns: every row is one message, rows with equal or null turns and repeated rows too.
They are numbered by turn (nulls first), role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import let

HEAD, COLON, END = "### ", ":\n", "</turn>\n"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
MARKS = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column, marks=MARKS) -> Column:
    for raw, mark in marks:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column, marks=MARKS) -> Column:
    for raw, mark in reversed(marks):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


ROLE_MARKS = (*MARKS, ("\n", "\\n"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the messages that the log ends with."""
    log = events.select(
        "conv_id",
        "turn",
        F.struct(
            F.col("seq"),
            F.coalesce("kind", F.lit(DELTA)).alias("kind"),
            F.col("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("e"),
    )
    folded = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("events"))
    redone = F.array_max(F.filter("events", lambda e: e["kind"] == REGENERATE))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cut = folded.withColumn("_redone", redone).withColumn("_cut", F.max("_redone").over(before))
    left = cut.select("conv_id", "turn", F.filter("events", lambda e: F.col("_cut").isNull() | (e > F.col("_cut"))).alias("events")).filter(F.size("events") > 0)
    begin = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"].isin(EDIT, REGENERATE), i).otherwise(F.lit(0))))
    live = let(begin, lambda b: F.filter("events", lambda e, i: i >= b))
    named = F.filter("events", lambda e: e["role"].isNotNull())
    return left.select(
        "conv_id",
        "turn",
        F.coalesce(F.get(named, F.size(named) - 1)["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def log_of_turns(rows: DataFrame) -> DataFrame:
    """Each row of rows (conv_id, turn, role, text) as one delta of a turn of its own."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    turn = F.row_number().over(order).cast("long")
    numbered = rows.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"))
    return numbered.withColumns({"seq": F.col("turn"), "kind": F.lit(DELTA)})


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a conversation: the formatted text and its loss mask.

    loss holds a span for each message of the role ``learn``: the number of its block, where its text begins and ends in the
    block, and where the block begins in the formatted text, all in code points.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_MARKS), F.lit(COLON))
    blocks = messages.select("conv_id", "turn", (F.col("role") == learn).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    blocks = blocks.withColumn("block", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    placed = blocks.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("n"),
        F.coalesce(F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"),
        "learn",
        F.length("head").alias("begin"),
        (F.length("head") + F.length("body")).alias("end"),
        "block",
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "at", "learn", "begin", "end", "block"))).alias("rows"))
    span = lambda r: F.struct(r["n"].alias("block"), r["begin"].alias("begin"), r["end"].alias("end"), r["at"].alias("block_at"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["block"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["learn"]), span).alias("loss"),
    )


def format_log(events: DataFrame, learn: str = "assistant") -> DataFrame:
    return render(reconstruct(events), learn)


def parse(formatted: DataFrame) -> DataFrame:
    """Roles and texts, and the text under the loss mask, from formatted text alone: conv_id, turns, learned."""
    blocks = F.split("formatted", F.lit(END), -1)

    def turn(block: Column) -> Column:
        at = F.locate(COLON, block)
        return F.struct(
            unescape(F.substring(block, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), ROLE_MARKS).alias("role"),
            unescape(F.substring(block, at + len(COLON), F.length(block))).alias("text"),
        )

    def read(all_blocks: Column) -> Column:
        whole = F.slice(all_blocks, F.lit(1), F.size(all_blocks) - 1)  # after the last mark nothing follows
        under = lambda m: unescape(F.substring(F.get(all_blocks, m["block"]), m["begin"] + 1, m["end"] - m["begin"]))
        return F.struct(F.transform(whole, turn).alias("turns"), F.transform("loss", under).alias("learned"))

    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), let(blocks, read).alias("r")).select("conv_id", "formatted_chars", "r.turns", "r.learned")
