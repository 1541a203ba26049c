"""Conversations rebuilt from event logs and rendered in a chat template, with DataFrame functions only.

An event is (conv_id, seq, turn, kind, role, text). In order of ``seq`` they fold into messages:
``message`` sets a turn's role and text, ``delta`` adds to its text, ``edit`` replaces the text and
``regenerate`` empties it for what follows and drops the later turns that were written before it.
Only what follows the last event that isn't a delta makes the text, so folding takes one pass over a turn's events.
Logs are dealt out by conversation and turn for folding, so the events of a long conversation spread; then by
conversation for rendering. Only one turn's events and one conversation's messages have to meet in a row, as each is one string.

The template is ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks). Inside a text every
``<``, backslashes, ``|`` gets one more backslash, so no control string can appear in it, and reading takes
that backslash out again; in a role ``%``, ``<`` and line ends become %25, %3C and %0A.

Behaviour: a null text or role is empty; a null kind or an unknown one counts as ``message``; events
of equal seq go by kind, role and text, so repeated rows fold the same way each time; a null turn comes last; a null
conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the final messages."""
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = events.select("conv_id", "turn", event.alias("event")).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("event")).alias("log"))

    def last_place(wanted) -> Column:
        return F.array_max(F.transform("log", lambda e, i: F.when(wanted(e.kind), i + 1).otherwise(0)))

    placed = turns.select("conv_id", "turn", "log", last_place(lambda k: k != "delta").alias("reset"), last_place(lambda k: k == "message").alias("named"))
    tail = F.slice("log", F.greatest("reset", F.lit(1)), F.size("log"))
    role = F.when(F.col("named") > 0, F.get("log", F.col("named") - 1).role).otherwise("")
    later = F.filter(F.slice("log", F.col("named") + 1, F.size("log")), lambda e: e.role != "")
    redone = F.array_max(F.transform(F.filter("log", lambda e: e.kind == "regenerate"), lambda e: e.seq))
    folded = placed.select(
        "conv_id",
        "turn",
        F.when(role != "", role).otherwise(F.coalesce(F.get(later, F.lit(0)).role, F.lit(""))).alias("role"),
        F.array_join(F.transform(tail, lambda e: F.when(e.kind == "regenerate", "").otherwise(e.text)), "").alias("text"),
        F.array_max(F.transform("log", lambda e: e.seq)).alias("last"),
        F.when(F.col("turn").isNotNull(), redone).alias("redone"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn")).rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.col("turn").isNotNull() & (F.max("redone").over(before) > F.col("last"))
    return folded.withColumn("dropped", dropped).filter("NOT coalesce(dropped, false)").select("conv_id", "turn", "role", "text")


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from (conv_id, turn, role, text), a row for each message.

    loss_spans are the texts of ``learned_role`` within ``formatted``, which a loss is computed on: start and length in code
    points from 1, and the same start as message (from 0) and offset within that message (from 1).
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "turn", head.alias("head"), escape_text(F.col("text")).alias("text"), (F.col("role") == learned_role).alias("learned"))
    pieces = parts.select("conv_id", "turn", F.concat("head", "text", F.lit(END + "\n")).alias("piece"), F.length("text").alias("length"), (F.length("head") + 1).alias("offset"), "learned")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"))
    upto = F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")
    placed = pieces.withColumns({"message": F.row_number().over(order) - 1, "start": upto + F.col("offset")})
    met = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "piece", "start", "length", "offset", "learned"))).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p.learned), lambda p: F.struct(p.start.alias("start"), p.length.alias("length"), p.message.alias("message"), p.offset.alias("offset")))
    return met.select("conv_id", F.array_join(F.transform("parts", lambda p: p.piece), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(events: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation in the event log."""
    return render(fold_events(events), learned_role)


def as_events(rows: DataFrame) -> DataFrame:
    """An event log of finished (conv_id, turn, role, text) rows as a chat server would have written it.

    A row of the assistant was begun once, regenerated and streamed in two parts; any other was posted as a draft and edited. Rows of a conversation
    are turns in order of turn, role and text; equal rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), role, text)
    numbered = rows.select("conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    half = (F.length("text") / 2).cast("int")
    event = lambda step, kind, role, text: F.struct((F.col("turn") * 4 + step).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    nobody, draft = F.lit(None).cast("string"), F.concat(F.lit("draft of "), F.left("text", F.lit(20)))
    streamed = F.array(event(0, "delta", F.col("role"), draft), event(1, "regenerate", nobody, nobody), event(2, "delta", nobody, F.substring("text", F.lit(1), half)), event(3, "delta", nobody, F.expr("substring(text, cast(length(text) / 2 as int) + 1)")))
    edited = F.array(event(0, "message", F.col("role"), draft), event(1, "edit", nobody, F.col("text")))
    return numbered.select("conv_id", "turn", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("event")).select("conv_id", "turn", "event.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): roles and texts parsed out of the rendered string, and the texts under the loss mask."""
    split = F.split("formatted", r"<\|im_start\|>")
    pieces = formatted.select("conv_id", "formatted", "loss_spans", F.slice(split, F.lit(2), F.size(split)).alias("pieces"))
    n_head, n_tail = len(START), len(END + "\n")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        begin = F.length(role) + 2
        text = F.substring(piece, begin, F.length(piece) - begin + 1 - n_tail)
        return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"))

    learned = F.transform("loss_spans", lambda s: unescape_text(F.substring(F.get("pieces", s.message), s.offset - n_head, s.length)))
    return pieces.select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(learned, "").alias("loss_text"), "formatted")
