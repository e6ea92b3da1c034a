"""Chat formatting by event-sourced reconstruction (operator 8): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What could be read as a control string by this template or by other common ones; its first character gets a mark.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """~ becomes ~0, and the mark ~1 follows the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, "~", "~0"), CONTROL, "$1~1")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])~1", "$1"), F.lit("~0"), F.lit("~"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("~2"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("~2"), F.lit("\n")))


def reconstructed(events: DataFrame) -> DataFrame:
    """Folds a log into final messages: (conv_id, at, part, role, text), one row per message.

    events: conv_id, seq, message_id, kind, role, text. In order of seq (ties: by kind, role, text), for each message_id:
    'message' opens a message with its text, 'delta' appends its text, 'edit' replaces all text so far, 'regenerate'
    drops all text so far and starts with its own. Another 'message' with the same id is a message of its own. A message
    stands where its first event does and has that event's role. Null texts and roles are empty, an unknown or null kind
    is a 'message'. A conversation's events for one message meet in one task, as its text is one value.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    starts = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: (i == 1) | (F.element_at("log", i)["kind"] == "message"))
    runs = F.transform("starts", lambda s, k: F.slice("log", s, F.coalesce(F.get("starts", k + 1), F.size("log") + 1) - s))
    runs = logs.withColumn("starts", starts).select("conv_id", F.posexplode(runs).alias("part", "run"))
    whole = F.filter(F.sequence(F.lit(1), F.size("run")), lambda i: (i == 1) | (F.element_at("run", i)["kind"] != "delta"))
    kept = F.slice("run", F.array_max(whole), F.size("run"))
    return runs.select("conv_id", F.col("run")[0]["seq"].alias("at"), "part", F.col("run")[0]["role"].alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss array<struct<start, length>>): messages in order, with the assistant texts' places.

    messages: conv_id, at, part, role, text, as reconstructed() returns them. start counts code points from 0. A
    conversation without messages has no row. Messages of one conversation meet in one task: they are one string.
    """
    head, body = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    parts = messages.select("conv_id", "at", "part", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("at", "part", "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("end", F.sum(size).over(order))
    turn = F.struct("end", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), (F.col("end") - len(CLOSE) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"), (F.col("role") == TRAINED).alias("trained"))
    turns = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text): the turns and the trained text, read from the output."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    body = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 1 << 30))
    turns = F.transform(body, lambda p: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.regexp_replace(p, r"^[^\n]*\n", "")).alias("text")))
    under = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return chats.select("conv_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def format_chats(events: DataFrame) -> DataFrame:
    """From a log of events to formatted conversations; see reconstructed() and formatted()."""
    return formatted(reconstructed(events))
