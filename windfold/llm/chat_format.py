"""Chat formatting from event logs.

A conversation is a log of events in sequence: whole messages, streamed deltas,
edits and regenerations.  Window functions find the events that later ones undo,
what is left folds into final messages, and each message is rendered with a
template that marks turns and escapes control strings in texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windfold.llm import common as c

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """``<`` and ``|`` with k backslashes between them get one more, so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    """A role is one line: backslashes are doubled and line feeds written as backslash and n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, role, text``: the final messages of ``conv_id, seq, kind, turn, role, text``.

    Kinds: "message" is a whole message of its turn, "delta" text to append to
    its turn's message, "edit" the new text of its turn (what its turn had before
    is undone), "regenerate" undoes its turn and all later turns, whose texts may
    follow anew.  Events are ordered by ``seq``, ties by kind (message, delta,
    edit, regenerate), then role and text.  Several live messages of one turn
    are messages of their own (``copy`` counts them, from 0); deltas and edits
    belong to the turn's last message.  Null texts and roles are empty, a null
    kind is a message; null identifiers and turns are values like others and
    rank first.  An undone turn leaves nothing.
    """
    kind = F.coalesce("kind", F.lit("message"))
    rank = F.when(kind == "message", 0).when(kind == "delta", 1).when(kind == "edit", 2).otherwise(3)
    e = events.select("conv_id", "seq", rank.alias("rank"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("rank"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("rank") == 3, F.coalesce("turn", F.lit(c.NULL_ID)))).over(later)
    e = e.withColumn("cut", cut).where("rank < 3 AND (cut IS NULL OR cut > coalesce(turn, -9223372036854775808))")
    within = Window.partitionBy("conv_id", "turn").orderBy("seq", "rank", "role", "text")
    later = Window.partitionBy("conv_id", "turn").orderBy(F.desc("seq"), F.desc("rank"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("undone", F.coalesce(F.max(F.col("rank") == 2).over(later), F.lit(False))).where("NOT undone")
    e = e.withColumns({"nth": F.row_number().over(within), "copy": F.greatest(F.sum((F.col("rank") == 0).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - 1, F.lit(0))})
    parts = F.sort_array(F.collect_list(F.struct("nth", "role", "text")))
    m = e.groupBy("conv_id", "turn", "copy").agg(parts.alias("p"))
    role = F.coalesce(F.get(F.filter(F.transform("p", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit(""))
    return m.select("conv_id", "turn", "copy", role.alias("role"), F.concat_ws("", F.transform("p", lambda x: x["text"])).alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """``messages`` with ``head, body, tail``: the template's text before, in and after the message's own, which is under the loss mask if ``loss``."""
    return messages.select("conv_id", "turn", "copy", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), F.lit(END + "\n").alias("tail"), (F.col("role") == "assistant").alias("loss"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its rendered text, rows in order of conversation and turn."""
    seen, one = False, None
    for batch in batches:
        out = []
        for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not seen or conv != one:
                if seen:
                    out.append((one, n, turns.hexdigest(), chars, masked.hexdigest(), size))
                seen, one, n, chars, size, turns, masked = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            size += len(text)
            for turn in text.split(START)[1:]:
                role, _, body = turn[: turn.index(END)].partition("\n")
                role, body = unescaped_role(role), unescaped(body)
                n += 1
                turns.update(f"{role}\n{body}\n".encode())
                if loss:
                    chars += len(body)
                    masked.update(body.encode())
        yield _digests(out)
    if seen:
        yield _digests([(one, n, turns.hexdigest(), chars, masked.hexdigest(), size)])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def formatted(events: DataFrame) -> DataFrame:
    """Event log to rendered messages, one row each, in no order: see :func:`fold` and :func:`rendered`."""
    return rendered(fold(events))


def digests(messages: DataFrame) -> DataFrame:
    """One row per conversation, read back from rendered messages in order of turn; a conversation streams through its task message by message."""
    spark = c.prepared(messages)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = messages.select("conv_id", F.concat("head", "body", "tail").alias("text"), "loss", "turn", "copy")
    return text.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "copy").select("conv_id", "text", "loss").mapInArrow(_read_back, _DIGEST)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each row a whole message, in order of turn."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text")
