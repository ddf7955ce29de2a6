"""Chat formatting with one training example per assistant turn.

An example is the formatted conversation up to and including one assistant turn; only that reply is trainable. Contexts
of a conversation are prefixes of each other, so they are stored by reference: every turn is formatted once, with its
place in the conversation's text, and an example names the length of its context and the span of its reply.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


OPEN, CLOSE = "### ", "</turn>\n"

_TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*)</turn>\n\Z", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\|:|###|</turn>)")

SEGMENTS = "conv_id long, place long, start long, formatted string, reply_from long, reply_to long"


def escaped(text: Column, role: bool = False) -> Column:
    """Control strings with a backslash before them, and backslashes doubled; ``role`` also escapes colons."""
    return F.regexp_replace(text, r"(\\|:|###|</turn>)" if role else r"(\\|###|</turn>)", r"\\$1")


def parsed(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, text = _TURN.match(formatted).groups()
    return _ESCAPED.sub(r"\1", role), _ESCAPED.sub(r"\1", text)


def _running(batches):
    """Places and starts of sorted turns: a running total per conversation, never a whole one."""
    current, place, start = object(), 0, 0
    for batch in batches:
        places, starts, froms, tos = [], [], [], []
        rows = zip(*[batch.column(c).to_pylist() for c in ("conv_id", "head", "body", "chars", "trained")])
        for conv, head, body, chars, trained in rows:
            if conv != current:
                current, place, start = conv, 0, 0
            place += 1
            places.append(place)
            starts.append(start)
            froms.append(start + head if trained else None)
            tos.append(start + head + body if trained else None)
            start += chars
        kinds = [pa.array(x, pa.int64()) for x in (places, starts, froms, tos)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), kinds[0], kinds[1], batch.column("formatted"), kinds[2], kinds[3]],
            ["conv_id", "place", "start", "formatted", "reply_from", "reply_to"],
        )


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Every turn of ``turns(conv_id, turn, role, text)`` formatted, in order, with its span in the conversation.

    Returns ``conv_id, place`` (from 1), ``start`` (characters before it), ``formatted``, and ``reply_from, reply_to``, the
    span of an assistant's escaped text in the formatted conversation; NULL for other turns. Order is by ``turn``, NULL
    first, ties by role and text, so repeated rows stay side by side. A NULL role or text is empty; rows with a NULL
    ``conv_id`` form one conversation; other columns are ignored. An empty table has no turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit(": "))
    parts = clean.withColumns({"_head": head, "_body": escaped(F.col("text"))})
    lined = parts.select(
        "conv_id", "turn", "role", "text",
        F.concat("_head", "_body", F.lit(CLOSE)).alias("formatted"),
        F.char_length("_head").alias("head"), F.char_length("_body").alias("body"),
        (F.col("role") == "assistant").alias("trained"),
    ).withColumn("chars", F.char_length("formatted"))
    ordered = lined.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn", "role", "text")
    return ordered.mapInArrow(_running, SEGMENTS)


def examples(segments: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, place, context_turns, context_chars, reply_from, reply_to``.

    The example's text is the first ``context_chars`` of the conversation's formatted text and the turn at ``place``; the
    loss mask is ``[reply_from, reply_to)`` of it.
    """
    return segments.where("reply_from is not null").select(
        "conv_id", "place", (F.col("place") - 1).alias("context_turns"), F.col("start").alias("context_chars"), "reply_from", "reply_to"
    )


def example_texts(segments: DataFrame) -> DataFrame:
    """Examples written out, ``conv_id, place, text, reply_from, reply_to``, for conversations a row can hold.

    The text of all examples of a conversation grows with the square of its turns.
    """
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    grown = segments.withColumn("text", F.array_join(F.collect_list("formatted").over(before), ""))
    return grown.where("reply_from is not null").select("conv_id", "place", "text", "reply_from", "reply_to")


def _digests(batches):
    """Digests of sorted segments, each followed by its example if it has one, streamed turn by turn."""
    current, state, done, formatted = object(), None, [], ""

    def close():
        n, turns, loss_chars, loss, chars, shown = state
        done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, shown))

    columns = ("conv_id", "place", "example", "formatted", "context_turns", "context_chars", "reply_from", "reply_to")
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in columns])
        for conv, place, example, segment, context_turns, context_chars, first, last in rows:
            if state is None or conv != current:
                if state is not None:
                    close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            if example:
                # The context is every turn before this one; what it names must be what was read.
                before = state[4] - len(formatted)
                if (place, context_turns, context_chars) != (state[0], state[0] - 1, before):
                    raise ValueError(f"example {place} of conversation {conv} names another context than its segments")
                reply = _ESCAPED.sub(r"\1", formatted[first - context_chars : last - context_chars])
                state[2] += len(reply)
                state[3].update(reply.encode())
                state[5] += context_chars + len(formatted)
                continue
            formatted = segment
            role, text = parsed(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(formatted)
        if done:
            yield _digest_batch(done)
            done = []
    if state is not None:
        close()
        yield _digest_batch(done)


_DIGESTS = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "example_chars": pa.int64(),
}


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _DIGESTS.values())], list(_DIGESTS))


def digests(segments: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """What a reader of the segments and their ``examples`` gets back, per conversation.

    ``n_turns, turns_sha256`` over roles and texts, ``loss_chars, loss_sha256`` over the unescaped text under the examples'
    loss masks, ``formatted_chars`` of the conversation, and ``example_chars``, the characters of all its examples written
    out. Every example's context is resolved through the segments before it: one that names other turns or another
    length than these have is an error. Turns after the last reply belong to no example and count for the conversation.
    """
    shown = examples(segments) if shown is None else shown
    none = F.lit(None).cast("long")
    turns = segments.select("conv_id", "place", F.lit(0).alias("example"), "formatted", *[none.alias(c) for c in ("context_turns", "context_chars", "reply_from", "reply_to")])
    named = shown.select("conv_id", "place", F.lit(1).alias("example"), F.lit(None).cast("string").alias("formatted"), "context_turns", "context_chars", "reply_from", "reply_to")
    ordered = turns.union(named).repartition("conv_id").sortWithinPartitions("conv_id", "place", "example")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, example_chars long"
    return ordered.mapInArrow(_digests, schema)
