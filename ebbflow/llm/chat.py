"""Chat formatting by event-sourced reconstruction (operator 10).

A log of events (conv_id, message, seq, kind, role, text) is partitioned by
conversation and message, sorted by sequence and folded: ``message`` and
``edit`` set the text, ``regenerate`` empties it, ``delta`` appends; any other
kind changes nothing. The fold is one aggregate expression, so a conversation
with very many messages is spread over tasks. ``render`` gives one segment per
message, in order of the message's first ``seq`` (ties by role, then text), and
the place of the loss mask in it.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. A control
string inside a text or role gets a backslash after its first character and
every backslash is doubled, so no control string is left and ``unescape``
restores the text exactly; a newline in a role gets a backslash before it.

Results: null text or role is empty; a null conv_id is a conversation of its
own; repeated rows are separate turns; an empty log gives no rows.

``digest`` needs a conversation's turns in one sequence because SHA-256 is
sequential; rows stream through the task one Arrow batch at a time, so memory
does not grow with the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string.
_CONTROL = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>|\|[^|<>]*\|>)"
_SEGMENT = re.compile(r"<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*)<\|im_end\|>\n", re.S)
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Whole turns as a log: each row is one ``message`` event of a message of its own."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("message"),
        F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, seq, role, text) of an event log."""
    text = F.coalesce("text", F.lit(""))
    step = F.struct("seq", "kind", F.col("text").alias("t"))

    def apply(acc: Column, e: Column) -> Column:
        return (F.when(e.kind.isin("message", "edit"), e.t).when(e.kind == "regenerate", F.lit(""))
                .when(e.kind == "delta", F.concat(acc, e.t)).otherwise(acc))

    return (events.withColumn("text", text).groupBy("conv_id", "message")
            .agg(F.array_sort(F.collect_list(step)).alias("_log"), F.min("seq").alias("seq"),
                 F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.coalesce("seq", F.lit(0)))), F.lit("")).alias("role"))
            .select("conv_id", "message", "seq", "role", F.aggregate("_log", F.lit(""), apply).alias("text")))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Segments (conv_id, seq, segment, loss_from, loss_to); the mask covers the texts of role ``trained``."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head, body = F.concat(F.lit(OPEN), role, F.lit("\n")), escape(F.col("text"))
    at = F.length("_head")
    return (messages.withColumn("_head", head).withColumn("_body", body)
            .select("conv_id", "seq", F.concat("_head", "_body", F.lit(CLOSE + "\n")).alias("segment"),
                    F.when(F.col("role") == trained, at).cast("int").alias("loss_from"),
                    F.when(F.col("role") == trained, at + F.length("_body")).cast("int").alias("loss_to")))


def write_chat(segments: DataFrame, path: str) -> None:
    """Conversations in order inside each file; their segments, joined, are the formatted text."""
    (segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "segment")
     .write.mode("overwrite").parquet(path))


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation, from the formatted files alone."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key, state, done = None, None, []

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, size = state
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], pa.string() if "sha" in c else pa.int64()) for i, c in enumerate(names)],
                names=names)
            done.clear()
            return rows

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != key:
                    close()
                    key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                segment = row["segment"]
                role, text = parse(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
                if row["loss_from"] is not None:
                    masked = unescape(segment[row["loss_from"]:row["loss_to"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            yield out()
        close()
        yield out()

    return (spark.read.parquet(path).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "segment")
            .mapInArrow(sums, DIGEST))
