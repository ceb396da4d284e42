"""Chat formatting by event-sourced reconstruction.

A log of events is dealt out by conversation and message, sorted by sequence, and folded into final messages: streamed deltas are
appended, edits replace, regenerations start anew, deletions remove. Messages are rendered on their own and then joined,
conversation by conversation, in the order of their first events. Only the join has all of a conversation in one task, as a stream of
rendered turns: its memory is one turn and one part, however long the conversation.

Template: <turn role="ROLE">TEXT</turn> and a line feed for each turn. In roles and texts a backslash is doubled, and the < of
<turn or </turn (in roles, a quote too) gets a backslash before it, so a marker in the output is always one of the template's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import limit_batches

#: Code points after which a conversation's output goes on in a further part.
PART_CHARS = 1 << 20
TRAINED_ROLE = "assistant"

EVENT_TYPES = ("message", "delta", "edit", "regenerate", "delete")
EVENTS = "conv_id bigint, message bigint, seq bigint, type string, role string, text string"
TURNS = "conv_id bigint, position bigint, message bigint, role string, formatted string, loss_start int, loss_end int"
PARTS = "conv_id bigint, part int, last boolean, formatted string, loss array<struct<start:int,end:int>>"

_MARK = re.compile(r"<(?=/?turn)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD, _CLOSE, _TAIL = '<turn role="', '">', "</turn>\n"


def escape(text: str, quote: bool = False) -> str:
    text = _MARK.sub(r"\\<", text.replace("\\", "\\\\"))
    return text.replace('"', '\\"') if quote else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text stands in it."""
    head, body = _HEAD + escape(role, True) + _CLOSE, escape(text)
    return head + body + _TAIL, len(head), len(head) + len(body)


def _find(text: str, mark: str, start: int) -> int:
    """Place of the next mark that no backslash escapes."""
    while True:
        at = text.index(mark, start)
        back = at
        while back > start and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        start = at + 1


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of formatted text: role, text, and where the escaped text starts and ends."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(_HEAD, at):
            raise ValueError(f"no turn at {at}")
        role_end = _find(formatted, _CLOSE, at + len(_HEAD))
        start = role_end + len(_CLOSE)
        end = _find(formatted, _TAIL, start)
        yield unescape(formatted[at + len(_HEAD) : role_end]), unescape(formatted[start:end]), start, end
        at = end + len(_TAIL)


def fold(events: Iterator[tuple[str, str | None, str | None]]) -> tuple[str, str] | None:
    """The final (role, text) of one message's events (type, role, text), in order; None if it ends deleted. Events of no EVENT_TYPES don't count."""
    role, parts, alive = "", [], False
    for kind, said_by, text in events:
        if kind not in EVENT_TYPES:
            continue
        role = said_by if said_by is not None else role
        if kind == "delete":
            parts, alive = [], False
            continue
        alive = True
        if kind != "delta":
            parts = []
        if kind != "regenerate":
            parts.append(text or "")
    return (role, "".join(parts)) if alive else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: int, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about the given code points in the column at weight."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight]) + 64
        if size >= chars:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _known() -> Column:
    return F.coalesce(F.col("type").isin(*EVENT_TYPES), F.lit(False))


def rejected(events: DataFrame) -> DataFrame:
    """(conv_id, type, n): how many events of each conversation format_turns passes over, by their type. None for an empty table."""
    return events.where(~_known()).groupBy("conv_id", "type").agg(F.count("*").alias("n"))


def format_turns(events: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """TURNS: the rendered final messages of EVENTS.

    Null texts are empty and null roles leave a message's role as it was (empty at first). Events of a message are ordered by seq, then type and
    text; a delta without a message begins one; a repeated event counts as often as it occurs. Null conversations, and null messages of one, are one
    each. Events whose type is null or none of EVENT_TYPES don't count: see rejected(). A deleted message gives no row, nor does an empty table. Texts may be
    of any length; other columns of events are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for (conv, message), rows in groupby(_rows(batches), itemgetter(0, 1)):
                first = next(rows)
                final = fold(r[3:6] for r in _chain(first, rows))
                if final:
                    formatted, a, b = render(*final)
                    trained = final[0] == trained_role
                    yield conv, first[2], message, final[0], formatted, a if trained else None, b if trained else None

        yield from _batched(turns(), _TURNS, PART_CHARS, 4)

    limit_batches(events.sparkSession)
    wanted = events.where(_known()).select(*[F.col(c) for c in ("conv_id", "message", "seq", "type", "role", "text")])
    dealt = wanted.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "type", "text")
    return dealt.mapInArrow(run, TURNS)


def _chain(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def join_turns(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """PARTS: the formatted conversations and the ranges of code points under the loss mask.

    Turns are ordered by position, then role, text and message. A conversation of more than part_chars goes on in further parts, cut
    between turns; its parts are neighbours, in order, in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(batches), itemgetter(0)):
                text, loss, size, part = [], [], 0, 0
                for _, _, _, _, formatted, a, b in rows:
                    if size and size + len(formatted) > part_chars:
                        yield conv, part, False, "".join(text), loss
                        text, loss, size, part = [], [], 0, part + 1
                    text.append(formatted)
                    if a is not None:
                        loss.append({"start": size + a, "end": size + b})
                    size += len(formatted)
                yield conv, part, True, "".join(text), loss

        yield from _batched(parts(), _PARTS, part_chars, 3)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "formatted", "message").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from PARTS as join_turns gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(batches), itemgetter(0)):
                turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, _, formatted, spans in rows:
                    for role, text, _, _ in parse(formatted):
                        turns.update(f"{role}\n{text}\n".encode())
                        n_turns += 1
                    for span in spans:
                        masked = unescape(formatted[span["start"] : span["end"]])
                        loss.update(masked.encode())
                        loss_chars += len(masked)
                    chars += len(formatted)
                yield conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batched(digests(), _DIGEST, PART_CHARS, 2)

    return parts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts hold markers of common templates; formatting must not confuse them with its own.
CONTROL_ID = -7
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def log_of(conversations: DataFrame) -> DataFrame:
    """EVENTS that lead to a table of finished turns (conv_id, turn, role, text), in the order of turn, as a session would have logged them.

    Of each turn: a draft, its regeneration, a first delta with a slip, the edit that mends it, a delta with the rest, and a second message that is
    deleted. Repeated rows are messages of their own; null roles and texts are empty, null turns come first.
    """
    turn, text = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 40))), F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    start, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    numbered = conversations.withColumn("_row", F.monotonically_increasing_id())
    steps = (("message", F.lit("a draft"), 0), ("regenerate", None, 0), ("delta", F.concat(start, F.lit(" \\<turn slip")), 0), ("edit", start, 0), ("delta", rest, 0), ("message", F.lit("withdrawn"), 1), ("delete", None, 1))
    events = [F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(other).alias("other"), F.lit(kind).alias("type"), (F.lit(None).cast("string") if said is None else said).alias("text")) for k, (kind, said, other) in enumerate(steps)]
    dealt = numbered.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("_row").alias("row"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.explode(F.array(*events)).alias("e"))
    return dealt.select("conv_id", (2 * F.col("row") + F.col("e.other")).alias("message"), (len(steps) * F.col("turn") + F.col("e.k")).alias("seq"), "e.type", F.when(F.col("e.k").isin(0, 5), F.col("role")).alias("role"), "e.text")


def control_turns(spark: SparkSession) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(CONTROL_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_back(join_turns(format_turns(log_of(turns.unionByName(control_turns(conversations.sparkSession))))))
