r"""Chat formatting from an event log.

A log has (conv_id, turn, message, seq, kind, role, text). ``open`` starts a message with a
role, ``delta`` adds text, ``edit`` replaces the text, ``regenerate`` starts the text anew,
``delete`` removes the message. The log is dealt by (conv_id, turn) and sorted by message and
seq, so one pass folds it with one message in memory, and a very long conversation is the
work of many tasks. Every message is rendered by itself; a conversation's output is its
pieces in the order of (turn, message).

Template: ``### role: text</turn>`` and a line feed. Inside texts a backslash goes before
backslashes, before the ``#`` of ``###`` and before ``</turn>``; inside roles also before
colons. No text can therefore look like a mark, and reading back restores each one exactly.
The loss mask of a piece is the span of its text if the role is assistant.

``read_back`` parses the pieces again and digests each conversation. A digest over all
turns is one sequence by nature: a conversation's pieces meet in one task, which streams
them and holds one batch.

Null texts and roles count as empty; null conv_ids are one conversation and null turns
come first. Rows of the same turn are separate messages, ordered by digest; repeated rows
are repeated messages. Events without an ``open`` belong to a message with an empty role.
Very long texts are kept whole, empty tables give empty results, extra columns stay out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import present

END = "</turn>\n"
ESCAPED = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ESCAPED_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
PIECE = re.compile(
    r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
ASSISTANT = "assistant"
PLACE = "conv_id long, turn long, message string"
PIECES = f"{PLACE}, role string, formatted string, loss_start long, loss_end long"


def escape(text: str, pattern: re.Pattern = ESCAPED) -> str:
    return pattern.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of one message and its loss mask."""
    head, body = f"### {escape(role, ESCAPED_ROLE)}: ", escape(text)
    masked = role == ASSISTANT
    return (head + body + END, len(head) if masked else 0,
            len(head) + len(body) if masked else 0)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every message in formatted text."""
    place = 0
    while place < len(formatted):
        found = PIECE.match(formatted, place)
        if not found:
            raise ValueError(f"no message at {place}")
        yield unescape(found[1]), unescape(found[2])
        place = found.end()


def event_log(conversations: DataFrame) -> DataFrame:
    """Each row of a conversations table as an ``open`` and a ``delta`` event."""
    role, text = present(F.col("role")), present(F.col("text"))
    message = F.concat(F.md5(F.encode(F.concat(role, F.lit("\n"), text), "UTF-8")), F.lit("-"),
                       F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), message.alias("message"),
        role.alias("role"), text.alias("text")).select(
            "conv_id", "turn", "message", F.inline(F.array(
                F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"),
                         F.col("role").alias("role"), F.lit("").alias("text")),
                F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"),
                         F.lit("").alias("role"), F.col("text").alias("text")))))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, role, parts, alive, rows = None, "", [], True, []

    def flush() -> None:
        if key is not None and alive:
            rows.append((*key, role, *render(role, "".join(parts))))

    for batch in batches:
        for *place, kind, name, text in zip(*(batch.column(x).to_pylist() for x in (
                "conv_id", "turn", "message", "kind", "role", "text"))):
            if tuple(place) != key:
                flush()
                key, role, parts, alive = tuple(place), "", [], True
            if kind == "open":
                role, parts, alive = name or "", [], True
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
            elif kind == "delete":
                alive = False
            else:
                raise ValueError(f"unknown event {kind}")
        yield _batch(rows)
        rows.clear()
    flush()
    yield _batch(rows)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("message", pa.string()),
                    ("role", pa.string()), ("formatted", pa.string()),
                    ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def formatted(log: DataFrame) -> DataFrame:
    """One row per final message: its place, role, piece and loss mask."""
    return (log.select("conv_id", "turn", "message", "seq", "kind", "role", "text")
            .repartition("conv_id", "turn")
            .sortWithinPartitions("conv_id", "turn", "message", "seq")
            .mapInArrow(_fold, PIECES))


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                     ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, rows = None, None, []

    def flush() -> None:
        if state:
            rows.append((conv, state[0], state[1].hexdigest(), state[2],
                         state[3].hexdigest(), state[4]))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(DIGESTS)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, DIGESTS)], schema=DIGESTS)

    for batch in batches:
        for one, piece, start, end in zip(*(batch.column(x).to_pylist() for x in (
                "conv_id", "formatted", "loss_start", "loss_end"))):
            if state is None or one != conv:
                flush()
                conv, state = one, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            masked = unescape(piece[start:end])
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += len(piece)
        yield batch_of()
        rows.clear()
    flush()
    yield batch_of()


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from its pieces: counts and digests."""
    return (pieces.select("conv_id", "turn", "message", "formatted", "loss_start", "loss_end")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, "
                                 "loss_chars long, loss_sha256 string, formatted_chars long"))
