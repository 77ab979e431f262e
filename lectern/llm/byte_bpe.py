"""Byte-level BPE through a sentencepiece model made straight from a rank file.

The model is the vocabulary itself: byte b is written as the character U+0100 + b, a
token's piece is its bytes so written, its id is its rank and its score minus the rank, so
that sentencepiece merges in the order of ranks. Its normalisation is the identity. Texts
are cut by the tokenizer's pattern, every match is encoded by itself, and decoding maps
ids back to bytes. Nothing is trained.

A null text counts as empty and has no tokens. Whole texts are encoded, long ones in the
same way; repeated rows get the same ids; an empty table gives an empty result. Batches come
in some hundred rows and leave by bytes of text (``columns``), and each task remembers at most
``REMEMBERED`` matches. Digests are taken in the task, so that no ids leave it. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import small_batches, sliced

FIRST = 0x100
REMEMBERED = 200_000
#: Fixed values of the sentencepiece model format.
BPE, NORMAL, UNKNOWN = 2, 1, 2


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks are not 0 to n - 1")
    return [found[rank] for rank in range(len(found))]


def as_characters(data: bytes) -> str:
    wide = np.empty((len(data), 2), np.uint8)
    wide[:, 0], wide[:, 1] = np.frombuffer(data, np.uint8), FIRST >> 8
    return wide.tobytes().decode("utf-16-le")


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + bytes([value]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; the id of a token is its rank."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5)
                      + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece(as_characters(token), -rank, NORMAL) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = _number(3, BPE) + _number(4, len(pieces)) + _number(40, len(tokens))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, identity)


def matcher(pattern: str):
    """The compiled pattern; white space is Unicode's, without the separators U+1C to U+1F."""
    import regex

    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(
        r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Tokenizer:
    """Encodes one text at a time; lives inside a task."""

    def __init__(self, tokens: list[bytes], proto: bytes, pattern: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_proto=proto)
        self.find = matcher(pattern).findall
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> None:
        data = [match.encode() for match in matches]
        whole, ends = as_characters(b"".join(data)), [0, *accumulate(map(len, data))]
        split = self.pieces.encode(
            [whole[a:b] for a, b in zip(ends, ends[1:])], num_threads=1)
        known, rank_of = self.known, self.ranks.get
        for match, raw, ids in zip(matches, data, split):
            rank = rank_of(raw)  # a match that is a token stays whole
            known[match] = array("i", ids if rank is None else (rank,)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        matches = self.find(text)
        missing = list(set(matches).difference(self.known))
        if missing and len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list(set(matches))
        if missing:
            self._learn(missing)
        return b"".join(map(self.known.__getitem__, matches))


def decoded_bytes(tokens: list[bytes], ids: list[int]) -> bytes:
    """The inverse mapping."""
    return b"".join(map(tokens.__getitem__, ids))


def _mapped(docs: DataFrame, path: str, pattern: str, columns: dict, row) -> DataFrame:
    """``row(tokenizer, tokens, text)`` gives the columns of every text.

    The vocabulary, a fixed file of some hundred kilobytes, is broadcast.
    """
    tokens = read_ranks(path)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, model(tokens)))
    kinds = [kind for _, kind in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, proto = shared.value
        tokenizer = Tokenizer(vocabulary, proto, pattern)
        for batch in sliced(batches):
            rows = [row(tokenizer, vocabulary, x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(values), type=kind)
                                           for values, kind in zip(zip(*rows), kinds))],
                ["doc_id", *columns])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    shape = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_kind}, {shape}")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the ids of the text and the bytes that they decode to."""

    def row(tokenizer: Tokenizer, tokens: list[bytes], text: str) -> tuple:
        ids = np.frombuffer(tokenizer.encode(text), "<i4")
        return ids, decoded_bytes(tokens, ids.tolist())

    return _mapped(docs, path, pattern, {
        "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary())}, row)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""

    def row(tokenizer: Tokenizer, tokens: list[bytes], text: str) -> tuple:
        ids = np.frombuffer(tokenizer.encode(text), "<i4").tolist()
        return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(decoded_bytes(tokens, ids)).hexdigest())

    return _mapped(docs, path, pattern, {
        "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string())}, row)
