"""Alignment of two tokenizers: byte-level BPE (A) and sentencepiece BPE (B).

Both encode a blank and the text. Where a token of A and one of B end at the same byte the
tokens are cut into groups, and these two tokens are linked.

Ends of tokens: the character offsets of A and the spans of B's proto (which the installed
sentencepiece calls ``proto``) are coarse cuts. They are kept where a token ends with a whole
character and the next one begins there; tokens that share a character, and the pieces of
one that falls back to bytes, are cut by their decoded bytes. If all decoded bytes are not
those of blank and text, the text has no tokens.

A text is cut before blanks that follow anything but white space and precede a word. Such a
cut is one in both tokenizers: A's pattern starts a token there and no piece of B has a
blank after other characters (checked as the model is read; else texts stay whole). A task
remembers the aligned words between cuts, up to ``REMEMBERED``; those of a batch that it does
not know are aligned ``TOGETHER``, as one text, and words longer than ``SHORT`` with their text.

Pairs of ids: of two tokens that end together one is a suffix of the other, so there are at
most as many pairs as the lengths of all tokens add up to, whatever the corpus (607,000 for
these vocabularies). Their counts are therefore broadcast. Texts are encoded once: digests and
each document's pairs are written to the shared folder, counted, and read again.

Null and empty texts have no tokens; repeated rows count each time; very long texts are
encoded whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import sliced, small_batches
from lectern.session import new_folder

SHORT, REMEMBERED = 64, 300_000
#: Words that are aligned together.
TOGETHER = 2_000
#: White space at the end, or before a blank: what a cut must not follow.
_OPEN = re.compile(r"\s(?= )|\s\Z|\A ")
BLANK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
STORED = """n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>,
    times array<int>"""


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level BPE: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class Word:
    """The alignment of one stretch of text."""

    __slots__ = ("n_a", "n_b", "groups", "pairs", "whole")

    def __init__(self, n_a: int, n_b: int, groups: bytes, pairs: bytes, whole: bool) -> None:
        self.n_a, self.n_b, self.groups, self.pairs, self.whole = n_a, n_b, groups, pairs, whole


def refined(starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Token ends in bytes from coarse spans and the lengths of the tokens' own bytes.

    A span counts if it is not empty and the next token begins where it ends or later; the
    tokens after it, up to the next such span, follow it by their own bytes.
    """
    following = np.append(starts[1:], ends[-1:])
    anchor = (ends > starts) & (following >= ends)
    last = np.maximum.accumulate(np.where(anchor, np.arange(len(ends)), -1))
    by_bytes = np.cumsum(lengths)
    return np.where(last < 0, by_bytes, ends[last] + by_bytes - by_bytes[last])


def byte_places(text: str) -> np.ndarray:
    """Where each character of a text begins in its bytes, and where the last one ends."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(widths)])


def _texts(size: int, inner: str, last: str) -> np.ndarray:
    """Ids as text, followed by ``inner``; then, from ``size`` on, by ``last``."""
    table = np.empty(2 * size, object)
    table[:] = [f"{k}{mark}".encode() for mark in (inner, last) for k in range(size)]
    return table


class Aligner:
    """Aligns texts; lives inside a task."""

    def __init__(self, byte_bpe: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        letters = byte_characters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.a_bytes[number] = bytes(letters[c] for c in token)
        self.b_bytes, self.cuts = [], True
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            raw = _BYTE.match(piece) if self.b.is_byte(number) else None
            self.b_bytes.append(bytes([int(raw[1], 16)]) if raw
                                else piece.replace(BLANK, " ").encode())
            self.cuts &= not re.search(rf"[^{BLANK}]{BLANK}", piece)
        self.a_lengths, self.b_lengths = (np.array([*map(len, tokens)], np.int64)
                                          for tokens in (self.a_bytes, self.b_bytes))
        self.a_texts = _texts(len(self.a_bytes), ",", "|")
        self.b_texts = _texts(len(self.b_bytes), ",", ";")
        self.known: dict[str, Word] = {}

    def bound(self) -> int:
        """No corpus has more linked pairs of ids."""
        return int(self.a_lengths.sum() + self.b_lengths.sum())

    def _align(self, words: list[str]) -> list[Word]:
        """Both encodings of the words with a blank before each, cut into words again."""
        text = " ".join(words)
        whole = b" " + text.encode()
        encoding = self.a.encode(f" {text}", add_special_tokens=False)
        pieces = self.b.encode(text, return_type="proto").pieces
        a = np.array(encoding.ids, np.int64)
        b = np.array([piece.id for piece in pieces], np.int64)
        if (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole
                or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole):
            if len(words) == 1:
                return [Word(0, 0, b"", b"", False)]
            return [found for word in words for found in self._align([word])]
        places = byte_places(f" {text}")
        spans = places[np.array(encoding.offsets, np.int64)]
        a_ends = refined(spans[:, 0], spans[:, 1], self.a_lengths[a])
        # Spans follow each other, the first one after the blank that B adds.
        spans = np.array([0, *(piece.end for piece in pieces)], np.int64) + 1
        b_ends = refined(spans[:-1], spans[1:], self.b_lengths[b])

        cuts = np.zeros(len(whole) + 1, np.int8)
        cuts[a_ends] += 1
        cuts[b_ends] += 1
        a_cut, b_cut = cuts[a_ends] == 2, cuts[b_ends] == 2
        ends = a_ends[a_cut]
        pairs = a[a_cut] * len(self.b_bytes) + b[b_cut]
        # A token stands behind the earlier ones of its side and the other side's of earlier
        # groups, those of A before those of B.
        out = np.empty(len(a) + len(b), object)
        a_before = np.concatenate([[0], np.flatnonzero(a_cut) + 1])
        b_before = np.concatenate([[0], np.flatnonzero(b_cut) + 1])
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        out[np.arange(len(a)) + b_before[a_group]] = self.a_texts[a + a_cut * len(self.a_bytes)]
        out[np.arange(len(b)) + a_before[b_group + 1]] = self.b_texts[b + b_cut * len(self.b_bytes)]
        sizes = np.fromiter((len(word.encode()) + 1 for word in words), np.int64, len(words))
        last = np.cumsum(sizes)
        n_a, n_b, n_groups = ([0, *np.searchsorted(x, last, "right").tolist()]
                              for x in (a_ends, b_ends, ends))
        texts = out.tolist()
        return [Word(n_a[k + 1] - n_a[k], n_b[k + 1] - n_b[k],
                     b"".join(texts[n_a[k] + n_b[k]:n_a[k + 1] + n_b[k + 1]])[:-1],
                     pairs[n_groups[k]:n_groups[k + 1]].tobytes(), True)
                for k in range(len(words))]

    def _learn(self, words: list[str]) -> dict[str, Word]:
        """Alignments of words, remembered if they are short."""
        found = dict(zip(words, self._align(words)))
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        self.known.update((w, x) for w, x in found.items()
                          if len(w) <= SHORT and not w[-1].isspace())
        return found

    def prepare(self, texts: list[str]) -> None:
        """Learn the words of several texts that are not known yet."""
        known, missing = self.known, {}
        for text in texts if self.cuts else ():
            for word in set(text.split(" ")):
                if word not in known and word and not word[-1].isspace() and len(word) <= SHORT:
                    missing[word] = None
        words = list(missing)
        for k in range(0, len(words), TOGETHER):
            self._learn(words[k:k + TOGETHER])

    def _stretches(self, text: str) -> list[str]:
        """What stands between cuts, without the blank at the cut."""
        parts = text.split(" ")
        if not _OPEN.search(text):
            return parts
        out: list[str] = []
        held: list[str] = []
        for part in parts:
            held.append(part)
            if part and not part[-1].isspace():
                out.append(" ".join(held))
                held = []
        if held:
            tail = " ".join(held)
            out[-1:] = [f"{out[-1]} {tail}"] if out else [tail]
        return out

    def words(self, text: str) -> list[Word] | None:
        """The aligned stretches of a text; None if it has no tokens."""
        if not text:
            return None
        if not self.cuts:
            found = [self._learn([text])[text]]
        else:
            get = self.known.get
            found = list(map(get, text.split(" ")))
            if None in found:
                stretches = self._stretches(text)
                found = list(map(get, stretches))
                missing = dict.fromkeys(w for w, x in zip(stretches, found) if x is None)
                if missing:
                    # One with white space at its end, the text's last, must not meet others.
                    learned = {}
                    tail = [w for w in missing if w[-1].isspace()]
                    for words in ([w for w in missing if not w[-1].isspace()], tail):
                        if words:
                            learned |= self._learn(words)
                    found = [x or learned[w] for w, x in zip(stretches, found)]
        return found if all(word.whole for word in found) else None


def _shared(docs: DataFrame, byte_bpe: str, pieces: str):
    """The two vocabularies, fixed files of some megabytes."""
    small_batches(docs.sparkSession)
    with open(byte_bpe, encoding="utf-8") as first, open(pieces, "rb") as second:
        return docs.sparkSession.sparkContext.broadcast((first.read(), second.read()))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def aligned(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """doc_id and its groups: bytes from ``start`` to ``end`` of blank and text, ids of A and B."""
    shared = _shared(docs, byte_bpe, pieces)
    item = "start: bigint, end: bigint, a: array<int>, b: array<int>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                               ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def groups_of(aligner: Aligner, words: list[Word]) -> Iterator[dict]:
        end = 0
        for word in words:
            for ids in word.groups.decode().split(";"):
                a, b = ([int(k) for k in side.split(",")] for side in ids.split("|"))
                start, end = end, end + sum(len(aligner.a_bytes[k]) for k in a)
                yield {"start": start, "end": end, "a": a, "b": b}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in sliced(batches):
            found = [list(groups_of(aligner, aligner.words(x.as_py() or "") or []))
                     for x in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found, kind)], ["doc_id", "groups"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return _input(docs).mapInArrow(run, f"doc_id {id_kind}, groups array<struct<{item}>>")


def digested(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """doc_id, numbers of tokens and groups, the groups' digest, linked pairs and how often."""
    shared = _shared(docs, byte_bpe, pieces)

    def row(words: list[Word] | None) -> tuple:
        if words is None:
            return 0, 0, 0, "", [], []
        pairs = np.frombuffer(b"".join([w.pairs for w in words]), "<i8")
        distinct, times = np.unique(pairs, return_counts=True)
        text = b";".join([w.groups for w in words])
        return (sum([w.n_a for w in words]), sum([w.n_b for w in words]), len(pairs),
                hashlib.sha256(text).hexdigest(), distinct, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()),
                 pa.list_(pa.int32())]
        names = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
        for batch in sliced(batches):
            texts = [x.as_py() or "" for x in batch["text"]]
            aligner.prepare(texts)
            rows = [row(aligner.words(text)) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(list(column), type=kind)
                                    for column, kind in zip(zip(*rows), kinds))],
                ["doc_id", *names])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return _input(docs).mapInArrow(run, f"doc_id {id_kind}, {STORED}")


def pair_counts(rows: DataFrame, n_pieces: int) -> DataFrame:
    """pair, n (its links in the whole corpus) and best (no pair with its B id has more)."""
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(
        F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    by_piece = F.pmod("pair", F.lit(n_pieces).cast("long"))
    most = counts.groupBy(by_piece.alias("piece")).agg(F.max("n").alias("most"))
    return counts.withColumn("piece", by_piece).join(most, "piece").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """One row per document: tokens, groups, links, and how common its links are."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    path = new_folder(spark, "tokenizer_spans")
    digested(docs, byte_bpe, pieces).write.parquet(path)
    rows = spark.read.parquet(path)
    n_pieces = SentencePieceProcessor(model_file=pieces).get_piece_size()
    table = pair_counts(rows, n_pieces).toPandas().sort_values("pair")  # bounded by vocabularies
    shared = spark.sparkContext.broadcast(
        (table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64),
         table["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            n_best, count_sum = [], []
            for pairs, times in zip(batch["pairs"], batch["times"]):
                at = np.searchsorted(known, pairs.values.to_numpy())
                often = times.values.to_numpy().astype(np.int64)
                n_best.append(int(often[best[at]].sum()) if len(at) else 0)
                count_sum.append(int((often * counts[at]).sum()) if len(at) else 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in ("doc_id", "n_a", "n_b", "n_groups")),
                 batch["n_groups"], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                 batch["groups_sha256"]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                 "groups_sha256"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"""doc_id {id_kind}, n_a long, n_b long, n_groups long,
        n_links long, n_best long, count_sum long, groups_sha256 string""")
