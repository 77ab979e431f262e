"""Language identification by rank-order n-gram profiles and out-of-place distance.

Words are runs of letters in lower case, padded with a blank on each side; n-grams have 1 to
3 characters of a padded word, the lone blank left out. A language's profile is its
``PROFILE`` most frequent n-grams over all texts to learn from (ties by code points); an
n-gram's rank is its place. A document's rank of an n-gram is the number of its n-grams that
are more frequent, and its profile holds the n-grams of a rank below ``PROFILE``.

The distance to a language adds up how far each n-gram of the document's profile is out of
place, ``PROFILE`` where the language's profile lacks it or if that is less. The language at
the least distance is predicted, of equal ones the first by name. The score is the lead over
the second, ``1 - least / second``; with one language, ``1 - least / most possible``.

An n-gram is one number of three code points of 21 bits, so its order is that of the texts.
Each position of the padded words gives one number of three; sorted, their common beginnings
give the counts of the shorter ones.

A null text and one without letters are ``und`` with score 0, and so is every text if nothing
could be learned. A null doc_id counts as an empty text in the choice of rows; repeated rows
count each time; very long texts are read whole, ``PIECE`` letters at a time. A task combines
its counts before the shuffle, and only the ``PROFILE`` first of a language leave it for the
ranking. The profiles, at most ``LANGUAGES`` times ``PROFILE`` rows, are broadcast; more
languages are an error. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.columns import small_batches

PROFILE = 400
LONGEST = 3
LANGUAGES = 2_000
UNKNOWN = "und"
#: Characters that are counted at once.
PIECE = 1 << 21
FOLDS, HELD_OUT = 5, 0
_BITS, _BLANK = 21, 32
Counts = tuple[np.ndarray, np.ndarray]


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % FOLDS == HELD_OUT


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def padded(text: str) -> np.ndarray:
    """The code points of the words of a text, with one blank after each; empty without any."""
    # Code points without a character of their own cannot come out of a table.
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    inside = np.concatenate([_letters()[points], [False]])
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    return np.where(inside, np.append(points, _BLANK), _BLANK)[keep].astype(np.int64)


def _merged(parts: list[Counts]) -> Counts:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _prefixes(codes: np.ndarray, counts: np.ndarray, drop: int) -> Counts:
    """Counts of the n-grams without their last ``drop`` characters; codes are sorted."""
    short = codes >> drop * _BITS << drop * _BITS
    starts = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
    return short[starts], np.add.reduceat(counts, starts)


def grams(words: np.ndarray) -> Counts:
    """Sorted numbers of the n-grams in padded words, and how often they occur."""
    line = np.concatenate([[_BLANK], words, [_BLANK]])
    parts = []
    for k in range(0, len(words), PIECE):
        part = line[k:k + PIECE + 2]
        triples = part[:-2] << 2 * _BITS | part[1:-1] << _BITS | part[2:]
        parts.append(np.unique(triples, return_counts=True))
    triples = parts[0] if len(parts) == 1 else _merged(parts)
    pairs, singles = _prefixes(*triples, 1), _prefixes(*triples, 2)
    middle = triples[0] >> _BITS & (1 << _BITS) - 1
    kept = [(triples, middle != _BLANK), (pairs, pairs[0] >> _BITS != (_BLANK << _BITS | _BLANK)),
            (singles, singles[0] >> 2 * _BITS != _BLANK)]
    codes = np.concatenate([x[0][keep] for x, keep in kept])
    counts = np.concatenate([x[1][keep] for x, keep in kept])
    order = np.argsort(codes)
    return codes[order], counts[order]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows; each task combines what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                codes, counts = grams(np.concatenate(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)],
                    ["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                words = padded(text.as_py())
                if len(words):
                    held.setdefault(lang.as_py(), []).append(words)
                    size += len(words)
                if size > PIECE:
                    yield from flush()
                    size = 0
        yield from flush()

    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) of the ``size`` most frequent n-grams of every language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted(docs).withColumn("place", F.row_number().over(order) - 1).where(
        F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """Distances of texts to languages; lives inside a task.

    ``starts`` bounds the places of the sorted n-grams ``known`` in ``langs`` and
    ``places``, one entry per language that ranks the n-gram.
    """

    def __init__(self, names: list[str], known: np.ndarray, starts: np.ndarray,
                 langs: np.ndarray, places: np.ndarray, size: int) -> None:
        self.names, self.known, self.size = names, known, size
        self.starts, self.langs, self.places = starts, langs, places

    def ranks(self, text: str) -> Counts | None:
        """The n-grams in the text's profile and their ranks; None without letters."""
        words = padded(text)
        if not len(words):
            return None
        codes, counts = grams(words)
        rank = len(counts) - np.searchsorted(np.sort(counts), counts, "right")
        near = rank < self.size
        return codes[near], rank[near]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.ranks(text or "")
        if found is None or not self.names:
            return UNKNOWN, 0.0
        codes, rank = found
        most = self.size * len(codes)
        ids = np.searchsorted(self.known, codes)
        inside = np.append(self.known, -1)[ids] == codes
        ids, rank = ids[inside], rank[inside]
        widths = self.starts[ids + 1] - self.starts[ids]
        entries = np.repeat(self.starts[ids] - np.cumsum(widths) + widths, widths) + np.arange(
            widths.sum())
        nearer = self.size - np.minimum(
            np.abs(self.places[entries] - np.repeat(rank, widths)), self.size)
        distances = most - np.bincount(
            self.langs[entries], nearer, len(self.names)).astype(np.int64)
        best = int(distances.argmin())
        least = int(distances[best])
        second = int(np.delete(distances, best).min()) if len(distances) > 1 else most
        return self.names[best], 1.0 - least / second if second else 0.0


def _table(spark, rows: DataFrame, size: int):
    found = rows.toPandas()  # at most LANGUAGES x size rows
    names = sorted(found["lang"].unique(), key=lambda name: name.encode())
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages; more than {LANGUAGES} are no column of languages")
    number = {name: k for k, name in enumerate(names)}
    found = found.sort_values("gram", kind="stable")
    known, counts = np.unique(found["gram"].to_numpy(np.int64), return_counts=True)
    return spark.sparkContext.broadcast((
        names, known, np.concatenate([[0], np.cumsum(counts)]),
        found["lang"].map(number).to_numpy(np.int64), found["place"].to_numpy(np.int64), size))


def predicted(docs: DataFrame, rows: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of every document by the profiles ``rows``."""
    small_batches(docs.sparkSession)
    shared = _table(docs.sparkSession, rows, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(*shared.value)
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([name for name, _ in found], pa.string()),
                 pa.array([score for _, score in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def language_report(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    learned = profiles(docs.where(~held_out(F.col("doc_id"))), size)
    return predicted(docs, learned, size).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
