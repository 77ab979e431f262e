"""Quality scores from a naive Bayes support vector machine.

Features are indicators: a text has an n-gram or not. Words are lower-cased; beside word
uni- and bigrams there are uni-, bi- and trigrams of token shapes (case, digits, the marks
themselves, a word equal to the one before), which carry over to unseen words, and the
share of repeated word trigrams in tenths. N-grams are hashed to ``SIZE`` numbers.

Fitting: indicators are scaled by the log ratio of their smoothed class counts and by
the root of their number in the text. A linear model with hinge loss is fitted to these by dual
coordinate descent, and its weights are drawn towards their mean size (naive Bayes).
Margins of a fifth of the rows, left out of the fit, calibrate the scores (Platt).

The model is fitted on at most ``FIT_ROWS`` labelled rows, the one with the least hash of
doc_id in each of so many parts, so it neither grows with the corpus nor depends on its order; it has ``SIZE`` weights and
is broadcast. Scoring reads every whole text once and shuffles nothing.

Null and empty texts have no n-gram and get the score of the intercept. Rows without a
label or doc_id teach nothing; of rows that repeat a doc_id one is learnt from,
of labels that do the lower. Without labels every
score is 0.5, with labels of one class it is their smoothed share. Extra columns stay out.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 1 << 18
FIT_ROWS = 10_000
COST, NAIVE, PASSES, SMOOTH = 1.0, 0.25, 12, 1.0
REMEMBERED = 300_000
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed n-grams of texts; remembers the hashes of words within a task."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _token(self, token: str) -> tuple[int, int]:
        first = token[0]
        if not first.isalnum():
            shape = 16 + zlib.crc32(token[:8].encode()) % 4096
        elif token.isdigit():
            shape = 1
        elif len(token) > 1 and token.isupper():
            shape = 2
        elif first.isupper():
            shape = 3
        else:
            shape = 4
        found = zlib.crc32(token.lower().encode()), shape
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The sorted numbers of the n-grams that the text has."""
        known, make = self.known, self._token
        pairs = [known.get(t) or make(t) for t in TOKEN.findall(text or "")]
        if not pairs:
            return np.empty(0, np.int64)
        both = np.array(pairs, np.uint64)
        words, shapes = both[:, 0], both[:, 1].copy()
        shapes[1:][words[1:] == words[:-1]] = 5
        parts = []

        def grams(codes: np.ndarray, length: int, kind: int) -> np.ndarray:
            if len(codes) < length:
                return codes[:0]
            mixed = np.full(len(codes) - length + 1, kind, np.uint64)
            for k in range(length):
                mixed = (mixed ^ codes[k:len(codes) - length + 1 + k]) * SPREAD
                mixed ^= mixed >> np.uint64(29)
            return mixed

        parts += [grams(words, n, n) for n in (1, 2)]
        parts += [grams(shapes, n, 10 + n) for n in (1, 2, 3)]
        triples = grams(words, 3, 3)
        if len(triples):
            share = 10 * (len(triples) - len(np.unique(triples))) // len(triples)
            parts.append(grams(np.array([share], np.uint64), 1, 20))
        return np.unique(np.concatenate(parts) % np.uint64(SIZE)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weights per n-gram, intercept, and slope and offset of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, numbers: np.ndarray) -> float:
        if not len(numbers):
            return self.intercept
        return float(self.weights[numbers].sum(dtype=np.float64) / len(numbers) ** 0.5
                     + self.intercept)

    def score(self, numbers: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(
            self.slope * self.margin(numbers) + self.offset, -60, 60))))


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = []
    for label in (True, False):
        chosen = [x for x, y in zip(rows, good) if y == label]
        total = np.bincount(np.concatenate([*chosen, np.empty(0, np.int64)]), minlength=SIZE)
        counts.append((total + SMOOTH) / (total.sum() + SMOOTH * SIZE))
    ratios = np.log(counts[0] / counts[1])
    seen = np.zeros(SIZE, bool)
    for x in rows:
        seen[x] = True
    return np.where(seen, ratios, 0.0)


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray,
            cost: float = COST, passes: int = PASSES) -> np.ndarray:
    """Weights (the last one the intercept's) that minimise |w|^2 / 2 + cost * hinge losses."""
    weights, alphas = np.zeros(SIZE + 1), np.zeros(len(rows))
    norms = [float(v @ v) + 1 for v in values]
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            x, v, y = rows[i], values[i], signs[i]
            slope = y * (weights[x] @ v + weights[-1]) - 1
            new = min(max(alphas[i] - slope / norms[i], 0.0), cost)
            if new != alphas[i]:
                step = (new - alphas[i]) * y
                weights[x] += step * v
                weights[-1] += step
                alphas[i] = new
    return weights


def calibrate(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through smoothed targets, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()],
                      [(s * margins).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1.0, 2.0 / size) if size else 1.0
        a, b = max(a - step[0], 1e-3), b - step[1]
        if size < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """``rows`` are the numbers of n-grams, ``good`` the labels."""
    if not len(rows):
        return Model(np.zeros(SIZE, np.float32), 0.0, 1.0, 0.0)
    if good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(SIZE, np.float32), float(np.log(share / (1 - share))), 1.0, 0.0)
    aside = np.arange(len(rows)) % 5 == 4
    if not (good[aside].any() and (~good[aside]).any()
            and good[~aside].any() and (~good[~aside]).any()):
        aside[:] = False  # too few rows to leave any out
    chosen = [x for x, out in zip(rows, aside) if not out]
    ratios = log_ratios(chosen, good[~aside])
    values = [ratios[x] / max(len(x), 1) ** 0.5 for x in chosen]
    weights = descend(chosen, values, np.where(good[~aside], 1.0, -1.0))
    drawn = weights[:-1]
    seen = ratios != 0
    mean = np.abs(drawn[seen]).mean() if seen.any() else 0.0
    drawn = (1 - NAIVE) * drawn + NAIVE * mean
    model = Model((drawn * ratios).astype(np.float32), float(weights[-1]), 1.0, 0.0)
    judged = aside if aside.any() else ~aside
    margins = np.array([model.margin(x) for x, out in zip(rows, judged) if out])
    return Model(model.weights, model.intercept, *calibrate(margins, good[judged]))


def held_out(doc_id: Column) -> Column:
    """The third of the rows that labels are never learnt from."""
    remainder = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


@F.arrow_udf(T.BinaryType())
def _numbers(texts: pa.Array) -> pa.Array:
    features = Features()
    return pa.array([features.of(x.as_py()).astype("<i4").tobytes() for x in texts], pa.binary())


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on the labelled documents with the least hash of each of ``rows`` parts."""
    known = (
        labels.select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
               & ~held_out(F.col("doc_id"))))
    least = known.groupBy(F.pmod("h", F.lit(rows)).alias("part")).agg(
        F.min("h").alias("h")).select("h")  # at most ``rows`` numbers
    chosen = known.join(F.broadcast(least), "h").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(  # bounded
        "doc_id", "quality", _numbers("text").alias("numbers")).groupBy(
            "doc_id", "quality").agg(F.min("numbers").alias("numbers"))  # repeated doc_ids
    sample = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), *r))
    return fit([np.frombuffer(r[2], "<i4").astype(np.int64) for r in sample],
               np.array([r[1] == 1 for r in sample], bool))


def scorer(docs: DataFrame, model: Model):
    """A column function from texts to scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        features = Features()
        return pa.array([shared.value.score(features.of(x.as_py())) for x in texts], pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(docs, train(docs, labels))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       score("text").alias("score")).withColumn(
                           "predicted", (F.col("score") >= 0.5).cast("int"))
