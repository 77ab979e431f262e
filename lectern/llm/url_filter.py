"""URL filter: rules first, a character language-model ratio for the rest.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the path
starts with the rule's, and the longest rule wins.

Method: the distinct URLs that rules decide are the accepted and rejected examples. For
each class a variable-order Markov model gives the next character after up to ``ORDER``
characters: counts of every context length, interpolated by Witten and Bell's smoothing
(a context seen with many different successors trusts the shorter one more). A URL's score is
the difference of its log-likelihoods over its length. Two bounds are calibrated on a fifth
of the examples, left out of the counts. The cutoff is the lowest score that at most ``LOST``
of the accepted ones reach, and never below zero. The floor spares URLs unlike any example: a
URL is blocked only if its likelihood under the likelier model, that of the rejected ones, is
no less than all but ``LOST`` of the rejected ones have. Host, path, query and fragment are
scored; rules see host and path.

Characters are folded to ``SYMBOLS`` symbols (letters, one for digits, some marks, one for
the rest), so a model has at most ``SYMBOLS ** (ORDER + 1)`` numbers whatever the corpus, a
few megabytes: it is made on the driver from counts that Spark gathers over all examples,
and broadcast. A frequent host counts once per distinct URL.

A null URL or one without ``://`` has an empty host and path and is allowed, as are all
that no rule decides if the examples lack a class. Repeated rows get the same verdict.
Very long URLs are scored whole. Empty tables give empty results; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.columns import ascii_lower

ORDER = 3
SYMBOLS = 32
#: Symbols: 0 start, 1 digits, 2 to 27 letters, 28 to 30 marks, 31 the rest.
MARKS = {".": 28, "-": 29, "/": 30}
REST = 31
HELD_OUT, FOLDS = 4, 5
LOST = 0.01
STEPS, WIDTH = 256, 1 << 12


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> "Rule":
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(
            path, F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(whole, r"^[\s\S]*?://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def query_and_fragment(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")),
                            r"^[\s\S]*?://[^?#]*([\s\S]*)", 1)


def matched(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: len(r.text)):
        fits = one.fits(host, path)
        rule = F.when(fits, one.text).otherwise(rule)
        verdict = F.when(fits, one.verdict).otherwise(verdict)
    return rule, verdict


def symbols(text: str) -> np.ndarray:
    """ORDER start symbols, then one symbol per code point."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    folded = np.full(128, REST, np.int64)
    folded[48:58] = 1
    folded[65:91] = folded[97:123] = np.arange(2, 28)
    for mark, number in MARKS.items():
        folded[ord(mark)] = number
    own = np.where(codes < 128, folded[np.minimum(codes, 127)], REST)
    return np.concatenate([np.zeros(ORDER, np.int64), own])


def windows(text: str) -> np.ndarray:
    """For each character, its context and itself as one number."""
    codes = symbols(text)
    out = np.zeros(len(codes) - ORDER, np.int64)
    for k in range(ORDER + 1):
        out = out * SYMBOLS + codes[k:len(codes) - ORDER + k]
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _windows(texts: pa.Array) -> pa.Array:
    return pa.array([windows(x.as_py() or "").tolist() for x in texts], pa.list_(pa.int32()))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities, shaped like ``counts`` (contexts, oldest first, then next)."""
    below = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for length in range(ORDER + 1):
        own = counts.sum(axis=tuple(range(ORDER - length))).astype(float)
        total = own.sum(axis=-1, keepdims=True)
        kinds = (own > 0).sum(axis=-1, keepdims=True)
        weight = np.where(total > 0, total / np.maximum(total + kinds, 1), 0.0)
        below = weight * own / np.maximum(total, 1) + (1 - weight) * below
    return np.log(np.broadcast_to(below, counts.shape)).reshape(-1)


@dataclass(frozen=True)
class Model:
    """Per window the log-probability ratio (rejected over accepted) and the rejected one's
    log-probability; the least score (exclusive) and likelihood of a blocked URL."""

    ratios: np.ndarray
    rejected: np.ndarray
    cutoff: float
    floor: float


def _mean(frame: DataFrame, table: np.ndarray):
    """The mean of the table's numbers over a text's windows."""
    shared = frame.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.DoubleType())
    def mean(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            found = windows(x.as_py() or "")
            out.append(float(shared.value[found].mean(dtype=np.float64)) if len(found) else 0.0)
        return pa.array(out, pa.float64())

    return mean


def train(judged: DataFrame) -> Model:
    """Fits on rows with url (the scored text) and verdict (null: undecided)."""
    examples = (
        judged.where(F.col("verdict").isNotNull())
        .select("url", "verdict").distinct()
        .withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))))
    fitted = examples.where(F.col("fold") != HELD_OUT)
    counted = (  # at most two rows per window
        fitted.select("verdict", F.explode(_windows("url")).alias("window"))
        .groupBy("verdict", "window").agg(F.count("*").alias("n")).toPandas())
    tables = {}
    for verdict in ("allow", "block"):
        own = counted[counted["verdict"] == verdict]
        table = np.zeros(SYMBOLS ** (ORDER + 1), np.int64)
        table[own["window"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        tables[verdict] = table.reshape((SYMBOLS,) * (ORDER + 1))
    if not all(table.any() for table in tables.values()):
        none = np.zeros(SYMBOLS ** (ORDER + 1), np.float32)
        return Model(none, none, float("inf"), float("inf"))
    rejected = log_probabilities(tables["block"])
    ratios = (rejected - log_probabilities(tables["allow"])).astype(np.float32)
    rejected = rejected.astype(np.float32)
    value = F.when(F.col("verdict") == "allow", _mean(judged, ratios)("url")).otherwise(
        _mean(judged, rejected)("url"))
    places = (  # in steps, so that few numbers describe any corpus
        examples.where(F.col("fold") == HELD_OUT)
        .select("verdict", F.least(F.greatest(
            F.floor(value * STEPS), F.lit(-WIDTH)), F.lit(WIDTH))
            .alias("step"))
        .groupBy("verdict", "step").agg(F.count("*").alias("n")).collect())

    def bound(verdict: str, order: int) -> int:
        """The step past which, from the top (-1) or the bottom (1), lie at most ``LOST``."""
        own = sorted(((r["step"], r["n"]) for r in places if r["verdict"] == verdict),
                     key=lambda item: order * item[0])
        room = LOST * sum(n for _, n in own)
        for step, n in own:
            room -= n
            if room < 0:
                return step
        return WIDTH  # no examples: nothing is blocked

    return Model(ratios, rejected, max(0.0, (bound("allow", -1) + 1) / STEPS),
                 bound("block", 1) / STEPS)


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"),
                         query_and_fragment(F.col("url")).alias("rest"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    judged = split.select(
        "page_id", "host", "path", F.concat("host", "path", "rest").alias("url"),
        rule.alias("rule"), verdict.alias("verdict"))
    model = train(judged)
    open_ = F.when(F.col("rule").isNull(), F.col("url"))
    scored = judged.withColumns({"score": _mean(pages, model.ratios)(open_),
                                 "likelihood": _mean(pages, model.rejected)(open_)})
    own = F.when((F.col("score") > F.lit(model.cutoff))
                 & (F.col("likelihood") >= F.lit(model.floor)), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
