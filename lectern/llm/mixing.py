"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic), and the cells are raked: scaled to
the targets of one side after another until all three agree. A document's probability is
its cell's factor over the largest one, so the expected tokens of the sample have the
targets' shares and no document is taken twice. Sampling is by hash of doc_id and seed:
the same documents are drawn wherever they are stored.

Targets name the values of each side; all others, null included, are pooled as ``OTHER``.
A value's target is a share of all tokens, or None: the values without a given share divide
what is left by the tokens they have, raised to the side's ``temper`` (below 1 it brings
them closer together, 1 keeps their proportions). ``OTHER`` is such a value unless it is
named. Named values without documents leave their share to the rest.

The sides in ``every`` name each value that the table has, found by a count of its rows: the
``MOST_VALUES`` most frequent ones, so that only values with less than that part of the rows
are pooled. So there are at most (sources + 1) x (languages + 1) x (topics + 1) cells, a number
set by the parameters alone; they are raked on the driver, and their probabilities are
broadcast to the documents.

A topic is the first one of which the lower-cased text contains a mark. Null texts have no
tokens and no topic. Documents without tokens belong to a cell like others; a
cell without any tokens is kept whole. Equal doc_ids are drawn together. Very long texts are
counted whole. Empty tables give empty results; extra columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import ascii_lower, let, packed, present, words_of

OTHER = "other"
SIDES = ("source", "lang", "topic")
ROUNDS = 200
CLOSE = 1e-9
PARTS = 1 << 30
MOST_VALUES = 10_000

Cell = tuple[str, str, str]


@dataclass(frozen=True)
class Targets:
    """Shares of tokens per named value or None, and the marks of each topic in order."""

    source: Mapping[str, float | None] = field(default_factory=dict)
    lang: Mapping[str, float | None] = field(default_factory=dict)
    topic: Mapping[str, float | None] = field(default_factory=dict)
    temper: Mapping[str, float] = field(default_factory=dict)
    marks: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    every: tuple[str, ...] = ()
    seed: int = 1


def named(docs: DataFrame, targets: Targets) -> Targets:
    """The targets with the values of the sides in ``every``, from the table itself."""
    sides = {}
    for side in targets.every:
        counts = docs.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("v")).count()
        most = counts.orderBy(F.desc("count"), "v").limit(MOST_VALUES).collect()
        sides[side] = dict.fromkeys((row["v"] for row in most)) | dict(getattr(targets, side))
    return replace(targets, every=(), **sides)


def celled(rows: DataFrame, targets: Targets, source: Column, lang: Column,
           text: Column) -> DataFrame:
    """Adds tokens, source, lang and topic; the text is read once."""
    def pooled(value: Column, named: Mapping[str, float]) -> Column:
        return F.when(value.isin(*named), value).otherwise(OTHER) if named else F.lit(OTHER)

    def topic(lower: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, marks in reversed(targets.marks.items()):
            hit = F.lit(False)
            for mark in marks:
                hit = hit | F.contains(lower, F.lit(mark))
            found = F.when(hit, name).otherwise(found)
        return F.coalesce(found, F.lit(OTHER))

    return rows.withColumns({
        "tokens": F.size(words_of(present(text))).cast("long"),
        "cell_source": pooled(source, targets.source), "cell_lang": pooled(lang, targets.lang),
        "cell_topic": pooled(let(ascii_lower(present(text)), topic), targets.topic)})


def _shares(tokens: Mapping[str, float], named: Mapping[str, float | None],
            temper: float) -> dict[str, float]:
    """Target shares of the values that have tokens."""
    given = {v: named[v] for v in tokens if named.get(v) is not None}
    free = {v: n ** temper for v, n in tokens.items() if v not in given}
    left = max(0.0, 1.0 - sum(given.values())) if free else 0.0
    shares = given | {v: left * x / sum(free.values()) for v, x in free.items()}
    whole = sum(shares.values())
    return {v: x / whole for v, x in shares.items()} if whole else {}


def rake(cells: Mapping[Cell, float], targets: Targets) -> dict[Cell, float]:
    """Factors per cell that bring the sums of each side to its targets."""
    names = [cell for cell, n in cells.items() if n]
    tokens = np.array([cells[cell] for cell in names], float)
    factors = np.ones(len(names))
    wanted = []
    for side, name in enumerate(SIDES):
        values, where = np.unique([cell[side] for cell in names], return_inverse=True)
        sums = np.bincount(where, tokens, len(values))
        shares = _shares(dict(zip(values.tolist(), sums.tolist())), getattr(targets, name),
                         targets.temper.get(name, 1.0))
        wanted.append((where, np.array([shares[v] for v in values.tolist()]) * tokens.sum()))
    for _ in range(ROUNDS if names else 0):
        worst = 0.0
        for where, goal in wanted:
            now = np.bincount(where, tokens * factors, len(goal))
            scale = np.where(now > 0, goal / np.where(now > 0, now, 1), 1.0)
            worst = max(worst, float(np.abs(scale[now > 0] - 1).max(initial=0.0)))
            factors *= scale[where]
        if worst < CLOSE:
            break
    return dict(zip(names, factors.tolist()))


def probabilities(counted: DataFrame, targets: Targets) -> dict[Cell, float]:
    """The probability of each cell; at most one row per cell comes to the driver."""
    cells = {(r[0], r[1], r[2]): float(r[3] or 0) for r in counted.groupBy(
        "cell_source", "cell_lang", "cell_topic").agg(F.sum("tokens")).collect()}
    factors = rake(cells, targets)
    most = max(factors.values(), default=0.0)
    return {cell: factors.get(cell, most) / most if most else 1.0 for cell in cells}


def drawn(counted: DataFrame, chances: Mapping[Cell, float], doc_id: Column,
          seed: int) -> DataFrame:
    """Adds probability, draw (0 to 1) and kept."""
    cells = ["cell_source", "cell_lang", "cell_topic"]
    table = counted.sparkSession.createDataFrame(  # a row per cell, bounded by the parameters
        [(*cell, p) for cell, p in sorted(chances.items())],
        ", ".join(f"{name} string" for name in cells) + ", chance double")
    place = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(PARTS)) / F.lit(PARTS)
    return counted.join(F.broadcast(table), cells, "left").withColumns({
        "probability": F.coalesce("chance", F.lit(0.0)), "draw": place.cast("double")}).withColumn(
            "kept", F.col("draw") < F.col("probability")).drop("chance")


def mix_report(docs: DataFrame, targets: Targets) -> DataFrame:
    """One row per document: its cell, tokens, probability, draw and kept."""
    targets = named(docs, targets)
    counted = celled(docs.select("doc_id", "source", "lang", "text"), targets,
                     F.col("source"), F.col("lang"), F.col("text")).drop("text")
    chances = probabilities(counted, targets)
    return drawn(counted, chances, F.col("doc_id"), targets.seed).select(
        "doc_id", "source", "lang", F.col("cell_topic").alias("topic"), "tokens",
        "probability", "draw", "kept")


def sample(docs: DataFrame, targets: Targets) -> DataFrame:
    """The drawn documents, with their own columns."""
    row, targets = F.col("row"), named(docs, targets)
    counted = celled(docs.select(packed(docs)), targets, row["source"], row["lang"], row["text"])
    return drawn(counted, probabilities(counted, targets), row["doc_id"], targets.seed).where(
        "kept").select("row.*")
