"""Splitting text into sentences and packing them into word-bounded segments.

All of it is column work on one text per row (a document or a chapter), so a
corpus is segmented inside the scan stage, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import word_count

# Fixed values of the data contract.
DEFAULT_WORDS = 60
SCENE_BREAK = "* * *"
SENTENCE_END = r"""([.!?…。！？]["'»”’)\]}]*) """

CUT = "\u0001"  # phrase border inside a line
SCENE = "\u0002"  # stands for a scene break between phrases


def phrases(text: Column) -> Column:
    """Sentences in reading order; a scene break is the element ``SCENE``.

    White space other than line ends is collapsed over the whole text first, so
    that each rule is one pass and not one call per line.
    """
    clean = F.replace(F.replace(text, F.lit(CUT), F.lit("")), F.lit(SCENE), F.lit(""))
    spaced = F.regexp_replace(clean, r"(?U)[^\S\n]+", " ")
    broken = F.replace(spaced, F.lit(SCENE_BREAK), F.lit(CUT + SCENE + CUT))
    ended = F.regexp_replace(broken, SENTENCE_END, f"$1{CUT}")
    pieces = F.split(F.replace(ended, F.lit("\n"), F.lit(CUT)), CUT)
    return F.filter(F.transform(pieces, lambda piece: F.trim(piece)), lambda p: p != "")


def chunks(phrase_list: Column, limit: int) -> Column:
    """Phrases with their word counts; over-long ones cut every ``limit`` words."""

    def entry(text: Column, words: Column) -> Column:
        return F.struct(text.alias("text"), words.cast("int").alias("words"))

    def cut(phrase: Column) -> Column:
        words = F.split(phrase, " ")
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - 1, F.lit(limit)),
            lambda start: entry(
                F.array_join(F.slice(words, start + 1, limit), " "),
                F.least(F.lit(limit), F.size(words) - start),
            ),
        )

    counted = F.transform(phrase_list, lambda phrase: entry(phrase, word_count(phrase)))
    return F.flatten(F.transform(counted, lambda item: F.when(
        item["words"] <= limit, F.array(item)).otherwise(cut(item["text"]))))


def pack(chunk_list: Column, limit: int) -> Column:
    """Greedy packing: fill a segment while it holds at most ``limit`` words."""

    def state(done: Column, text: Column, words: Column) -> Column:
        return F.struct(done.alias("done"), text.alias("text"), words.alias("words"))

    def close(acc: Column) -> Column:
        return F.when(acc["words"] > 0, F.concat(acc["done"], F.array(acc["text"]))
                      ).otherwise(acc["done"])

    def step(acc: Column, chunk: Column) -> Column:
        full = (acc["words"] > 0) & (acc["words"] + chunk["words"] > limit)
        return (
            F.when(chunk["text"] == SCENE, state(close(acc), F.lit(""), F.lit(0)))
            .when(full, state(close(acc), chunk["text"], chunk["words"]))
            .otherwise(state(
                acc["done"],
                F.when(acc["words"] == 0, chunk["text"])
                .otherwise(F.concat(acc["text"], F.lit(" "), chunk["text"])),
                acc["words"] + chunk["words"],
            ))
        )

    empty = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    return F.aggregate(chunk_list, empty, step, close)


def segments(text: Column, limit: int = DEFAULT_WORDS) -> Column:
    """Segments of at most ``limit`` words."""
    if limit <= 0:
        raise ValueError("the word limit must be positive")
    return pack(chunks(phrases(text), limit), limit)


def has_words(text: Column) -> Column:
    """Whether a text has any segment, without cutting it.

    Anything but white space and stars settles it; the exact test is for the rest.
    """
    return text.rlike(r"(?U)[^\s*\x01\x02]") | (F.size(F.filter(
        phrases(text), lambda phrase: phrase != SCENE)) > 0)


def explode_segments(frame: DataFrame, text: str, limit: int = DEFAULT_WORDS) -> DataFrame:
    """One row per segment: the other columns, ``ordinal`` from 1, ``text``, ``words``."""
    kept = [name for name in frame.columns if name != text]
    return (
        # Outer, and filtered afterwards: see ``chapters``.
        frame.select(
            *kept, F.posexplode_outer(segments(F.col(text), limit)).alias("_pos", "text"))
        .where(F.col("_pos").isNotNull())
        .select(*kept, (F.col("_pos") + 1).alias("ordinal"), "text",
                word_count(F.col("text")).alias("words"))
    )


def explode_sentences(frame: DataFrame, text: str) -> DataFrame:
    """One row per sentence with ``sentence_no`` and ``break_before``."""
    kept = [name for name in frame.columns if name != text]
    listed = frame.select(*kept, phrases(F.col(text)).alias("_all"))
    marked = F.transform(F.col("_all"), lambda phrase, i: F.struct(
        phrase.alias("text"),
        ((i > 0) & (F.try_element_at(F.col("_all"), i) == SCENE)).alias("break_before")))
    spoken = F.filter(marked, lambda item: item["text"] != SCENE)
    rows = listed.select(*kept, F.posexplode_outer(spoken).alias("_pos", "_item"))
    return rows.where(F.col("_pos").isNotNull()).select(
        *kept, (F.col("_pos") + 1).alias("sentence_no"),
        F.coalesce(F.col("_item.break_before"), F.lit(False)).alias("break_before"),
        F.col("_item.text").alias("text"))
