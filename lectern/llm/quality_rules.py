"""Quality rules whose cutoffs come from the data.

Each document gets a few counts (``measures``), all inside its row. Rates made from
them go into one quantile sketch per language and source: values keep their seven
leading bits, and the sketch is the number of rows per such bucket. Sketches merge by
adding counts, so they combine before the shuffle, a hot source costs no more than a
small one, the sketch of a language is the sum of its sources', and the result does
not depend on the order of merging. A quantile read from one is exact in rank and less
than 1/64 low in value.

A cutoff is a fence: the third quartile plus ``REACH`` spreads (below: the first
quartile minus as much), where a spread is the distance of the quartiles but never less
than the rate's resolution. Sources with fewer than ``LEAST_ROWS`` documents take the
fences of their language, small languages those of all documents.

Null and empty texts have no words and fail the base rule. A null language or source is
a group like any other, named by the empty string. Repeated rows are judged alike.
Empty tables give empty results. Extra columns pass through ``keep_good`` untouched.
Windows of words are compared by 64-bit hashes. Very long texts take the same steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.columns import let, packed, present, words_of
from lectern.session import reliable_checkpoint

SYMBOLS = "#*$%&|<>"
#: Rates: name, numerator, denominator, resolution, per 10,000; both sides are fenced
#: only for the length of words.
RATES = (
    ("symbols", "n_symbols", "word_chars", 100),
    ("capitals", "n_capitals", "word_chars", 200),
    ("dup_lines", "n_dup_lines", "n_lines", 1500),
    ("repeats", "n_repeat_words", "n_words", 1500),
    ("length", "word_chars", "n_words", 5000),
)
REACH = 3
LEAST_ROWS = 200
LEAST_WORDS = 50
#: Fences are broadcast up to this many groups, a few megabytes.
BROADCAST_GROUPS = 50_000
SLICES = 32
PLACE_BITS = 24


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds more than once.

    Most texts repeat none. In the others one sort of plain numbers (hash with its low
    bits replaced by the place) finds the few places whose windows may repeat, and only
    these are compared by their whole hashes.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3),
                         lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def prefix_shared(x: Column, other: Column) -> Column:
        return F.shiftright(x, PLACE_BITS) == F.shiftright(other, PLACE_BITS)

    def candidates(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        return F.transform(
            F.filter(ordered, lambda x, j: (
                ((j > 0) & prefix_shared(x, ordered[F.greatest(j - 1, F.lit(0))]))
                | ((j < last) & prefix_shared(x, ordered[F.least(j + 1, last)])))),
            lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))

    def starts(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twice = F.filter(ordered, lambda x, j: (
            ((j > 0) & (ordered[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
            | ((j < last) & (ordered[F.least(j + 1, last)]["h"] == x["h"]))))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return F.aggregate(
            F.transform(places, lambda p, k: F.when(k == last, 3).otherwise(
                F.least(F.lit(3), places[k + 1] - p))),
            F.lit(0), lambda total, add: total + add)

    def repeats(h: Column) -> Column:
        def exact(places: Column) -> Column:
            ordered = F.sort_array(F.transform(
                places, lambda p: F.struct(h[p].alias("h"), p.alias("p"))))
            return F.when(F.size(places) == 0, 0).otherwise(
                let(let(ordered, starts), covered))

        keyed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(
            i.cast("long")))
        every = F.sequence(F.lit(0), F.size(h) - 1)  # more places than there are bits
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), 0)
                .when(F.size(h) > 1 << PLACE_BITS, let(every, exact))
                .otherwise(let(let(F.sort_array(keyed), candidates), exact)))

    return F.when(n < 4, 0).otherwise(let(hashes, repeats))


def measures(text: Column) -> Column:
    """A struct of counts of one text."""
    text = present(text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    def of_words(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"),
                        F.length(F.array_join(x, "")).cast("long").alias("chars"),
                        _repeated_words(x).cast("long").alias("repeats"))

    def number(kind: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")

    return F.struct(let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"),
                    number(SYMBOLS).alias("symbols"), number("A-Z").alias("capitals"))


def measured(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the counts and ``base_failed`` as plain columns.

    The outer generator keeps filters on the counts from computing them again.
    """
    repeats, n = F.col("m.w.repeats"), F.col("m.w.n")
    once = F.explode_outer(F.array(measures(text))).alias("m")
    return rows.select(*[F.col(f"`{name}`") for name in rows.columns], once).select(
        *rows.columns, n.alias("n_words"), F.col("m.w.chars").alias("word_chars"),
        F.col("m.symbols").alias("n_symbols"), F.col("m.l.dup").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"), F.col("m.l.n").alias("n_lines"),
        F.col("m.capitals").alias("n_capitals"),
        ((n < LEAST_WORDS) | (100 * repeats > 50 * n)).alias("base_failed"))


def _rate(top: str, bottom: str) -> Column:
    return F.expr(f"CASE WHEN {bottom} = 0 THEN 0L ELSE {top} * 10000 DIV {bottom} END")


def bucket(value: Column) -> Column:
    """The value with all but its seven leading bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def fences(counted: DataFrame) -> DataFrame:
    """Per (lang, source): the bounds of every rate. Reads the base rule's survivors."""
    entries = F.inline(F.array(*[
        F.struct(F.lit(name).alias("rate"), bucket(_rate(top, bottom)).alias("bucket"))
        for name, top, bottom, _ in RATES]))
    sketches = (
        counted.where(~F.col("base_failed")).select("lang", "source", entries)
        .groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n")))
    every = (
        sketches.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")
        .union(sketches.groupBy("lang", "rate", "bucket").agg(F.sum("n")).select(
            F.lit(1), "lang", F.lit(""), "rate", "bucket", "sum(n)"))
        .union(sketches.groupBy("rate", "bucket").agg(F.sum("n")).select(
            F.lit(2), F.lit(""), F.lit(""), "rate", "bucket", "sum(n)")))
    sketch = Window.partitionBy("level", "lang", "source", "rate")
    placed = every.withColumns({
        "upto": F.sum("n").over(sketch.orderBy("bucket")), "rows": F.sum("n").over(sketch)})
    bounds = placed.groupBy("level", "lang", "source", "rate").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("bucket"))).alias("low"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, F.col("bucket"))).alias("high"),
        F.first("rows").alias("rows"))
    least = F.create_map(*[x for name, *_, least in RATES for x in (F.lit(name), F.lit(least))])
    spread = F.greatest(F.col("high") - F.col("low"), least[F.col("rate")]) * REACH
    wide = (
        bounds.withColumn("spread", spread).groupBy("level", "lang", "source")
        .agg(F.max("rows").alias("rows"), *[
            F.max(F.when(F.col("rate") == name, F.col("high") + F.col("spread")))
            .alias(f"{name}_most") for name, *_ in RATES],
            F.max(F.when(F.col("rate") == "length", F.col("low") - F.col("spread")))
            .alias("length_least")))
    names = [*[f"{name}_most" for name, *_ in RATES], "length_least"]
    own = wide.where("level = 0")
    upper = wide.where(f"level = 1 AND rows >= {LEAST_ROWS}").select(
        "lang", *[F.col(x).alias(f"u_{x}") for x in names])
    total = wide.where("level = 2").select(*[F.col(x).alias(f"t_{x}") for x in names])
    return (
        own.join(upper, "lang", "left").join(F.broadcast(total), F.lit(True), "left")  # one row
        .select("lang", "source", *[
            F.when(F.col("rows") >= LEAST_ROWS, F.col(x))
            .otherwise(F.coalesce(F.col(f"u_{x}"), F.col(f"t_{x}"))).alias(x) for x in names]))


def with_fences(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Joins the fences to rows with ``lang``, ``source`` and ``doc_id``.

    Few groups are broadcast after their number has been checked. Beyond that, hot
    sources are cut into slices by doc_id and each fence is repeated per slice.
    """
    if bounds.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(bounds), ["lang", "source"], "left")
    slices = bounds.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return (rows.withColumn("slice", F.coalesce(
                F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"), F.lit(0)))
            .join(slices, ["lang", "source", "slice"], "left").drop("slice"))


def verdict() -> Column:
    """False where a rate lies outside the fences of its group."""
    outside = _rate("word_chars", "n_words") < F.col("length_least")
    for name, top, bottom, _ in RATES:
        outside = outside | (_rate(top, bottom) > F.col(f"{name}_most"))
    return ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))


def _groups() -> list[Column]:
    return [present(F.col("lang")).alias("lang"), present(F.col("source")).alias("source")]


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, fences of its group, ``base_failed``, ``kept``.

    The counts are taken once and fixed by a reliable checkpoint without the texts.
    """
    slim = docs.select("doc_id", F.col("text").alias("t"), *_groups())
    counted = reliable_checkpoint(measured(slim, F.col("t")).drop("t"))
    return with_fences(counted, reliable_checkpoint(fences(counted))).withColumn(
        "kept", verdict())


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are not shuffled: they are counted once for the fences and once for the verdict.
    """
    slim = docs.select(packed(docs), "doc_id", *_groups())
    bounds = reliable_checkpoint(fences(measured(slim.drop("doc_id"), F.col("row.text"))))
    judged = with_fences(measured(slim, F.col("row.text")), bounds)
    return judged.where(verdict()).select("row.*")
