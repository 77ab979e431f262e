"""From text blocks to chapters and numbered fragments.

A book is one input record (a file or document row), so all of this happens inside
its row with array functions: a corpus is assembled, cut and numbered in the scan
stage without a shuffle. Every step is linear in the blocks of the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse_space, word_count
from lectern.operators.segment import DEFAULT_WORDS, has_words, segments

PATH_JOINER = " — "


def gather_blocks(rows: DataFrame) -> DataFrame:
    """Block rows as one row per book; a book is bounded by its file."""
    block = F.struct("block_no", "section_id", "section_path", "text")
    return rows.groupBy("book_id").agg(
        F.first("body_title").alias("body_title"),
        F.array_sort(F.collect_list(block)).alias("blocks"))


def with_drafts(books: DataFrame) -> DataFrame:
    """Add ``drafts`` ARRAY<STRUCT<title, text>>: maximal runs of blocks of one section.

    ``books``: body_title and ``blocks`` ARRAY<STRUCT<section_id, section_path, text>>
    with a NULL section for loose body text. Loose text goes to the section that
    follows, trailing loose text to the last one; a book without sections is a
    single draft under the body title. So a draft begins right after the last block
    of the section before it.
    """
    owned = F.filter(
        F.transform("blocks", lambda block, at: F.struct(
            at.alias("at"), block["section_id"].alias("section"),
            block["section_path"].alias("path"))),
        lambda block: block["section"].isNotNull())
    previous = F.col("_owned")
    changes = F.transform(
        F.slice("_owned", F.lit(2), F.greatest(F.size("_owned") - 1, F.lit(0))),
        lambda block, i: F.when(
            block["section"] != F.get(previous, i)["section"],
            F.struct((F.get(previous, i)["at"] + 1).alias("at"), block["path"].alias("path"))))
    first = F.struct(F.lit(0).alias("at"), F.get(previous, F.lit(0))["path"].alias("path"))
    starts = F.concat(F.array(first), F.filter(changes, lambda start: start.isNotNull()))

    def title(path: Column) -> Column:
        return F.coalesce(
            F.array_join(F.filter(path, lambda part: part != ""), PATH_JOINER),
            F.col("body_title"))

    def text(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_starts"), k + 1)["at"], F.size("blocks"))
        own = F.slice("blocks", start["at"] + 1, end - start["at"])
        return F.array_join(F.transform(own, lambda block: block["text"]), "\n")

    drafts = F.transform("_starts", lambda start, k: F.struct(
        title(start["path"]).alias("title"), text(start, k).alias("text")))
    return (
        books.withColumn("_owned", owned).withColumn("_starts", starts)
        .withColumn("drafts", drafts).drop("_owned", "_starts")
    )


def with_chapters(books: DataFrame, limit: int = DEFAULT_WORDS) -> DataFrame:
    """Books with ``chapters`` ARRAY<STRUCT<number, title, segments>>; empty ones dropped."""
    spoken = F.filter("drafts", lambda draft: has_words(draft["text"]))
    chapters = F.transform(spoken, lambda draft, k: F.struct(
        (k + 1).alias("chapter_number"), collapse_space(draft["title"]).alias("title"),
        segments(draft["text"], limit).alias("segments")))
    return with_drafts(books).select("book_id", chapters.alias("chapters"))


def chapter_rows(books: DataFrame) -> DataFrame:
    """One row per chapter: book_id, chapter_number, title, segments."""
    return books.select("book_id", F.inline_outer("chapters")).where(
        F.col("chapter_number").isNotNull())


def fragment_rows(books: DataFrame, *extra: str) -> DataFrame:
    """Fragments with their ordinal in the book and in the chapter.

    ``extra`` names further chapter fields to repeat on every fragment.
    """
    listed = F.flatten(F.transform("chapters", lambda chapter: F.transform(
        chapter["segments"], lambda text, i: F.struct(
            chapter["chapter_number"].alias("chapter_number"),
            (i + 1).alias("ordinal_in_chapter"), text.alias("text"),
            *[chapter[name].alias(name) for name in extra]))))
    rows = books.select("book_id", F.posexplode_outer(listed).alias("_at", "_f"))
    return rows.where(F.col("_at").isNotNull()).select(
        "book_id", (F.col("_at") + 1).alias("ordinal"), "_f.*",
        word_count(F.col("_f.text")).alias("words"))


def book_summary(books: DataFrame) -> DataFrame:
    """Chapters with their segment counts next to the totals of the book."""
    sizes = F.transform("chapters", lambda chapter: F.struct(
        chapter["chapter_number"].alias("chapter_number"), chapter["title"].alias("title"),
        F.size(chapter["segments"]).alias("segments")))
    return books.select("book_id", sizes.alias("_sizes")).select(
        "book_id", F.size("_sizes").alias("chapters_count"),
        F.aggregate("_sizes", F.lit(0), lambda total, one: total + one["segments"])
        .alias("segments_total"),
        F.inline_outer("_sizes")).where(F.col("chapter_number").isNotNull())


def book_counts(books: DataFrame) -> DataFrame:
    """Chapters and fragments of every book that has any."""
    sized = books.select("book_id", F.transform(
        "chapters", lambda chapter: F.size(chapter["segments"])).alias("_sizes"))
    totals = F.struct(
        F.size("_sizes").alias("chapters_count"),
        F.aggregate("_sizes", F.lit(0), lambda a, b: a + b).alias("fragments_count"))
    return sized.select("book_id", F.inline_outer(F.filter(
        F.array(totals), lambda total: total["chapters_count"] > 0))).where(
        F.col("chapters_count").isNotNull())


def with_titles(fragments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Stored fragments with the title of their chapter; both sides hash on the book."""
    titles = chapters.select("book_id", "chapter_number", F.col("title").alias("chapter_title"))
    return fragments.join(titles, ["book_id", "chapter_number"])
