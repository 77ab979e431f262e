"""Queries over book text: blocks, chapters, sentences, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import collapse_space, stage_limits, word_count
from lectern.operators import chapters as chapter_ops
from lectern.operators.segment import explode_segments, explode_sentences, segments
from lectern.plans import sql
from lectern.plans.registry import query
from lectern.sources import views


@query("segment_report", f"""
WITH {sql.packed('documents', 'doc_id, lang', 'text')},
segs AS (SELECT lang, doc_id, unnest(segs) AS s FROM packed)
SELECT lang, count(DISTINCT doc_id) AS books, count(*) AS segments,
  sum(len(string_split(s, ' '))) AS words, max(len(string_split(s, ' '))) AS longest
FROM segs GROUP BY lang""")
def segment_report(spark: SparkSession, folder: str) -> DataFrame:
    # Counted per book inside the scan stage, so only one row per language is shuffled.
    sizes = F.transform(segments(F.col("text")), lambda text: word_count(text))
    return (
        views.books(spark, folder).select("lang", sizes.alias("sizes"))
        .groupBy("lang").agg(
            # A filter would be pushed below the segmentation and run it twice.
            F.count_if(F.size("sizes") > 0).alias("books"),
            F.sum(F.size("sizes")).alias("segments"),
            F.sum(F.aggregate("sizes", F.lit(0), lambda a, b: a + b)).alias("words"),
            F.max(F.array_max("sizes")).alias("longest"))
    )


@query("segments", f"""
WITH {sql.packed('documents', 'doc_id', 'text')}
SELECT doc_id AS book_id, generate_subscripts(segs, 1) AS ordinal, unnest(segs) AS text,
  len(string_split(unnest(segs), ' ')) AS words
FROM packed""")
def segment_rows(spark: SparkSession, folder: str) -> DataFrame:
    return explode_segments(views.books(spark, folder).drop("lang"), "text")


@query("sentences", rf"""
WITH {sql.packed('documents', 'doc_id', 'text')},
numbered AS (SELECT doc_id, phrases, unnest(phrases) AS text,
  generate_subscripts(phrases, 1) AS i FROM phrased)
SELECT doc_id AS book_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sentence_no,
  coalesce(i > 1 AND phrases[i - 1] = chr(2), false) AS break_before, text
FROM numbered WHERE text <> chr(2)""")
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return explode_sentences(views.books(spark, folder).drop("lang"), "text")


@query("clean_words", f"""
WITH c AS (SELECT doc_id, {sql.collapsed('text')} AS t FROM documents)
SELECT doc_id AS book_id, md5(t) AS text_md5,
  CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM c""")
def clean_words(spark: SparkSession, folder: str) -> DataFrame:
    clean = views.books(spark, folder).select(
        "book_id", collapse_space(F.col("text")).alias("text"))
    return clean.select("book_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
                        word_count(F.col("text")).alias("words"))


def _books(spark: SparkSession, folder: str) -> DataFrame:
    return chapter_ops.with_chapters(views.books_with_blocks(spark, folder))


@query("chapters", f"""
WITH {sql.CHAPTERS}
SELECT book_id, chapter_number, title, len(segs) AS segments FROM chapters""")
def chapter_list(spark: SparkSession, folder: str) -> DataFrame:
    return chapter_ops.chapter_rows(_books(spark, folder)).select(
        "book_id", "chapter_number", "title", F.size("segments").alias("segments"))


@query("fragments", f"""
WITH {sql.BOOK_FRAGMENTS}
SELECT book_id, ordinal, chapter_number, ordinal_in_chapter, text, words FROM book_fragments""")
def fragments(spark: SparkSession, folder: str) -> DataFrame:
    return chapter_ops.fragment_rows(_books(spark, folder))


@query("fragment_titles", f"""
WITH {sql.BOOK_FRAGMENTS}
SELECT f.book_id, f.chapter_number, f.ordinal, c.title AS chapter_title,
  length(f.text) AS chars
FROM book_fragments f JOIN chapters c USING (book_id, chapter_number)""")
def fragment_titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = chapter_ops.fragment_rows(_books(spark, folder), "title")  # carried along, no join
    return rows.select("book_id", "chapter_number", "ordinal",
                       F.col("title").alias("chapter_title"),
                       F.char_length("text").alias("chars"))


@query("book_summary", f"""
WITH {sql.CHAPTERS}
SELECT book_id, chapter_number, title, len(segs) AS segments,
  count(*) OVER (PARTITION BY book_id) AS chapters_count,
  sum(len(segs)) OVER (PARTITION BY book_id) AS segments_total FROM chapters""")
def book_summary(spark: SparkSession, folder: str) -> DataFrame:
    return chapter_ops.book_summary(_books(spark, folder))


@query("book_counts", f"""
WITH {sql.CHAPTERS}
SELECT book_id, count(*) AS chapters_count, sum(len(segs)) AS fragments_count
FROM chapters GROUP BY book_id""")
def book_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chapter_ops.book_counts(_books(spark, folder))


@query("preflight", f"""
WITH c AS (SELECT doc_id, {sql.collapsed('text')} AS t FROM documents),
s AS (SELECT doc_id, length(t) AS chars,
  CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM c)
SELECT doc_id AS book_id, chars, words, array_to_string(list_filter([
  CASE WHEN chars > 2000 THEN 'speech_chars' END, CASE WHEN words > 120 THEN 'speech_words' END,
  CASE WHEN chars > 4000 THEN 'transcribe_chars' END,
  CASE WHEN chars > 8000 THEN 'rewrite_chars' END,
  CASE WHEN chars > 20000 THEN 'edit_chars' END], lambda x: x IS NOT NULL), ',') AS refused_by
FROM s""")
def preflight(spark: SparkSession, folder: str) -> DataFrame:
    clean = views.books(spark, folder).select(
        "book_id", collapse_space(F.col("text")).alias("text"))
    words = word_count(F.col("text"))
    return clean.select("book_id", F.char_length("text").alias("chars"), words.alias("words"),
                        F.array_join(stage_limits(F.col("text"), words), ",")
                        .alias("refused_by"))
