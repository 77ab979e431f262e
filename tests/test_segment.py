"""Segmentation: small examples, a plain model on random texts, and corpus properties."""

import random
import re

import pytest
from checking import SMALL
from pyspark.sql import functions as F

from lectern.operators import chapters as ch
from lectern.operators import segment as se
from lectern.sources import views


def model(text, limit):
    """The packing rules in plain Python."""
    done, open_words = [], []

    def close():
        if open_words:
            done.append(" ".join(open_words))
            open_words.clear()

    for line in text.split("\n"):
        for i, piece in enumerate(" ".join(line.split()).split("* * *")):
            if i:
                close()
            for phrase in re.split(r"""(?<=\x01)""", re.sub(
                    r"""([.!?…。！？]["'»”’)\]}]*) """, "\\1\x01", piece.strip())):
                words = phrase.strip("\x01 ").split()
                for k in range(0, len(words), limit):
                    chunk = words[k:k + limit]
                    if len(open_words) + len(chunk) > limit:
                        close()
                    open_words.extend(chunk)
    close()
    return done


def run(spark, texts, limit):
    rows = [(i, text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, text string").repartition(8)
    found = frame.select("i", se.segments(F.col("text"), limit).alias("s")).collect()
    return [row["s"] for row in sorted(found)]


@pytest.mark.parametrize("limit", [1, 2, 5, 40])
def test_sentences_are_packed_whole(spark, limit):
    """Generated sentences of known lengths: none within the limit is ever cut."""
    draw = random.Random(limit)
    texts, wanted = [], []
    for _ in range(200):
        sentences = [[f"v{draw.randrange(99)}" for _ in range(draw.randint(1, 2 * limit))]
                     for _ in range(draw.randint(1, 6))]
        for words in sentences:
            words[-1] += draw.choice(["!", "?", ".", "…", '."', ".)"])
        texts.append(draw.choice([" ", "\n", " \t\n "]).join(map(" ".join, sentences)))
        packs = [[]]
        for words in sentences:
            for k in range(0, len(words), limit):
                piece = words[k:k + limit]
                if len(packs[-1]) + len(piece) > limit:
                    packs.append([])
                packs[-1] += piece
        wanted.append([" ".join(pack) for pack in packs if pack])
    assert run(spark, texts, limit) == wanted


@pytest.mark.parametrize("mark", ["* * *", " *  * * ", "*\u00a0* *"])
def test_a_scene_break_always_closes(spark, mark):
    left, right = "tin roof", "copper bell"
    for between in (mark, f"\n{mark}\n", mark * 2):
        assert run(spark, [left + between + right], 50) == [[left, right]]
    assert run(spark, [mark, f"{mark}{left}", f"{left}{mark}"], 50) == [[], [left], [left]]


def test_white_space_only(spark):
    assert run(spark, ["", " ", "\n\u2003\t", "\u00a0"], 3) == [[]] * 4


def test_phrases_join_to_the_text(spark):
    """Ends are kept with their phrase, and numbers are not ends."""
    draw = random.Random(9)
    parts = ["plum", "3.75", "oak?!", "fir…", "elm.)", "ash!»", "yew。", "box"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: r["p"] for r in frame.select("i", se.phrases(F.col("t")).alias("p")).collect()}
    for i, text in enumerate(texts):
        assert " ".join(found[i]) == text
        for phrase in found[i][:-1]:
            assert phrase.split()[-1] in ("oak?!", "fir…", "elm.)", "ash!»", "yew。")
        for phrase in found[i]:
            assert not set(phrase.split()[:-1]) & {"oak?!", "fir…", "elm.)", "ash!»", "yew。"}


def test_default_limit(spark):
    assert [len(s) for s in run(spark, [" ".join(["w"] * 60), " ".join(["w"] * 61)], 60)] == [1, 2]
    with pytest.raises(ValueError):
        se.segments(F.col("t"), 0)


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_random_texts(spark, limit):
    random.seed(limit)
    alphabet = ["a", "bb", ".", "!", "?", "…", '"', ")", " ", " ", "\n", "\u00a0", "* * *", "1.5"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(1500)]
    assert run(spark, texts, limit) == [model(text, limit) for text in texts]


def test_corpus_properties(spark):
    """No empty segment, none over the limit, and no word lost or changed."""
    books = views.books(spark, SMALL)
    rows = books.select("book_id", se.segments(F.col("text")).alias("s"), F.filter(F.split(
        F.regexp_replace("text", r"(?U)\s+", " "), " "), lambda w: w != "").alias("words"))
    bad = rows.where(
        F.exists("s", lambda t: (t == "") | (F.size(F.split(t, " ")) > 60))
        | (F.array_join("s", " ") != F.array_join("words", " ")))
    assert bad.count() == 0


def draft_model(blocks):
    """Chapters of one book by walking the blocks: (owner, texts)."""
    drafts, loose = [], []
    for section, text in blocks:
        if section is None:
            loose.append(text)
        elif drafts and drafts[-1][0] == section and not loose:
            drafts[-1][1].append(text)
        elif drafts and drafts[-1][0] == section:
            drafts[-1][1].extend([*loose, text])
            loose = []
        else:
            drafts.append((section, [*loose, text]))
            loose = []
    if loose:
        if drafts:
            drafts[-1][1].extend(loose)
        else:
            drafts.append((None, loose))
    return ["\n".join(texts) for _, texts in drafts]


def test_random_section_orders(spark):
    random.seed(5)
    books = [[(random.choice([None, 1, 2, 3]), f"t{i}") for i in range(random.randint(1, 9))]
             for _ in range(300)]
    rows = [(b, i, section, [f"S{section}"] if section else None, text, "Body")
            for b, blocks in enumerate(books) for i, (section, text) in enumerate(blocks)]
    frame = spark.createDataFrame(
        rows, "book_id int, block_no int, section_id int, section_path array<string>, "
        "text string, body_title string")
    found = {row["book_id"]: [draft["text"] for draft in row["drafts"]]
             for row in ch.with_drafts(ch.gather_blocks(frame)).collect()}
    assert [found[b] for b in range(len(books))] == [draft_model(blocks) for blocks in books]
