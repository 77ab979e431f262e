"""Byte-level BPE, chats, quality rules and licences."""

import hashlib
import random
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import SMALL, clashing, documents, prose, rows_of
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, chat, licenses, quality_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    tokens = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(tokens)})


def test_tokens_equal_tiktoken(reference):
    tokens = byte_bpe.read_ranks(RANKS)
    own = byte_bpe.Tokenizer(tokens, byte_bpe.model(tokens), public_tokenizers.PATTERN)
    draw = random.Random(1)
    letters = "ab'sdl 1٣é漢\n\t\r\x0b\x1c\x85\u00a0\u3000!?#|<>{}😀ñ\u0301"
    texts = ["", " ", "x" * 3000, "<|endoftext|>"] + [
        "".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(2000)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert byte_bpe.decoded_bytes(tokens, ids) == text.encode()


def test_token_digests(spark, reference):
    docs = documents(spark)
    wanted = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        wanted.append((r["doc_id"], len(ids),
                       hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    for frame in (docs, clashing(docs)):
        assert rows_of(byte_bpe.digests(frame, RANKS, public_tokenizers.PATTERN)) == sorted(
            wanted, key=repr)
    assert byte_bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


LOG = "conv_id long, turn long, message string, seq int, kind string, role string, text string"


def test_events_are_folded(spark):
    log = spark.createDataFrame([
        (1, 0, "a", 0, "open", "user", None), (1, 0, "a", 1, "delta", None, "hel"),
        (1, 0, "a", 2, "delta", None, "lo"), (1, 1, "b", 0, "open", "assistant", ""),
        (1, 1, "b", 1, "delta", None, "wrong"), (1, 1, "b", 2, "regenerate", None, None),
        (1, 1, "b", 3, "delta", None, "right"), (1, 2, "c", 0, "open", "user", ""),
        (1, 2, "c", 1, "delta", None, "x"), (1, 2, "c", 2, "edit", None, "edited"),
        (1, 3, "d", 0, "open", "user", ""), (1, 3, "d", 1, "delete", None, None),
    ], LOG).orderBy(F.rand(3))
    pieces = sorted(chat.formatted(log).collect(), key=lambda r: r["turn"])
    joined = "".join(r["formatted"] for r in pieces)
    assert list(chat.parse(joined)) == [
        ("user", "hello"), ("assistant", "right"), ("user", "edited")]
    assert [r["formatted"][r["loss_start"]:r["loss_end"]] for r in pieces] == ["", "right", ""]


def test_marks_in_texts_are_restored():
    draw = random.Random(2)
    parts = ["\\", "#", "##", "###", "</turn>", "<", "/turn>", "\n", ": ", "user", "é", "\\n"]
    messages = [("".join(draw.choice(parts) for _ in range(draw.randrange(4))),
                 "".join(draw.choice(parts) for _ in range(draw.randrange(12))))
                for _ in range(3000)]
    joined = "".join(chat.render(*m)[0] for m in messages)
    assert list(chat.parse(joined)) == messages
    with pytest.raises(ValueError):
        list(chat.parse("### user: cut"))


def test_conversations_with_odd_rows(spark):
    rows = spark.createDataFrame([
        (1, 0, None, None), (1, 1, "assistant", ""), (None, None, "user", "x"),
        (2, 5, "user", prose(1, 20_000)), (2, 5, "user", "tie"), (2, 5, "user", "tie"),
    ], "conv_id long, turn long, role string, text string").withColumn("message", F.lit("own"))
    found = {r["conv_id"]: r for r in chat.read_back(
        chat.formatted(chat.event_log(rows))).collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 2, None: 1, 2: 3}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\n\n").hexdigest()
    assert found[1]["loss_chars"] == 0
    assert chat.read_back(chat.formatted(chat.event_log(rows.limit(0)))).count() == 0


def _measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    texts = [None, "", "a b c a b c", "a a a a", "a b c d", "x\nx\n \nx", "#a $b\u00a0c|<>",
             "w " * 200, prose(4, 500), prose(4, 300) + " " + prose(4, 300), "a b a b a"]
    frame = quality_rules.measured(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"),
        F.col("text")).orderBy("doc_id")
    found = [tuple(r)[2:7] for r in frame.collect()]
    assert found == [_measures(t) for t in texts]


def test_many_places(spark, monkeypatch):
    """Texts with more windows than the packed places can number take the other way."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 4)
    text = prose(6, 40) + " " + prose(7, 30) + " " + prose(6, 40)
    frame = quality_rules.measured(spark.createDataFrame([(text,)], "text string"), F.col("text"))
    assert tuple(frame.first())[1:6] == _measures(text)


def test_rules_on_odd_rows(spark):
    docs = documents(spark)
    report = quality_rules.quality_report(docs)
    assert report.count() == docs.count()
    kept = quality_rules.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(
        map(repr, (r["doc_id"] for r in report.where("kept").collect())))
    assert quality_rules.quality_report(docs.limit(0)).count() == 0
    assert report.where("n_words = 0 and kept").count() == 0


def test_fences_beyond_broadcast(spark, monkeypatch):
    docs = documents(spark)
    wanted = rows_of(quality_rules.quality_report(docs).select("doc_id", "kept"))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert rows_of(quality_rules.quality_report(docs).select("doc_id", "kept")) == wanted


def test_licences(spark):
    docs = documents(spark).union(spark.createDataFrame([
        (90, prose(8, 30) + "\nReleased under the MIT License.\n" + prose(9, 20),
         "en", "a", None),
        (91, "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "en", "a", None),
        (92, "This programme is licensed under the Quux Licence of Barland, version 7.",
         "en", "a", None)], docs_schema(spark)))
    found = licenses.scan(clashing(docs)).collect()
    known = {(r["doc_id"], r["paragraph"], r["family"]) for r in found}
    assert {(90, 1, "mit"), (91, 0, "cc-by-nc"), (91, 1, "proprietary")} <= known
    assert {r["doc_id"] for r in found} <= {90, 91, 92}
    assert all(r["family"] == "unknown" for r in found if r["doc_id"] == 92)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    place = next(r for r in found if r["doc_id"] == 90)
    assert texts[90][place["start"]:place["end"]] == "Released under the MIT License."
    assert licenses.scan(docs.limit(0)).count() == 0


def docs_schema(spark):
    return documents(spark).schema


def test_licence_variants_are_told_apart():
    model = licenses.fit([prose(i, 30) for i in range(500)])
    features, right, all_of = licenses.Features(), 0, 0
    for family, templates in licenses.TEMPLATES.items():
        for text in templates:
            found = licenses.scan_text("Note. " + text.upper(), model, features)
            right += [r["family"] for r in found] == [family]
            all_of += 1
    assert right >= 0.9 * all_of
    assert not licenses.scan_text(prose(3, 400), model, features)


@pytest.fixture(scope="module")
def licence_model():
    return licenses.fit([prose(i, 30) for i in range(500)])


def families(text, model):
    return [r["family"] for r in licenses.scan_text(text, model, licenses.Features())]


@pytest.mark.parametrize("width", [40, 60, 75, 100])
@pytest.mark.parametrize("family, number", [
    ("mit", 2), ("bsd", 1), ("bsd", 2), ("apache-2.0", 1), ("apache-2.0", 2), ("gpl", 1),
    ("gpl", 2), ("isc", 1)])
def test_wrapped_notices(licence_model, family, number, width):
    notice = textwrap.fill(licenses.TEMPLATES[family][number], width)
    text = f"{prose(1, 40)}\n\n{notice}\n\n{prose(2, 40)}"
    found = licenses.scan_text(text, licence_model, licenses.Features())
    assert [r["family"] for r in found] == [family]
    held = " ".join(text[found[0]["start"]:found[0]["end"]].split())
    assert held == " ".join(notice.split())


@pytest.mark.parametrize("line, family", [
    ("SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("License: GPLv3", "gpl"), ("// SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("SPDX-License-Identifier: ISC", "isc"), ("License: CC BY 4.0", "cc-by")])
def test_short_identifiers(licence_model, line, family):
    assert families(f"{prose(5, 30)}\n{line}\n{prose(6, 30)}", licence_model) == [family]


def test_a_licence_of_no_family_is_unknown(licence_model):
    notice = ("This software is provided as-is, without any express or implied warranty. In no "
              "event will the authors be held liable for any damages arising from the use of this "
              "software. Permission is granted to anyone to use this software for any purpose.")
    found = families(f"{prose(1, 40)}\n\n{textwrap.fill(notice, 75)}\n\n{prose(2, 40)}", licence_model)
    assert found and set(found) == {licenses.UNKNOWN}


def test_two_notices_after_each_other(licence_model):
    assert families("Released under the MIT License.\nLicensed under CC BY-NC 4.0.",
                    licence_model) == ["mit", "cc-by-nc"]


def test_plain_texts_have_no_licences(spark):
    """Labelled good documents of the table without a word of a notice."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = docs.where("not text rlike '(?i)licen[sc]e|copyright|rights reserved|permission'")
    found = licenses.scan(clean, licenses.train(docs))
    assert found.count() <= 0.01 * clean.count()
