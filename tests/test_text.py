"""Text functions: folding, guards, file names, keys, contracts."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx


def column(spark, values, make):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string").select("i", make(F.col("v")).alias("r"))
    return [row["r"] for row in sorted(frame.collect(), key=lambda r: r["i"])]


def test_simple_class_needs_no_unicode_work():
    pattern = re.compile(tx.SIMPLE_TEXT)
    for point in range(0x10000):
        char = chr(point)
        if 0xD800 <= point < 0xE000 or not pattern.match(char) or char == "ß":
            continue
        assert unicodedata.normalize("NFKC", char) == char
        assert char.casefold() == char.lower()
        assert not unicodedata.combining(char)


def test_fold_equals_the_full_fold(spark):
    random.seed(3)
    pool = "aZß ŉſÀéЁёЖ\u0301ΣςσİıﬁK①ⅣＡ½'-.«»…"
    texts = ["".join(random.choices(pool, k=random.randint(0, 12))) for _ in range(800)]
    wanted = [unicodedata.normalize("NFKC", t).casefold() for t in texts]
    assert column(spark, texts, tx.fold) == wanted


def test_comparison_form(spark):
    texts = ["Straße, 12%!", "замо\u0301к", "  ", "A\u00a0b--C"]
    assert column(spark, texts, tx.comparison_form) == ["strasse 12", "замо к", "", "a b c"]
    assert column(spark, texts[1:2], lambda c: tx.comparison_form(c, strip_marks=True)) == ["замок"]


def test_diagnostic_form_keeps_punctuation(spark):
    assert column(spark, ["  A,\n b! "], tx.diagnostic_form) == ["a, b!"]


def _verdicts(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "i int, a string, b string").select(
        "i", tx.rewrite_verdict(F.col("a"), F.col("b"), F.lit("why")).alias("v"))
    return [r["v"] for r in sorted(frame.collect())]


def test_marks_and_case_may_change_words_may_not(spark):
    """Random edits of punctuation and case pass; any lost, new or swapped word does not."""
    draw = random.Random(12)
    kept, broken = [], []
    for _ in range(150):
        words = [draw.choice(["mast", "keel", "ёрш", "rope", "17"]) + str(k)
                 for k in range(draw.randint(2, 8))]
        text = " ".join(words)
        moved = " ".join(draw.choice(["", "(", '"']) + draw.choice([w, w.upper()])
                         + draw.choice(["", ",", "!", "…"]) for w in words)
        kept.append((text, moved.replace("Ё", "Е").replace("ё", "е")))
        place = draw.randrange(len(words))
        broken.append((text, " ".join(draw.choice([
            words[:place] + words[place + 1:], words[:place] + ["new"] + words[place:],
            words[:place] + ["other"] + words[place + 1:]]))))
    assert set(_verdicts(spark, kept)) == {"accepted"}
    assert set(_verdicts(spark, broken)) == {"phrase_changed"}


def test_blank_rewrites_are_empty(spark):
    assert _verdicts(spark, [("mast and keel", ""), ("mast and keel", "   ")]) == ["empty_text"] * 2


def test_controls_must_survive(spark):
    for control in ("[soft]", "{slow}", "<beat>"):
        text = f"raise {control} anchor"
        assert _verdicts(spark, [(text, text + "!"), (text, f"lower {control} anchor")]) == [
            "accepted", "phrase_changed"]
        swapped = control.translate(str.maketrans("[]{}<>", "()()()"))
        # Angle brackets are symbols, which are part of the phrase.
        reason = "phrase_changed" if "<" in control else "controls_changed"
        assert _verdicts(spark, [(text, text.replace(control, swapped))]) == [reason]


def test_inline_controls_skip_open_brackets(spark):
    assert column(spark, ["a [b {c} <d> ] e {f", "<x><y>"], tx.inline_controls) == [
        ["[b {c} <d> ]"], ["<x>", "<y>"]]


def _file_names(spark, titles):
    frame = spark.createDataFrame([(i, 31, t) for i, t in enumerate(titles)],
                                  "i int, n int, t string")
    named = tx.with_file_name(frame, "n", "t", "file_name").orderBy("i")
    return [row["file_name"] for row in named.collect()]


def test_file_names_are_safe_whatever_the_title(spark):
    draw = random.Random(8)
    pool = "aZ9 ./\\<>:|?*\"\0\t\u200f\u202eЖ漢ﬁ."
    titles = ["".join(draw.choices(pool, k=draw.randint(0, 200))) for _ in range(400)]
    for name in _file_names(spark, titles):
        assert name.startswith("character_0031_") and name.endswith(".flac")
        assert len(name.encode()) <= 240
        stem = name.removeprefix("character_0031_").removesuffix(".flac")
        assert stem and stem == stem.strip(". ") and "  " not in stem
        assert not set(stem) & set('/\\<>:"|?*') and stem.isprintable()


def test_file_names_keep_plain_titles(spark):
    assert _file_names(spark, ["Salt and tin", "Ⅶ", "\u200f", ""]) == [
        "character_0031_Salt and tin.flac", "character_0031_VII.flac",
        "character_0031_Глава 31.flac", "character_0031_Глава 31.flac"]
    long = _file_names(spark, ["Ж" * 300])[0]
    assert set(long.removeprefix("character_0031_").removesuffix(".flac")) == {"Ж"}


def test_cut_between_characters(spark):
    frame = spark.createDataFrame([("aЯЯ", n) for n in range(6)], "t string, n int")
    found = [r[0] for r in frame.select(tx.cut_bytes(F.col("t"), F.col("n"))).collect()]
    assert found == ["", "a", "a", "aЯ", "aЯ", "aЯЯ"]


def test_keys_change_with_every_part(spark):
    frame = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", "c")], "x string, y string")
    keys = [r[0] for v in ("v1", "v2") for r in frame.select(
        tx.content_key(v, F.col("x"), F.col("y"))).collect()]
    assert len(set(keys)) == 6


def test_seeds(spark):
    import hashlib
    import hmac
    frame = spark.createDataFrame([("s", 1), ("s", 2)], "segment string, attempt int")
    found = [int(r[0]) for r in frame.select(tx.retry_seed(
        F.lit("job"), F.col("segment"), F.col("attempt"))).collect()]
    assert found == [int.from_bytes(hmac.new(
        b"job", f"s\0{n}".encode(), hashlib.sha256).digest()[:8], "big") for n in (1, 2)]


def test_seeds_of_different_attempts_differ(spark):
    frame = spark.createDataFrame([("1", "11"), ("11", "1"), ("111", "")], "s string, a string")
    found = [r[0] for r in frame.select(
        tx.retry_seed(F.lit("job"), F.col("s"), F.col("a"))).collect()]
    assert len(set(found)) == 3


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200])
def test_hmac_of_any_key(spark, size):
    import hashlib
    import hmac
    key = "kЖ~"[:size] + "x" * max(0, size - 3)
    found = spark.createDataFrame([(key, "message é")], "k string, m string").select(
        tx.hmac_sha256(F.col("k"), F.col("m"))).first()[0]
    assert found == hmac.new(key.encode(), "message é".encode(), hashlib.sha256).hexdigest()


GOOD = '{"rewritten_text": "a", "reason": "b"}'


@pytest.mark.parametrize("payload, wanted", [
    ({"rewritten_text": "a", "reason": "b"}, "ok"),
    ({"rewritten_text": "a", "reason": ""}, "OUTPUT_INVALID"),
    ({"rewritten_text": "a"}, "OUTPUT_INVALID"),
    ({"rewritten_text": "a", "reason": "b", "more": 1}, "OUTPUT_INVALID"),
    ({"rewritten_text": 5, "reason": "b"}, "OUTPUT_INVALID"),
    ({"rewritten_text": "a" * 11, "reason": "b"}, "OUTPUT_INVALID"),
    ("not json", "OUTPUT_INVALID"),
    (["a"], "OUTPUT_INVALID"),
    (None, "OUTPUT_INVALID"),
    ({"rewritten_text": "a", "reason": " \t\u00a0"}, "OUTPUT_INVALID"),
    (GOOD + " trailing", "OUTPUT_INVALID"), (GOOD + '{"x": 1}', "OUTPUT_INVALID"),
    (GOOD + ", 1", "OUTPUT_INVALID"), (GOOD + "]", "OUTPUT_INVALID"), (GOOD + " \n", "ok"),
])
def test_output_contract(spark, payload, wanted):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    assert column(spark, [text], lambda c: tx.output_contract(
        c, {"rewritten_text": 10, "reason": 10})) == [wanted]


def test_stage_limits(spark):
    texts = ["x " * 121, "y" * 4001, "z" * 8001, "ok"]
    found = column(spark, texts, lambda c: tx.stage_limits(
        tx.collapse_space(c), tx.word_count(tx.collapse_space(c))))
    assert found == [["speech_words"], ["speech_chars", "transcribe_chars"],
                     ["speech_chars", "transcribe_chars", "rewrite_chars"], []]
