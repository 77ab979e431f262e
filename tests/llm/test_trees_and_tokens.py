"""Tokenizer spans, language profiles and the Merkle manifest against plain Python."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers import SMALL, clashing, documents, prose, rows_of

from lectern.llm import QUERIES, merkle, rank_profiles, tokenizer_spans

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- two tokenizers -----------------------------------------------------------------------

TEXTS = [
    "", " ", "  two  blanks ", "a", "\n", "a \n b", "a\n \nb", "tabs\tand\r\nlines \t end ",
    "été naïve 😀👩‍👩‍👧 日本語のテキスト Ünïcode", "<|endoftext|> <s> </s> <0x41> <unk>", "▁ x▁y", " x 　 y",
    "\x1c.\x1c a\x1c b", "it's we'll DON'T 12345 6.78", "null\x00byte", "word" * 40 + " " + "é" * 200,
    " ".join(["again"] * 50), "   three", "a   b", "x\u0085 y  z", "é combining",
]


def ends_of(tokens):
    out, at = [], 0
    for token in tokens:
        at += len(token)
        out.append(at)
    return out


def whole_alignment(texts):
    """Texts encoded whole; per text None or (a, b, groups with their byte ends)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(BYTE_BPE)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=PIECES)
    letters = tokenizer_spans.byte_characters()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        whole = (" " + text).encode()
        encoding = first.encode(" " + text, add_special_tokens=False)
        a = encoding.ids
        a_tokens = [bytes(letters[c] for c in token) for token in encoding.tokens]
        b = second.encode(text, num_threads=1)
        b_tokens = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k)
                    else second.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(a_tokens) != whole or b"".join(b_tokens) != whole:
            out.append(None)
            continue
        a_ends, b_ends = ends_of(a_tokens), ends_of(b_tokens)
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((end, a[i:p], b[j:q]))
            i, j = p, q
        out.append((a, b, groups))
    return out


def wanted_alignment(rows):
    found = whole_alignment([text for _, text in rows])
    counts = Counter((g[1][-1], g[2][-1]) for x in found if x for g in x[2])
    best = defaultdict(int)
    for (_, piece), n in counts.items():
        best[piece] = max(best[piece], n)
    out = []
    for (doc_id, _), x in zip(rows, found):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        own = [counts[g[1][-1], g[2][-1]] for g in x[2]]
        text = ";".join(f"{','.join(map(str, g[1]))}|{','.join(map(str, g[2]))}" for g in x[2])
        out.append((doc_id, len(x[0]), len(x[1]), len(x[2]), len(own), sum(
            n == best[g[2][-1]] for n, g in zip(own, x[2])), sum(own), sha(text)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [*enumerate(TEXTS), (None, None), (90, None), (91, prose(5, 4000)), (91, prose(5, 4000))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_alignment_equals_texts_encoded_whole(spark, texts):
    rows, docs = texts
    wanted = wanted_alignment(rows)
    assert rows_of(tokenizer_spans.alignment_report(docs, BYTE_BPE, PIECES)) == wanted
    assert any(row[-1] == "" and row[0] == TEXTS.index("▁ x▁y") for row in wanted)
    again = tokenizer_spans.alignment_report(clashing(docs), BYTE_BPE, PIECES)
    assert rows_of(again) == wanted
    assert tokenizer_spans.alignment_report(docs.limit(0), BYTE_BPE, PIECES).count() == 0


def test_alignment_query_over_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    wanted = wanted_alignment([tuple(row) for row in docs.collect()])
    assert rows_of(QUERIES["op11_tokenizer_spans"](spark, SMALL)) == wanted


def test_groups_cover_the_text(spark, texts):
    rows, docs = texts
    found = {row["doc_id"]: row["groups"] for row in tokenizer_spans.aligned(
        docs.where("doc_id is not null and doc_id < 90"), BYTE_BPE, PIECES).collect()}
    for (doc_id, text), wanted in zip(rows, whole_alignment(TEXTS)):
        got = [(g["end"], g["a"], g["b"]) for g in found[doc_id]]
        assert got == (wanted[2] if wanted else [])
        assert [g["start"] for g in found[doc_id]] == [0, *(g[0] for g in got)][:len(got)]


def test_pairs_are_bounded_by_the_vocabularies(spark):
    with open(BYTE_BPE, encoding="utf-8") as a, open(PIECES, "rb") as b:
        aligner = tokenizer_spans.Aligner(a.read(), b.read())
    assert aligner.cuts and aligner.bound() < 1_000_000


def test_remembered_words_do_not_change_others():
    with open(BYTE_BPE, encoding="utf-8") as a, open(PIECES, "rb") as b:
        aligner = tokenizer_spans.Aligner(a.read(), b.read())
    for _ in range(2):
        for text, wanted in zip(TEXTS, whole_alignment(TEXTS)):
            words = aligner.words(text)
            assert (words is None) == (wanted is None), text
            if wanted:
                assert b";".join(w.groups for w in words).decode() == ";".join(
                    f"{','.join(map(str, g[1]))}|{','.join(map(str, g[2]))}" for g in wanted[2])


# --- language profiles --------------------------------------------------------------------

def test_languages_are_told_apart_on_held_out_rows(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op12_rank_profiles"](spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"] for r in rows} == set(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.97 * len(held), (right, len(held))


def test_language_cases(spark):
    docs = documents(spark)
    found = rank_profiles.language_report(docs)
    by_id = defaultdict(list)
    for row in found.collect():
        by_id[row["doc_id"]].append(row)
    for doc_id in (1, 2, 3, 4):  # null, empty, blanks, an ideographic space
        assert [tuple(r)[2:] for r in by_id[doc_id]] == [("und", 0.0)]
    assert by_id[6][0] == by_id[6][1] and by_id[7][0]["lang_pred"] != "und"
    assert len(by_id[None]) == 2 and all(r["held_out"] for r in by_id[None])
    assert rows_of(rank_profiles.language_report(clashing(docs))) == rows_of(found)
    assert rank_profiles.language_report(docs.limit(0)).count() == 0
    untaught = rank_profiles.language_report(docs.where("doc_id = 20 or doc_id is null"))
    assert {r["lang_pred"] for r in untaught.collect()} <= {"en", "und"}
    none = rank_profiles.language_report(spark.createDataFrame(
        [(1, "some words", None)], "doc_id long, text string, lang string"))
    assert tuple(none.first())[2:] == ("und", 0.0)


def test_equal_distances_go_to_the_first_name(spark):
    rows = [(k, "same words here", lang) for k in range(40) for lang in ("zz", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r)[2:] for r in rank_profiles.language_report(docs).collect()} == {("aa", 0.0)}


def plain_grams(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        line = f" {word} "
        for n in (1, 2, 3):
            counts.update(line[k:k + n] for k in range(len(line) - n + 1))
    del counts[" "]
    return counts


@pytest.mark.parametrize("piece", [1 << 21, 7])
def test_grams_of_long_and_short_texts(monkeypatch, piece):
    monkeypatch.setattr(rank_profiles, "PIECE", piece)
    for text in (prose(1, 400), "a", "é b", "\U00020000x 1 y_z", "Ab-aB\ncd", "x"):
        codes, counts = rank_profiles.grams(rank_profiles.padded(text))
        found = {"".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c):
                 n for code, n in zip(codes.tolist(), counts.tolist())}
        assert found == dict(plain_grams(text))


# --- Merkle manifest ----------------------------------------------------------------------

def leaf(row, more=0):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"
    n = row["n_chars"]
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"],
                                   n if n is None else n + more, row["text"]))))


def tree(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[k:k + 2])) for k in range(0, len(low), 2)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        other = place ^ 1
        yield (other < place, level[other] if other < len(level) else "")
        place >>= 1


def wanted_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in groups[name]]) for name in names}
    high = tree([trees[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for place, row in enumerate(groups[name]):
            proof = [*siblings(trees[name], place), *siblings(high, number)]
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, int(hit))
            for left, other in proof:
                node = sha(other + node if left else node + other)
            out.append((row["doc_id"], leaf(row), trees[name][-1][0], high[-1][0],
                        sha("".join(x for _, x in proof)), node, node == high[-1][0]))
    return sorted(out, key=repr)


def test_manifest_cases(spark):
    docs = documents(spark)
    wanted = wanted_manifest(docs.collect())
    assert rows_of(merkle.proof_report(docs)) == wanted
    assert rows_of(merkle.proof_report(clashing(docs))) == wanted
    assert merkle.proof_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_manifest_of_many_blocks(spark, monkeypatch, bits):
    """Small blocks give several floors; results are those of one tree."""
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = [(k, f"text {k}", f"l{k % 5}" if k % 11 else None, "s", None if k % 3 else k)
            for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long")
    assert rows_of(merkle.proof_report(docs)) == wanted_manifest(docs.collect())


@pytest.mark.parametrize("count", [1, 2, 3, 5])
def test_small_manifests(spark, count):
    rows = [(k, "t", "en", None, 9223372036854775807) for k in range(count)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long")
    assert rows_of(merkle.proof_report(docs)) == wanted_manifest(docs.collect())


def test_versions_copy_only_ancestors(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = merkle.manifest(docs).where("changed is not null").collect()
    assert rows
    for row in rows:
        assert len(row["copied"]) == len(row["path"]) + 1 and row["copied"][0] == row["changed"]
        assert row["copied"][-1] != row["root"]
    nodes = merkle.version_nodes(merkle.manifest(docs))
    assert nodes.count() == sum(len(row["copied"]) for row in rows)
