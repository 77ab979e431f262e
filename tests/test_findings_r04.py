"""Cases of the fourth round's findings, under their numbers."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

import checking
from lectern.llm import near_copies
from lectern.llm.components import components
from lectern.plans import CHECKS, QUERIES

#: Texts without words, of scene breaks alone, and with characters that marking up changes.
ODD = [None, "", " ", " \r\n\t\n", " 　\n ", "\x01\x02\x1f", "\x85", "* * *",
       "* * *\n* * *\n", "a\r\nb\rc", "]]> & <p>", "one\x85two", "* * * x", "word\n\n\n\n\nlast"]


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    """Every odd text as a whole book, one without a body, a cut one and one without a title."""
    whole, numbers = iter(n for n in range(1, 2_000) if n % 29 and n % 31 and n % 4), []
    for k in range(len(ODD)):
        numbers += [next(whole), 29 * (k + 1), 31 * (k + 29), 4 * 29 * 31 * (k + 1) + 4]
    numbers += [100_001, 100_003, None]
    texts = [text for text in ODD for _ in range(4)] + ["x y"] * 3
    sources = ["src1"] * 4 * len(ODD) + [None, "a&b<c>", "src2"]
    path = tmp_path_factory.mktemp("odd")
    parquet.write_table(pa.table({
        "doc_id": pa.array(numbers, pa.int64()), "text": texts, "lang": ["en"] * len(texts),
        "source": sources, "n_chars": pa.array([len(x or "") for x in texts], pa.int64())}),
        f"{path}/documents.parquet")
    return str(path)


def differences(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return checking.differences(QUERIES[name](spark, folder), con, CHECKS[name])[0]


def test_f1_files_of_documents_without_words(spark, odd_documents):
    assert differences(spark, odd_documents, "fb2_files") is None


def test_f2_metadata_of_books_without_content(spark, odd_documents):
    assert differences(spark, odd_documents, "fb2_meta") is None


@pytest.mark.parametrize("name", ["fb2_rejects", "fb2_blocks", "fb2_chapters"])
def test_f3_books_without_content_are_no_rejects(spark, odd_documents, name):
    """F3, and the queries that share the step: a book of scene breaks alone has blocks."""
    assert differences(spark, odd_documents, name) is None


def _texts():
    """Families of copies with words changed, at similarities on both sides of 0.8; boilerplate."""
    draw = random.Random(4)

    def words(count):
        return ["".join(draw.choice("aeioustnrl") for _ in range(5)) for _ in range(count)]

    passage, texts = words(40), []
    for family in range(30):
        whole = words(draw.randrange(60, 300)) + passage * (family % 2)
        for _ in range(draw.choice([2, 3, 7])):
            copy = list(whole)
            for _ in range(draw.randrange(0, 2 + len(whole) // 40)):
                copy[draw.randrange(len(copy))] = f"new{draw.random()}"
            texts.append(" ".join(copy))
    return texts


def _links(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i)
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]


@pytest.mark.parametrize("common, most", [(20, 1 << 20), (3, 1 << 20), (3, 5)])
def test_f4_no_link_rests_on_chance(spark, monkeypatch, common, most):
    """texts that share no band and no block of bits are still compared, whatever the order."""
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "MOST_COMMON", most)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone = F.transform("bands", lambda x: F.xxhash64(x, "fp"))
    rows = near_copies.sketched(docs).withColumns({"bands": alone, "print": F.xxhash64("fp")})
    sets = [set(near_copies.shingles_of(text).tolist()) for text in texts]
    links, least = _links(sets), list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    wanted = {i: k for i, k in enumerate(least) if least.count(k) > 1}
    assert len(set(wanted.values())) > 20
    found = rows.join(near_copies.near_groups(rows).select("fp", "component_id"), "fp")
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == wanted


def test_f4_simhash_blocks_give_candidates(spark):
    """without bands, copies within the distance of SimHash blocks are candidates."""
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone = F.transform("bands", lambda x: F.xxhash64(x, "fp"))
    rows = near_copies.sketched(docs).withColumn("bands", alone).distinct()
    nodes = rows.select("fp", "doc_id", "size", "print", "bands").dropDuplicates(["fp"])
    found = {frozenset(r) for r in near_copies._bucket_pairs(nodes).collect()}
    prints = {r["fp"]: r["print"] for r in nodes.collect()}
    for u, v in map(tuple, found):
        assert ((prints[u] ^ prints[v]) & (1 << 64) - 1).bit_count() <= near_copies.DISTANCE
    roots = {r["node"] for r in components(near_copies._bucket_pairs(nodes)).collect()}
    near = {x for x in prints for y in prints if x != y
            and ((prints[x] ^ prints[y]) & (1 << 64) - 1).bit_count() <= near_copies.DISTANCE}
    assert len(near) > 10 and roots <= near and 2 * len(roots) > len(near)


def test_f4_the_first_of_alike_sets_meet():
    draw = np.random.default_rng(3)
    for size in [*range(1, 30), 400]:
        own = np.unique(draw.integers(0, 1 << 63, size, np.uint64))
        known = own[::3]
        other = np.unique(np.append(own[len(own) // 5:], draw.integers(0, 1 << 63, 1, np.uint64)))
        ranks = draw.permutation(len(known)) + 1
        if 9 * len(np.intersect1d(own, other)) >= 4 * (len(own) + len(other)):
            assert len(np.intersect1d(near_copies.first_of(own, known, ranks),
                                      near_copies.first_of(other, known, ranks)))
        assert near_copies.prefix_width(len(own)) == len(own) - -(-4 * len(own) // 5) + 1
