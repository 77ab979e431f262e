"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from helpers import SMALL, clashing, documents, prose, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import exact_dedup, simhash
from lectern.llm.components import components


def test_exact_report(spark):
    docs = documents(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    wanted = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        wanted += [(i, keep, len(ids), i == keep, digest) for i in ids]
    assert rows_of(exact_dedup.dedup_report(docs)) == sorted(wanted, key=repr)
    assert rows_of(exact_dedup.dedup_report(clashing(docs))) == sorted(wanted, key=repr)
    assert exact_dedup.dedup_report(docs.limit(0)).count() == 0


def test_one_row_of_each_text_stays(spark):
    docs = clashing(documents(spark))
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    every = {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()}
    assert len(texts) == len(set(texts)) and set(texts) == every
    assert {r["doc_id"] for r in kept.where("text like 'same%'").collect()} == {5}


def test_equal_digests_do_not_merge_texts(spark):
    docs = documents(spark)
    with pytest.raises(Exception):  # whichever job meets them first
        exact_dedup.dedup_report(docs, digest=lambda text: F.lit("x")).collect()


def test_a_hot_text(spark):
    docs = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    docs = docs.toDF("doc_id", "text").repartition(16)
    found = exact_dedup.dedup_report(docs).where("group_size > 1").collect()
    assert len(found) == 300 and {r["keep_id"] for r in found} == {0}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    spans = [words[i:i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    for text in ["", None, "one", "Ab cD ÄÖ x y z", prose(1, 300), "a  b\tc\nd", prose(5, 70_000)]:
        assert simhash.fingerprint_of(text) & (1 << 64) - 1 == _fingerprint(text)


def test_near_report(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = [_fingerprint(r["text"]) for r in rows]
    roots = _roots([(i, j) for i in range(len(rows)) for j in range(i)
                    if bin(prints[i] ^ prints[j]).count("1") <= 4], range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        known = least.get(roots[i])
        if r["doc_id"] is not None and (known is None or r["doc_id"] < known):
            least[roots[i]] = r["doc_id"]
    wanted = sorted(((r["doc_id"], f"{prints[i]:016x}", least.get(roots[i]))
                     for i, r in enumerate(rows)), key=repr)
    assert rows_of(simhash.near_report(docs)) == wanted
    assert rows_of(simhash.near_report(clashing(docs))) == wanted
    assert simhash.near_report(docs.limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = clashing(documents(spark))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    report = simhash.near_report(documents(spark)).select("component_id").distinct()
    assert kept.where("doc_id is not null").count() == report.where(
        "component_id is not null").count()


@pytest.mark.parametrize("number", [6, 7, 8])
def test_links_of_clusters(spark, monkeypatch, number):
    """Chains and crowded clusters of fingerprints, for several numbers of blocks."""
    draw = random.Random(number)
    prints = {draw.getrandbits(64) for _ in range(40)}
    for _ in range(3):
        centre = draw.getrandbits(64)
        for _ in range(120):
            flipped = centre
            for bit in draw.sample(range(64), draw.randrange(0, 6)):
                flipped ^= 1 << bit
            prints.add(flipped)
    for _ in range(3):
        at = draw.getrandbits(64)
        for _ in range(12):
            for bit in draw.sample(range(64), 4):
                at ^= 1 << bit
            prints.add(at)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    ordered = sorted(signed)
    mask = (1 << 64) - 1
    wanted = _roots([(a, b) for a in ordered for b in ordered if a < b
                     and bin((a ^ b) & mask).count("1") <= 4], ordered)
    chosen = simhash.blocks(2 ** (64 * (number - 4) // number) // 4)
    monkeypatch.setattr(simhash, "blocks", lambda count, distance: chosen)
    found = simhash.near_components(spark.createDataFrame([(p,) for p in signed], "fp long"))
    groups = defaultdict(set)
    for r in found.collect():
        groups[r["root"]].add(r["fp"])
    expected = defaultdict(set)
    for node, root in wanted.items():
        expected[root].add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
def test_components(spark, slice_rows):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    links += [(i, i + 1) for i in range(1000, 1060)]
    links += [(2000 + 7 * k % 500, 2000) for k in range(100)]
    wanted = _roots(links, {x for pair in links for x in pair})
    linked = {x for a, b in links if a != b for x in (a, b)}
    frame = spark.createDataFrame(links, "u long, v long")
    found = components(frame, slice_rows).collect()
    assert {(r["node"], r["root"]) for r in found} == {(n, wanted[n]) for n in linked}
    assert components(frame.limit(0)).count() == 0


def _five_word_runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_the_stage_reaches_similarity(spark):
    """Copies with words changed here and there, at similarities around 0.8."""
    draw = random.Random(8)
    texts = [None, "", "a b", "A  b", "a b c"]
    for seed in range(40):
        words = prose(500 + seed, draw.randrange(60, 400)).split()
        texts.append(" ".join(words))
        for _ in range(draw.choice([1, 1, 6])):
            changed = list(words)
            for _ in range(draw.randrange(1, 2 + len(words) // 40)):
                changed[draw.randrange(len(words))] = f"new{draw.random()}"
            texts.append(" ".join(changed))
    runs = [_five_word_runs(t) for t in texts]
    roots = _roots([(i, j) for i in range(len(runs)) for j in range(i)
                    if 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j])],
                   range(len(runs)))
    assert len(set(roots.values())) < len(runs) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.no_near_copies(spark, clashing(docs), SMALL)
    assert kept.columns == clashing(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
