"""Quality model, URL filter, mixing and sharding."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from helpers import SMALL, clashing, documents, rows_of
from pyspark.sql import functions as F

from lectern.llm import QUERIES, mixing, quality_model, sharding, url_filter
from lectern.llm.queries import RULES, SHARDS, TARGETS

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    scores = QUERIES["op9_quality_model"](spark, MIDDLE)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 100 and right / len(rows) >= 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(
        quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality_model.quality_scores(docs, labels)) == rows_of(
        quality_model.quality_scores(docs, turned))


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(20, 60)] + [(None, 1), (2, None), (20, 0)],
        "doc_id long, quality int")
    found = quality_model.quality_scores(clashing(docs), labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    none = quality_model.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = quality_model.quality_scores(docs, labels.where("quality = 1")).collect()
    assert all(r["score"] > 0.5 for r in one)
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0


def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(3)
    rows = [np.array([0, 1, 2]) for _ in range(60)]
    values = [draw.normal(size=3) for _ in rows]
    signs = np.array([1.0 if v[0] + 0.3 * v[1] > 0.2 else -1.0 for v in values])
    weights = quality_model.descend(rows, values, signs, cost=1.0, passes=300)

    def loss(w):
        return 0.5 * (w @ w) + sum(max(0, 1 - y * (v @ w[:3] + w[3]))
                                   for v, y in zip(values, signs))

    own = np.append(weights[:3], weights[-1])
    assert all(loss(own) <= loss(own + step) + 1e-3
               for step in draw.normal(scale=0.05, size=(500, 4)))


def test_hosts_paths_and_rules(spark):
    urls = [None, "no scheme", "HTTP://A.Example.ORG/es/x?y#z", "x://h?q/p", "a://b://c/d",
            "http://org/", "http://notorg/", "http://org", "http://www.example.org/en/12",
            "https://x.com/fr/1", "https://x.com/de/1", "http://ÄB.com/de/", "s://h\n/p\n#"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(
        clashing(pages).withColumn("host", F.lit("own")), RULES).collect()}
    assert [(found[i]["host"], found[i]["path"]) for i in range(len(urls))] == [
        ("", ""), ("", ""), ("a.example.org", "/es/x"), ("h", ""), ("b:", "//c/d"),
        ("org", "/"), ("notorg", "/"), ("org", ""), ("www.example.org", "/en/12"),
        ("x.com", "/fr/1"), ("x.com", "/de/1"), ("Äb.com", "/de/"), ("h\n", "/p\n")]
    assert [found[i]["rule"] for i in (2, 5, 6, 7, 8, 9, 10, 11)] == [
        "example.org/es/", "org/", None, None, "example.org/en/1", "com/fr/", "com/de/", "com/de/"]
    assert [found[i]["verdict"] for i in (0, 2, 5, 8, 9, 10)] == [
        "allow", "block", "allow", "block", "allow", "block"]
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_language_models_add_up_and_tell_apart(spark):
    counts = np.random.default_rng(1).integers(0, 3, (url_filter.SYMBOLS,) * 4)
    logs = url_filter.log_probabilities(counts).reshape(-1, url_filter.SYMBOLS)
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    good = [f"http://a{i}.org/news/{i}" for i in range(300)]
    bad = [f"http://b{i}.org/casino/{i}" for i in range(300)]
    open_ = ["http://x.net/casino/5", "http://x.net/news/5"]
    pages = spark.createDataFrame(list(enumerate(good + bad + open_)), "page_id long, url string")
    rules = [url_filter.Rule.parse("allow", "org/news"), url_filter.Rule.parse(
        "block", "org/casino")]
    found = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert found[600]["score"] > 0 > found[601]["score"]
    assert found[601]["verdict"] == "allow"


def test_urls_like_rejected_ones_are_blocked(spark):
    draw = np.random.default_rng(6)

    def word():
        return "".join(draw.choice(list("aeioustnrl"), draw.integers(3, 9)))

    good = [f"http://a{i}.org/news/1/{word()}/{i}" for i in range(600)]
    bad = [f"http://b{i}.org/casino/1/{word()}/{i}" for i in range(600)]
    like_bad = [f"http://b{i}.org/casino/2/{word()}/{i}" for i in range(500, 600)]
    like_good = [f"http://a{i}.org/news/2/{word()}/{i}" for i in range(500, 600)]
    unlike = [f"http://{k}x-{k}q--{k}zz.kk/{k}wq%7Cjj_{k}/xx!{k}vv" for k in range(100)]
    queries = ["http://h.kk/v", "http://h.kk/v?casino=casino#casino"]
    urls = good + bad + like_bad + like_good + unlike + queries
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.Rule.parse("allow", "org/news/1/"), url_filter.Rule.parse(
        "block", "org/casino/1/")]
    found = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}

    def blocked(start):
        return sum(found[i]["verdict"] == "block" for i in range(start, start + 100))

    assert blocked(1200) >= 90 and blocked(1300) <= 1 and blocked(1400) == 0
    assert found[1501]["score"] > found[1500]["score"]


def test_raking_meets_the_targets():
    draw = np.random.default_rng(2)
    cells = {(s, lang, t): float(draw.integers(1, 1000)) for s in "abc" for lang in "de"
             for t in ("x", "other")}
    targets = mixing.Targets(source={"a": 0.5, "b": 0.3, "c": 0.2}, lang={"d": 0.25},
                             topic={"x": None})
    factors = mixing.rake(cells, targets)
    total = sum(cells.values())

    def share(side, value):
        return sum(n * factors[c] for c, n in cells.items() if c[side] == value) / total

    assert [round(share(0, v), 6) for v in "abc"] == [0.5, 0.3, 0.2]
    assert round(share(1, "d"), 6) == 0.25
    assert round(share(2, "x"), 6) == round(
        sum(n for c, n in cells.items() if c[2] == "x") / total, 6)
    assert mixing.rake({}, targets) == {}


def test_sample(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    targets = mixing.Targets(lang={"en": 0.4, "de": 0.3, "fr": 0.3}, marks=TARGETS.marks)
    report = mixing.mix_report(docs, targets).collect()
    assert len(report) == docs.count()
    expected, by_lang = 0.0, {}
    for r in report:
        expected += r["tokens"] * r["probability"]
        by_lang[r["lang"]] = by_lang.get(r["lang"], 0) + r["tokens"] * r["probability"]
        assert r["kept"] == (r["draw"] < r["probability"])
    assert abs(by_lang["de"] / expected - 0.3) < 1e-6
    kept = mixing.sample(clashing(docs), targets)
    assert kept.columns == clashing(docs).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in report if r["kept"]}


def test_mixing_odd_rows(spark):
    docs = documents(spark)
    report = mixing.mix_report(clashing(docs), TARGETS)
    assert report.count() == docs.count()
    assert report.where("probability is null or draw is null or kept is null").count() == 0
    assert mixing.mix_report(docs.limit(0), TARGETS).count() == 0


def wanted_mix(rows, temper):
    """Probabilities by raking plain dictionaries; sources and languages as they come."""
    def topic(text):
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        return next((name for name, marks in TARGETS.marks.items()
                     if any(mark in lower for mark in marks)), mixing.OTHER)

    cells = {}
    for r in rows:
        text = r["text"] or ""
        cell = (r["source"] or mixing.OTHER, r["lang"] or mixing.OTHER, topic(text))
        cells.setdefault(cell, []).append(
            (r["doc_id"], len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])))
    size = {cell: sum(n for _, n in found) for cell, found in cells.items()}
    goals = []
    for side in range(3):
        sums = {}
        for cell, n in size.items():
            sums[cell[side]] = sums.get(cell[side], 0) + n
        bent = {v: n ** (temper if side == 0 else 1) for v, n in sums.items()}
        goals.append({v: x / sum(bent.values()) * sum(sums.values()) for v, x in bent.items()})
    factor = dict.fromkeys((cell for cell in cells if size[cell]), 1.0)
    for _ in range(mixing.ROUNDS):
        for side in range(3):
            for value, goal in goals[side].items():
                now = sum(size[c] * f for c, f in factor.items() if c[side] == value)
                for c in factor:
                    if c[side] == value and now:
                        factor[c] *= goal / now
    most = max(factor.values())
    return {doc_id: factor.get(cell, most) / most
            for cell, found in cells.items() for doc_id, _ in found}


def test_mixing_query_against_plain_raking(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    wanted = wanted_mix(docs, TARGETS.temper["source"])
    found = {r["doc_id"]: r["probability"] for r in QUERIES["op6_mixing"](spark, SMALL).collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)


def test_sources_that_nobody_named_are_mixed(spark):
    """A hot source of any name is brought down against small ones."""
    rows = [(k, "word " * 20, "hot" if k % 3 else f"small {k % 30}", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    report = mixing.mix_report(docs, TARGETS).collect()
    chance = {r["source"]: r["probability"] for r in report}
    assert len(chance) == 11 and chance["hot"] < 0.5
    assert all(abs(p - 1) < 1e-6 for source, p in chance.items() if source != "hot")


def test_rare_values_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_VALUES", 2)
    docs = spark.createDataFrame([(k, "a b", "xxxyyz"[k % 6], None) for k in range(60)],
                                 "doc_id long, text string, source string, lang string")
    assert set(mixing.named(docs, TARGETS).source) == {"x", "y"}
    assert mixing.mix_report(docs, TARGETS).count() == 60


def shard_by_hand(key, weights):
    def score(k, weight):
        number = int(hashlib.md5(f"{key}/{k}".encode()).hexdigest()[:sharding.DIGITS], 16)
        return math.log((number + 0.5) / 2 ** 52) / weight
    return max(range(len(weights)), key=lambda k: (score(k, weights[k]), -k))


@pytest.mark.parametrize("weights", [[1.0] * SHARDS, [1.0, 2.0, 0.5]])
def test_shards_by_hand(spark, weights):
    """Shards, shards after one more, and slots of every document."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = (QUERIES["op3_sharding"](spark, SMALL) if len(weights) == SHARDS
            else sharding.shard_report(docs, weights)).collect()
    texts = {str(r["doc_id"]): (r["text"] or "").encode() for r in docs.collect()}
    places = {}
    for r in rows:
        key = str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (
            shard_by_hand(key, weights), shard_by_hand(key, [*weights, 1.0]))
        assert (r["size"], r["text_crc32"]) == (len(texts[key]) + 1, zlib.crc32(texts[key]))
        part = int(hashlib.md5(key.encode()).hexdigest()[:sharding.DIGITS], 16) % sharding.SLICES
        places.setdefault(r["shard"], []).append((part, key, r["slot"]))
    for found in places.values():
        assert [slot for _, _, slot in sorted(found)] == list(range(len(found)))


@pytest.mark.parametrize("weights", [[1.0] * 4, [1.0, 3.0]])
def test_shards(spark, weights):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_report(docs, weights).collect()
    for shard, weight in enumerate(weights):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
        assert abs(len(slots) / 4000 - weight / sum(weights)) < 0.03
    moved = {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]}
    assert moved == {len(weights)}


def test_shards_of_odd_rows(spark, tmp_path):
    docs = documents(spark)
    rows = sharding.shard_report(clashing(docs), [1.0] * 3).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            data = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.shard_report(docs.limit(0), [1.0]).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, [1.0] * 3, path)
    assert spark.read.parquet(path).count() == docs.count()
