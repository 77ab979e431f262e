"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified distances.

Fingerprint: one 64-bit XXH64 (seed 42) per shingle of ``WIDTH`` words, repeats included;
a bit is set where more than half of the hashes set it. Texts without words have the
fingerprint zero and are linked like any other.

Pairs: cut into ``b`` blocks, two fingerprints that differ in at most ``DISTANCE`` bits
agree in some ``b - DISTANCE`` blocks at least. Each distinct fingerprint goes to one bucket
per choice of blocks. ``b`` is the least number for which chance seldom fills a bucket
twice, so candidates grow with the input; any ``b`` gives the same links.

Crowded buckets (many near copies) are not paired off. First every member is compared
with two members drawn by hash, and the links found make preliminary components. Then only
members outside their bucket's main component are compared with the others, and only
across components. No link between components is lost and none within one is listed.

Copies count once: all work is on distinct fingerprints. Null texts count as empty. A null
doc_id is larger than any number. Rows that repeat a doc_id get the same component.
``keep_one`` leaves one row of a component: the least by doc_id, then by its other columns.
Empty tables give empty results; very long texts are hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.columns import packed
from lectern.llm.components import components
from lectern.llm.lookup import first_of_repeats, with_groups
from lectern.session import reliable_checkpoint

WIDTH = 4
DISTANCE = 4
PIECE = 1 << 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().translate(LOWER).split()  # splits at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(width, len(words))
    starts, ends = starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), PIECE):
        part = list(zip(starts[k:k + PIECE], ends[k:k + PIECE]))
        hashes = np.fromiter((digest(line[s:e], 42) for s, e in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(x.as_py()) for x in texts], pa.int64())


def blocks(count: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the bits that a bucket's members share, for ``count`` fingerprints."""
    number = distance + 2
    while number < 16 and 2 ** (64 * (number - distance) // number) < 2 * count:
        number += 1
    edges = [64 * k // number for k in range(number + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, number - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bucketed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    entries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
        for i, m in enumerate(masks)])).alias("b")
    return (nodes.select("*", entries).select(*nodes.columns, "b.choice", "b.bits")
            .repartition("choice", "bits"))


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def near_components(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of the distinct fingerprints ``nodes`` that have a link."""
    masks = blocks(nodes.count(), distance)
    bucket = ["choice", "bits"]
    keyed = _bucketed(nodes.select("fp"), masks)
    order = F.xxhash64("fp", "choice")
    crowded = keyed.groupBy(*bucket).agg(
        F.count("*").alias("members"), F.min_by("fp", order).alias("first"),
        F.max_by("fp", order).alias("last")).where("members > 1")
    met = keyed.join(crowded, bucket)
    stars = (
        met.select("fp", F.explode(F.array("first", "last")).alias("other"))
        .where((F.col("fp") != F.col("other"))
               & _near(F.col("fp"), F.col("other"), distance))
        .select(F.col("fp").alias("u"), F.col("other").alias("v")))
    early = reliable_checkpoint(components(stars))

    named = nodes.select("fp").join(
        early.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"))
    rows = _bucketed(named, masks)
    mixed = (
        rows.groupBy(*bucket, "root").agg(F.count("*").alias("n"))
        .groupBy(*bucket).agg(F.count("*").alias("roots"), F.max_by("root", "n").alias("main"))
        .where("roots > 1").select(*bucket, "main"))
    rows = rows.join(mixed, bucket)
    strays = rows.where("root <> main").select(
        *bucket, F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    across = (
        rows.join(strays, bucket)
        .where((F.col("root") != F.col("root2")) & _near(F.col("fp"), F.col("fp2"), distance))
        .select(F.col("root").alias("u"), F.col("root2").alias("v")))
    late = components(across).select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = named.join(late, "root", "left").select(
        "fp", F.coalesce("top", "root").alias("root"))
    return reliable_checkpoint(final)


def near_groups(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Fingerprints in components of two rows or more.

    fp, its rows n, component_id, and keep_fp, that of the row that stays.
    """
    nodes = reliable_checkpoint(
        fingerprints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    return named_groups(nodes.join(near_components(nodes, distance), "fp"))


def named_groups(rooted: DataFrame) -> DataFrame:
    """The groups of rows (fp, doc_id, n, root) that have two rows or more."""
    tops = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("top"),
        F.sum("n").alias("members")).where("members > 1")
    return reliable_checkpoint(
        rooted.select("fp", "n", "root").join(tops, "root").select(
            "fp", "n", F.col("top.doc_id").alias("component_id"), F.col("top.fp").alias("keep_fp")))


def near_report(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = reliable_checkpoint(docs.select("doc_id", fingerprint("text").alias("fp")))
    found = near_groups(rows, distance)
    return with_groups(rows, found, "fp", "n", rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("keep_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, with its own columns.

    The fingerprints are taken twice rather than stored beside the texts.
    """
    rows = docs.select("doc_id", fingerprint("text").alias("fp"))
    return kept_rows(docs, fingerprint, near_groups(rows, distance))


def kept_rows(docs: DataFrame, key: Callable[[str], Column], groups: DataFrame) -> DataFrame:
    """The documents that stay; ``key`` gives a text's fp."""
    rows = docs.select(packed(docs), "doc_id", key("text").alias("fp"))
    return kept_of(rows, groups, docs.count(), docs.schema)


def kept_of(rows: DataFrame, groups: DataFrame, total: int, schema: T.StructType) -> DataFrame:
    """What stays of ``total`` rows (row, doc_id, fp)."""
    joined = with_groups(rows, groups, "fp", "n", total)
    stays = (F.col("fp") == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    alone = joined.withColumn("stays", F.col("keep_fp").isNull() | stays).where("stays")
    return first_of_repeats(alone, "fp", schema).select("row.*")
