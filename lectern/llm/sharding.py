"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a key, uniform between 0 and 1 from an MD5 digest of key and
shard, and the shard with the largest ``ln(draw) / weight`` gets the record. A new shard
only wins records and no others move; a shard of double weight gets twice as many.

Slots number a shard's rows without gaps. Rows are cut into ``SLICES`` slices per shard by
their key, numbered within (shard, slice), and shifted by the rows of the slices before, so
no task sees a whole shard. The offsets are shards x ``SLICES`` numbers at most and are
broadcast.

The key is doc_id as text, null: empty. A null text has no bytes and the CRC of nothing.
Rows that repeat a doc_id go to the same shard in different slots. Empty tables give empty
results; texts are never shuffled by ``shard_report``. Extra columns pass ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.columns import present

SLICES = 1024
#: Hex digits of a digest that become a draw: 52 bits, exact in a double.
DIGITS = 13


def _number(text: Column) -> Column:
    digest = F.md5(F.encode(text, "UTF-8"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the key; a tie goes to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")

    def score(shard: int, weight: float) -> Column:
        draw = (_number(F.concat(key, F.lit(f"/{shard}"))) + F.lit(0.5)) / F.lit(2.0 ** 52)
        return F.struct((F.ln(draw) / F.lit(float(weight))).alias("score"),
                        F.lit(-shard).alias("minus"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["minus"]


def slotted(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """Adds ``slot`` to rows with key, doc_id, shard, size and text_crc32."""
    part = F.when(F.col("key") == "", F.pmod(F.col("text_crc32"), F.lit(slices))).otherwise(
        F.pmod(_number(F.col("key")), F.lit(slices)))
    sliced = rows.withColumn("part", part.cast("int"))
    counts = sliced.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0))
                            .alias("offset"))  # at most shards x slices rows
    own = Window.partitionBy("shard", "part").orderBy("key", "size", "text_crc32")
    return (sliced.withColumn("place", F.row_number().over(own))
            .join(F.broadcast(offsets), ["shard", "part"])
            .withColumn("slot", F.col("offset") + F.col("place") - 1)
            .drop("part", "place", "offset"))


def shard_report(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row per document: its shard, slot, and its shard with one more of weight 1."""
    text, key = present(F.col("text")), key_of(F.col("doc_id"))
    rows = docs.select(
        "doc_id", key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, 1.0]).alias("grown_shard"))
    return slotted(rows).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, files: int = 8) -> None:
    """Writes the documents below ``path``, in folders ``shard=i`` of ``files`` files at most."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    key = key_of(F.col("doc_id"))
    (docs.withColumn(name, shard_of(key, weights))
     .repartition(files * len(weights), name, F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
     .write.partitionBy(name).parquet(path))
