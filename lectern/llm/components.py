"""Connected components by alternating large and small stars.

Every step is a minimum per node and a join with it, both on one shuffle of the links.
Where the links are many, a node's are cut into slices for the join, so that no node is
one task's work. Rounds are fixed by reliable checkpoints; about log(length of the longest
path) of them are needed.

Links of a node with itself and repeated links do not count; nulls are not nodes. No links give
no rows. Ends are numbers, so texts of any length stay outside, and other columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import reliable_checkpoint

#: Links of one node that a task may join.
SLICE_ROWS = 1_000_000
PARTITION_ROWS = 100_000


def _with_least(links: DataFrame, slices: int) -> DataFrame:
    """Links (u, v) with the least of u and its neighbours."""
    if slices == 1:
        shared = links.repartition("u")
        return shared.join(shared.groupBy("u").agg(F.min("v").alias("least")), "u").withColumn(
            "least", F.least("u", "least"))
    least = links.groupBy("u").agg(F.min("v").alias("least")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return links.withColumn(
        "slice", F.coalesce(F.pmod(F.xxhash64("v"), F.lit(slices)).cast("int"), F.lit(0))).join(
            least, ["u", "slice"]).withColumn("least", F.least("u", "least"))


def components(links: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(node, root) of every linked node; links are (u, v) numbers, root is the least node."""
    links = reliable_checkpoint(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v").distinct())
    seen = None
    while True:
        count, mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if count == 0 or (count, mark) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select("v", "v").distinct())
        seen = count, mark
        slices = 1 + count // slice_rows
        links = links.coalesce(1 + count // PARTITION_ROWS)
        large = _with_least(links.union(links.select("v", "u")), slices).where("v > u").select(
            F.col("v").alias("u"), F.col("least").alias("v"))
        small = _with_least(large, slices).select(
            F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
        links = reliable_checkpoint(small.where("u <> v").distinct())
