"""Looking rows up in a table of groups some of which are very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A group with more than this share of all rows is cut, so at most so many are.
CUT_GROUPS = 100_000
LEAST_CUT = 1_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows (with doc_id) to groups by ``key``, hot keys cut into slices.

    ``size`` is the number of rows of a key and ``total`` that of all rows. Groups of more
    than ``total / CUT_GROUPS`` rows are cut; there are at most ``CUT_GROUPS`` of them, so
    their list is broadcast. A slice holds the rows of a part of the doc_ids; the column
    ``slice`` stays, and (key, slice) stays together.
    """
    limit = max(LEAST_CUT, total // CUT_GROUPS)
    cuts = F.ceil(F.col(size) / limit).cast("int")
    cut = groups.where(F.col(size) > limit).select(key, cuts.alias("slices"))
    copies = groups.withColumn("slice", F.explode(F.sequence(
        F.lit(0), F.greatest(cuts, F.lit(1)) - 1)))
    placed = rows.join(F.broadcast(cut), key, "left").withColumn("slice", F.coalesce(
        F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1))).cast("int"), F.lit(0)))
    return placed.drop("slices").join(copies, [key, "slice"], "left")


def first_of_repeats(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """One of the rows with equal (key, slice): the least by its own columns in ``row``.

    Works on the join's partitions as they are.
    """
    own: list[Column] = [F.col("row").getField(field.name) for field in schema
                         if not isinstance(field.dataType, T.MapType)]
    place = F.row_number().over(Window.partitionBy(key, "slice").orderBy("doc_id", *own))
    return rows.withColumn("place", place).where("place = 1")
