"""Ordered work inside groups that may be very large.

``row_number`` and running sums need one sorted pass per group. A plain window
sends a whole group to one task, which breaks down once a single key holds a
large share of the rows. Here such keys are found first (a map-side combined count
per bucket of keys, then per key of the buckets that are large enough to hold one),
and only their rows are range-partitioned by (key, order) into slices. Every slice
is then numbered on its own and shifted by the totals of the slices before it.
Without hot keys the plan is one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import reliable_checkpoint

SLICE = "_slice"
DEFAULT_ROWS = 2_000_000
BROADCAST_ROWS = 1_000_000
#: Rows that a task sorts, if more tasks than the session's partitions can keep it to that.
TASK_ROWS = 1_000_000
#: Buckets of keys that are counted before keys are.
BUCKETS = 1 << 16


def rows_per_group(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("lectern.hotGroupRows", str(DEFAULT_ROWS)))


def small(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count has been checked."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def dealt(frame: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """The frame by its keys in tasks of some ``TASK_ROWS`` rows, if it has up to ``rows`` rows.

    Left as it is where the session's shuffle partitions are enough, or nothing is known.
    """
    tasks = -(-(rows or 0) // TASK_ROWS)
    enough = tasks <= int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame if enough else frame.repartition(tasks, *keys)


def _hot_keys(frame: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys of more than ``limit`` rows with their ``_rows``, or None if there are none.

    The buckets are so few that counting them takes no memory, whatever the number of keys.
    """
    dealt_rows = frame.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    large = [row["_bucket"] for row in dealt_rows.groupBy("_bucket").agg(
        F.count("*").alias("_rows")).where(F.col("_rows") > limit).select("_bucket").collect()]
    if not large:
        return None
    within = frame.sparkSession.createDataFrame([(x,) for x in large], "_bucket long")
    hot = reliable_checkpoint(
        dealt_rows.join(F.broadcast(within), "_bucket", "left_semi").groupBy(*keys)
        .agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit))
    return None if hot.isEmpty() else hot


def slice_hot_groups(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], at_most: int | None = None
) -> tuple[DataFrame, int]:
    """Add ``_slice`` so that (keys, _slice) is bounded and slices follow ``order``.

    Also gives a bound of the number of (key, slice) of hot keys, 0 if none is hot.

    ``at_most`` is a known upper bound of the row count; it saves counting the frame
    where no group can be hot anyway. Many rows are dealt into tasks of bounded size.

    Slice 0 holds the keys of normal size. The slice of a row of a hot key is the
    number of its range partition, fixed by a reliable checkpoint because range
    bounds are sampled anew each time a plan is run.
    """
    limit = rows_per_group(frame)
    plain = frame.withColumn(SLICE, F.lit(0))
    rows = frame.count() if at_most is None else at_most
    hot = _hot_keys(frame, keys, limit) if rows > limit else None
    if hot is None:
        return dealt(plain, keys, rows), 0
    hot_keys, hot_rows = hot.agg(F.count("*"), F.sum("_rows")).first()
    marker = small(hot.select(*keys), hot_keys)  # no more than rows / limit keys
    slices = max(2, 2 * hot_rows // limit)
    heavy = (
        frame.join(marker, list(keys), "left_semi")
        .repartitionByRange(slices, *keys, *order)
        .withColumn(SLICE, F.spark_partition_id() + 1)
    )
    cold = frame.join(marker, list(keys), "left_anti").withColumn(SLICE, F.lit(0))
    together = cold.unionByName(reliable_checkpoint(heavy))
    return dealt(together, [*keys, SLICE], rows), slices + hot_keys


def running(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    number: str | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Running sums before each row (``sums``) and a row number from 1 (``number``).

    A sum leaves out the row itself: it is the total of all earlier rows.
    """
    sliced, hot = slice_hot_groups(frame, keys, order, at_most)
    group = [*keys, SLICE] if hot else list(keys)
    ordered = Window.partitionBy(*group).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    totals = {name: F.sum(value) for name, value in sums.items()}
    columns = {
        name: F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long")
        for name, value in sums.items()
    }
    if number:
        columns[number] = F.row_number().over(ordered).cast("long")
        totals[number] = F.count("*")
    result = sliced.withColumns(columns)
    if not hot:
        return result.drop(SLICE)
    # One row per hot key and slice: no more than slices + hot keys rows.
    earlier = (
        Window.partitionBy(*keys).orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = (
        sliced.where(F.col(SLICE) > 0).groupBy(*keys, SLICE)
        .agg(*[value.alias(f"_{name}") for name, value in totals.items()])
        .select(*keys, SLICE, *[
            F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}")
            for name in totals
        ])
    )
    shifted = result.join(small(base, hot), [*keys, SLICE], "left").withColumns({
        name: F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0)) for name in totals
    })
    return shifted.drop(SLICE, *[f"_{name}" for name in totals])


def numbered(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
    at_most: int | None = None,
) -> DataFrame:
    """Row number from 1 inside each group, safe for hot groups."""
    return running(frame, keys, order, {}, number=name, at_most=at_most)
