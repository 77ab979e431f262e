"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch of texts that goes to a Python worker, and bytes of text in one that leaves.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: ASCII white space as a class of a regular expression.
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def present(text: Column) -> Column:
    """A text, or the empty one for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def packed(rows: DataFrame) -> Column:
    """All columns of ``rows`` in one struct, so that no name can clash with later ones."""
    return F.struct(*[F.col(f"`{name}`") for name in rows.columns]).alias("row")


def small_batches(spark: SparkSession) -> None:
    """Texts are larger than the rows that Spark's default batch is meant for."""
    if int(spark.conf.get(_ROWS)) > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have some ``BATCH_BYTES``, or are single."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")])
        group = np.cumsum(sizes) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)
