"""Pluggable inference: the caller's model runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]

#: Rows that a model is given at once, whatever the size of an Arrow batch.
BATCH_ROWS = 1_000


def infer(
    frame: DataFrame,
    loader: Callable[[], Model],
    results: str,
    group: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """Add the model's result columns and ``error`` to every row.

    ``loader`` is called once per task and returns a function from a batch of rows to
    a frame of their results in the same order. If a batch fails its halves are tried, down to
    single rows; one that fails alone keeps NULL results and the message, and the job goes on.
    Batches are given out one by one and hold ``BATCH_ROWS`` rows at most.
    ``group`` (a voice, say) brings equal values together in as many partitions as the
    session shuffles to, salted so that a frequent one is spread over ``salts`` of them.
    How many models work at once is the cluster's number of task slots.
    """
    columns = frame.columns
    names = [part.strip().split()[0] for part in results.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()

        def answered(rows: pd.DataFrame) -> pd.DataFrame:
            produced = model(rows)
            return rows.assign(
                **{name: produced[name].to_numpy() for name in names}, error=None)

        def halved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                yield answered(rows)
                return
            except Exception as problem:  # a bad row must not stop the job
                error = f"{type(problem).__name__}: {problem}"
            if len(rows) == 1:
                yield rows.assign(**dict.fromkeys(names), error=error)
                return
            middle = len(rows) // 2
            yield from halved(rows.iloc[:middle])
            yield from halved(rows.iloc[middle:])

        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                parts = list(halved(batch.iloc[start:start + BATCH_ROWS]))
                yield pd.concat([part.astype(object) for part in parts])[
                    [*columns, *names, "error"]] if len(parts) > 1 else (
                        parts[0][[*columns, *names, "error"]])

    spread = frame
    if group:
        salt = F.pmod(F.xxhash64(*columns), F.lit(salts))
        spread = (frame.withColumn("_salt", salt).repartition(group, "_salt")
                  .sortWithinPartitions(group).drop("_salt"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return spread.mapInPandas(run, f"{fields}, {results}, error string")


def prompt_messages(instruction: str, intro: str, fields: dict[str, Column]) -> Column:
    """Chat messages as JSON: fixed instruction, then a closed object of untrusted fields."""
    payload = F.to_json(F.struct(*[
        F.coalesce(value.cast("string"), F.lit("")).alias(name)
        for name, value in fields.items()]))
    return F.to_json(F.array(
        F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.lit(intro), payload).alias("content"))))
