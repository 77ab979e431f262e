"""Live versions of the batch jobs with Structured Streaming.

Every job has two parts. The stream keeps state for no longer than its delay, gives each
window, session or judged event out once, and gives out what came too late as rows of their
own. The batch step, over what the stream wrote and over the state that is still open, merges
the late rows: sums add up, sessions join, deliveries are looked up, and fragments with late
events are judged anew. Its result is that of a batch over all rows, in whatever order and in
however many batches they came, and only what late rows touch is worked on again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from lectern.operators.hot_groups import numbered
from lectern.operators.replay import replay, status_of
from lectern.session import new_folder, use_utc
from lectern.streaming.stateful import Deliveries, Replay, Sessions, WindowCounts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BYTES_PER_TRIGGER = str(8 << 30)
#: Buckets of keys per task of a stream that remembers deliveries.
BUCKETS_PER_TASK = 8


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, stored as one file or as a folder of files, as a stream of files.

    A micro-batch is bounded in bytes, or in files by ``lectern.stream.filesPerTrigger``.
    """
    use_utc(spark)
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    files = spark.conf.get("lectern.stream.filesPerTrigger", None)
    reader = spark.readStream.schema(table.schema).option(
        *(("maxFilesPerTrigger", files) if files else ("maxBytesPerTrigger", BYTES_PER_TRIGGER)))
    if any(f"/{name}.parquet/" in file for file in table.inputFiles()[:1]):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, in no more partitions than twice the cores."""
    most = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
               2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.shuffle.partitions": str(most)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_all(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Process all present input."""
    with _stream_settings(spark):
        writer.trigger(availableNow=True).start().awaitTermination()


@dataclass(frozen=True)
class Run:
    """A stream's folder: what it wrote, its checkpoint, and the state at its end."""

    spark: SparkSession
    root: str
    schema: T.StructType

    def rows(self, kind: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows")
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def state(self, name: str) -> DataFrame:
        """Key and value of every entry, from the checkpoint, as a written table."""
        path = new_folder(self.spark, f"state-{name}")
        with _stream_settings(self.spark):
            self.spark.read.format("statestore").option("stateVarName", name).load(
                f"{self.root}/checkpoint").drop("partition_id").write.parquet(path)
        return self.spark.read.parquet(path)


def run(stream: DataFrame, root: str) -> Run:
    """Run an append stream over all input that its checkpoint below ``root`` has not seen."""
    writer = stream.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/rows")
    if "kind" in stream.columns:
        writer = writer.partitionBy("kind")
    run_all(writer, stream.sparkSession)
    return Run(stream.sparkSession, root, stream.schema)


def run_to_folder(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all present input and read back what it wrote."""
    return run(stream, new_folder(stream.sparkSession, label)).rows()


def run_upserts(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update stream and keep the newest row of every key.

    A batch has a folder of its own that a repeated run of it overwrites.
    """
    spark = stream.sparkSession
    root = new_folder(spark, label)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    run_all(stream.writeStream.outputMode("update").option(
        "checkpointLocation", f"{root}/checkpoint").foreachBatch(add), spark)
    changes = spark.read.schema(T.StructType(
        [*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/rows")
    rest = [name for name in stream.columns if name not in keys]
    return changes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "batch").alias("newest")).select(*keys, "newest.*")


def latest_states(events: DataFrame) -> DataFrame:
    """Running latest status per fragment, for ``job_id``, ``fragment_id``."""
    return events.groupBy("job_id", "fragment_id").agg(
        F.max_by("status", F.struct("completed_at", "event_id")).alias("status"),
        F.max("completed_at").alias("updated_at"))


def run_progress(events: DataFrame, label: str) -> DataFrame:
    """Follow fragment states and return the present state of every fragment."""
    return run_upserts(latest_states(events), ["job_id", "fragment_id"], label)


def feed_page(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next ``limit`` events after a cursor, in order."""
    return events.where(F.col("event_id") > cursor).orderBy("event_id").limit(limit)


def feed_pages(events: DataFrame, size: int) -> DataFrame:
    """All pages of a feed: the cursor that each is asked with, its last event, its rows."""
    placed = numbered(events.select(F.lit(0).alias("feed"), "event_id"), ["feed"], ["event_id"],
                      "place")
    pages = placed.groupBy(F.expr(f"(place - 1) div {size}").alias("page")).agg(
        F.max("event_id").alias("last_event"), F.count("*").alias("events"))
    before = pages.select((F.col("page") + 1).alias("page"), F.col("last_event").alias("cursor"))
    return pages.join(before, "page", "left").select(
        "page", F.coalesce("cursor", F.lit(-1)).alias("cursor"), "last_event", "events")


def micros(text: str) -> int:
    """A span such as ``30 minutes`` in microseconds."""
    return round(pd.Timedelta(text).total_seconds() * 1_000_000)


def _at(column: str) -> Column:
    return F.unix_micros(column).alias("at")


def without_repeats(events: DataFrame, key: list[str], delay: str) -> DataFrame:
    """First deliveries within the delay, and late rows, of events with ``completed_at``."""
    spark = events.sparkSession
    buckets = BUCKETS_PER_TASK * min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                     2 * spark.sparkContext.defaultParallelism)
    kinds = [events.schema[name].dataType.simpleString() for name in key]
    rows = events.withWatermark("completed_at", delay).select(
        F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"),
        *[name for name in events.columns if name != "completed_at"], _at("completed_at"))
    fields = [f"{field.name} {field.dataType.simpleString()}" for field in rows.schema.fields
              if field.name != "bucket"]
    return rows.groupBy("bucket").transformWithStateInPandas(
        Deliveries(key, kinds, micros(delay)), ", ".join([*fields, "kind string"]),
        "append", "eventTime")


def all_deliveries(done: Run, key: list[str]) -> DataFrame:
    """One row per key, late ones included."""
    first = done.rows("first")
    late = done.rows("late").dropDuplicates(key).join(first.select(*key), key, "left_anti")
    return first.unionByName(late).drop("kind")


def outcome_rates(events: DataFrame, delay: str, span: str, slide: str | None = None) -> DataFrame:
    """Attempts, failures and retryable outcomes per tumbling or sliding window.

    Batches of rows are summed before they are shuffled, so that no window is one task's work.
    """
    length, step = micros(span), micros(slide or span)
    at = F.unix_micros("completed_at")
    starts = F.array(*[(F.floor(at / step) - k) * step for k in range(length // step)])
    rows = events.withWatermark("completed_at", delay).select(
        F.explode(starts).alias("window_start"),
        (F.col("code") == "failed").cast("long").alias("failures"),
        F.col("code").isin("transcript_mismatch", "audio_warning").cast("long").alias("retries"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.assign(attempts=1).groupby("window_start", as_index=False).sum()
            yield found.assign(window_end=found["window_start"] + length)[
                ["window_start", "window_end", *WindowCounts.SUMS]]

    partial = rows.mapInPandas(summed, "window_start bigint, window_end bigint, " + ", ".join(
        f"{name} bigint" for name in WindowCounts.SUMS))
    return partial.groupBy("window_start", "window_end").transformWithStateInPandas(
        WindowCounts(), WindowCounts.SCHEMA, "append", "eventTime")


def all_rates(done: Run) -> DataFrame:
    """Every window with all its rows: closed and open ones, and late rows."""
    names = ["window_start", "window_end", *WindowCounts.SUMS]
    open_ = done.state("counts").select("key.*", "value.*").select(*names)
    return done.rows().select(*names).unionByName(open_).groupBy(*names[:2]).agg(
        *[F.sum(name).alias(name) for name in WindowCounts.SUMS])


def worker_sessions(events: DataFrame, delay: str, lease: str) -> DataFrame:
    """Stretches of signs of life; a worker is silent once its lease runs out."""
    rows = events.withWatermark("completed_at", delay).select("fragment_id", _at("completed_at"))
    return rows.groupBy("fragment_id").transformWithStateInPandas(
        Sessions(micros(lease)), Sessions.SCHEMA, "append", "eventTime")


def all_sessions(done: Run, lease: str) -> DataFrame:
    """Closed and open sessions, joined where late signs of life bridge or extend them."""
    names = ["fragment_id", "started", "last", "beats"]
    open_ = done.state("open").select("key.*", "list_element.*").select(*names)
    order = Window.partitionBy("fragment_id").orderBy("started", "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("started") >= F.max("last").over(before) + micros(lease), F.lit(True))
    return (
        done.rows().select(*names).unionByName(open_).withColumn("starts", apart.cast("int"))
        .withColumn("session", F.sum("starts").over(order)).groupBy("fragment_id", "session")
        .agg(F.min("started").alias("session_start"),
             (F.max("last") + micros(lease)).alias("silent_from"), F.sum("beats").alias("beats"))
        .drop("session"))


def judged_events(actions: DataFrame, delay: str, ttl: str) -> DataFrame:
    """Events of (fragment_id, event_id, happened_at, action) judged in order, and late ones."""
    rows = actions.withWatermark("happened_at", delay).select(
        "fragment_id", "event_id", _at("happened_at"), "action")
    return rows.groupBy("fragment_id").transformWithState(
        Replay(micros(ttl)), Replay.SCHEMA, "append", "eventTime")


def all_judged(done: Run) -> DataFrame:
    """Every event as the batch judges it.

    Fragments are judged anew, by the batch operator, if they have late events, events that
    the watermark has not reached, or a second beginning; all others stand as they are.
    """
    names = ["fragment_id", "event_id", "at", "action"]  # the last three wait as arrays
    judged, late = done.rows("judged"), done.rows("late").select(*names)
    waiting = done.state("pending").select("key.*", F.inline(F.arrays_zip(
        *[F.col(f"list_element.{name}").alias(name) for name in names[1:]]))).select(*names)
    again = judged.where("begins").groupBy("fragment_id").count().where("count > 1")
    touched = late.select("fragment_id").union(waiting.select("fragment_id")).union(
        again.select("fragment_id")).distinct()
    anew = judged.select(*names).unionByName(late).unionByName(waiting).join(
        touched, "fragment_id", "left_semi")
    states = ["from_state", "to_state", "legal"]
    fine = judged.join(touched, "fragment_id", "left_anti").select(*names, *states)
    return fine.unionByName(replay(anew, "fragment_id", ["at", "event_id"]).select(
        *names, *states)).withColumns({"from_status": status_of(F.col("from_state")),
                                       "to_status": status_of(F.col("to_state"))})
