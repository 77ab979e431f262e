"""Streams give the batch result however the table is stored and in whatever order it comes."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from checking import SMALL
from pyspark.sql import functions as F

from lectern.operators.replay import replay
from lectern.plans import QUERIES
from lectern.session import new_folder
from lectern.streaming import feeds

STREAMS = ("stream_progress", "event_feed", "event_feed_pages", "stream_dedup", "stream_rates",
           "stream_rates_sliding", "stream_sessions", "stream_replay")
NOON = datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events in random order over eight files."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture
def one_file_a_batch(spark):
    spark.conf.set("lectern.stream.filesPerTrigger", "1")
    yield
    spark.conf.unset("lectern.stream.filesPerTrigger")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def drop(spark, folder, events):
    """One more file of (fragment_id, event_id, minutes after noon, value)."""
    frame = spark.createDataFrame(
        [(f, e, NOON + timedelta(minutes=m), x) for f, e, m, x in events],
        "fragment_id long, event_id long, completed_at timestamp, value string")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def stream(spark, folder):
    return feeds.stream_table(spark, folder, "events")


@pytest.mark.parametrize("name", STREAMS)
def test_eight_files_one_per_batch(spark, shuffled, one_file_a_batch, name):
    """Nearly every row is later than the delay, and none is lost."""
    wanted = rows(QUERIES[name](spark, SMALL))
    assert rows(QUERIES[name](spark, shuffled)) == wanted
    assert len(wanted) > 0


def test_a_folder_in_one_batch(spark, shuffled):
    assert rows(QUERIES["event_feed"](spark, shuffled)) == rows(QUERIES["event_feed"](spark, SMALL))


def test_no_row_is_written_twice(spark, shuffled, one_file_a_batch):
    """Closed windows and sessions and judged events come out once, the rest as late rows."""
    events = feeds.stream_table(spark, shuffled, "events").select(
        F.col("user_id").alias("fragment_id"), "event_id", F.lit("failed").alias("code"),
        F.col("ts").cast("timestamp").alias("completed_at"))
    rates = feeds.run(feeds.outcome_rates(events, "30 minutes", "1 day"), new_folder(spark, "a"))
    closed = Counter(r["window_start"] for r in rates.rows("closed").collect())
    assert max(closed.values()) == 1 and rates.rows("late").count() > 0
    assert not set(closed) & {r["key"]["window_start"] for r in rates.state("counts").collect()}
    sessions = feeds.run(feeds.worker_sessions(events, "30 minutes", "1 hour"),
                         new_folder(spark, "b"))
    found = Counter((r["fragment_id"], r["started"]) for r in sessions.rows("closed").collect())
    assert max(found.values()) == 1


def test_late_rows_are_kept_and_merged(spark, tmp_path, one_file_a_batch):
    folder = str(tmp_path)
    drop(spark, folder, [(1, 1, 0, "x"), (1, 2, 5, "x"), (2, 3, 0, "x")])
    drop(spark, folder, [(1, 4, 600, "x")])
    drop(spark, folder, [(3, 5, 1, "x"), (1, 2, 5, "x"), (1, 6, 30, "x")])
    events = stream(spark, folder).withColumn("code", F.lit("failed"))
    key = ["fragment_id", "event_id"]
    once = feeds.run(feeds.without_repeats(events, key, "10 minutes"), new_folder(spark, "c"))
    assert sorted(r["event_id"] for r in once.rows("late").collect()) == [2, 5, 6]
    assert sorted(r["event_id"] for r in feeds.all_deliveries(once, key).collect()) == [
        1, 2, 3, 4, 5, 6]
    rates = feeds.run(feeds.outcome_rates(events, "10 minutes", "1 hour"), new_folder(spark, "d"))
    assert rates.rows("late").agg(F.sum("attempts")).first()[0] == 3
    assert sorted(r["attempts"] for r in feeds.all_rates(rates).collect()) == [1, 6]
    lives = feeds.run(feeds.worker_sessions(events, "10 minutes", "20 minutes"),
                      new_folder(spark, "e"))
    whole = feeds.all_sessions(lives, "20 minutes").collect()
    assert sorted((r["fragment_id"], r["beats"]) for r in whole) == [
        (1, 1), (1, 1), (1, 3), (2, 1), (3, 1)]


def test_late_signs_of_life_bridge_sessions(spark, tmp_path, one_file_a_batch):
    folder = str(tmp_path)
    drop(spark, folder, [(1, 1, 0, "x"), (1, 2, 30, "x")])
    drop(spark, folder, [(2, 3, 500, "x")])
    drop(spark, folder, [(1, 4, 15, "x")])
    lives = feeds.run(feeds.worker_sessions(stream(spark, folder), "5 minutes", "20 minutes"),
                      new_folder(spark, "f"))
    assert lives.rows("closed").where("fragment_id = 1").count() == 2
    whole = feeds.all_sessions(lives, "20 minutes").where("fragment_id = 1").collect()
    assert [r["beats"] for r in whole] == [3]


def test_state_is_bounded_by_the_delay(spark, tmp_path, one_file_a_batch):
    """After many hours of events only those of the last minutes are in the state."""
    folder = str(tmp_path)
    for hour in range(4):
        drop(spark, folder, [(m % 5, hour * 60 + m, hour * 60 + m, "start") for m in range(60)])
    events = stream(spark, folder).withColumn("code", F.lit("failed"))
    once = feeds.run(feeds.without_repeats(events, ["event_id"], "10 minutes"),
                     new_folder(spark, "g"))
    assert once.rows("first").count() == 240 and once.state("seen").count() <= 21
    rates = feeds.run(feeds.outcome_rates(events, "10 minutes", "15 minutes"),
                      new_folder(spark, "h"))
    assert rates.state("counts").count() <= 2
    actions = stream(spark, folder).select(
        "fragment_id", "event_id", F.col("completed_at").alias("happened_at"),
        F.col("value").alias("action"))
    judged = feeds.run(feeds.judged_events(actions, "10 minutes", "1 day"), new_folder(spark, "i"))
    assert judged.state("pending").count() <= 11 and judged.rows("judged").count() >= 229


def test_forgotten_fragments_are_judged_anew_if_they_return(spark, tmp_path, one_file_a_batch):
    folder = str(tmp_path)
    drop(spark, folder, [(1, 1, 0, "start"), (2, 2, 1, "start"), (2, 3, 2, "complete")])
    drop(spark, folder, [(3, 4, 300, "start")])
    drop(spark, folder, [(3, 5, 600, "fail")])
    actions = stream(spark, folder).select(
        "fragment_id", "event_id", F.col("completed_at").alias("happened_at"),
        F.col("value").alias("action"))
    root = new_folder(spark, "j")
    judged = feeds.run(feeds.judged_events(actions, "5 minutes", "2 hours"), root)
    assert {r["key"]["fragment_id"] for r in judged.state("folded").collect()} == {3}
    drop(spark, folder, [(1, 6, 700, "complete")])  # legal only for who knows the first event
    drop(spark, folder, [(3, 7, 1400, "manual_retry"), (2, 8, 0, "start")])
    done = feeds.run(feeds.judged_events(actions, "5 minutes", "2 hours"), root)
    batch = spark.read.parquet(f"{folder}/events.parquet").select(
        "fragment_id", "event_id", F.unix_micros("completed_at").alias("at"),
        F.col("value").alias("action"))
    names = ["fragment_id", "event_id", "from_state", "to_state", "legal"]
    assert rows(feeds.all_judged(done).select(*names)) == rows(
        replay(batch, "fragment_id", ["at", "event_id"]).select(*names))
    assert done.rows("judged").where("begins and fragment_id = 1").count() == 2


def test_a_feed_goes_on_where_it_stopped(spark, shuffled, tmp_path, one_file_a_batch):
    """Half of the files, a stop, the other half: nothing twice, nothing lost."""
    events = spark.read.parquet(f"{shuffled}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("completed_at"))
    folder, root = str(tmp_path), new_folder(spark, "k")
    counts = []
    for half in range(2):
        events.where(f"event_id % 2 = {half}").repartition(3).write.mode("append").parquet(
            f"{folder}/events.parquet")
        done = feeds.run(stream(spark, folder), root)
        counts.append(done.rows().count())
    assert counts == [500, 1000] and done.rows().select("event_id").distinct().count() == 1000
    cursor, seen = -1, []
    while page := [r["event_id"] for r in feeds.feed_page(done.rows(), cursor, 130).collect()]:
        seen, cursor = seen + page, page[-1]
    assert seen == sorted(r["event_id"] for r in events.collect())
    pages = feeds.feed_pages(done.rows(), 130).orderBy("page").collect()
    assert [p["events"] for p in pages] == [130] * 7 + [90]
    third = [r["event_id"] for r in feeds.feed_page(done.rows(), pages[2]["cursor"], 130).collect()]
    assert third == seen[260:390] and pages[2]["last_event"] == third[-1]


def test_a_stream_with_state_goes_on_where_it_stopped(spark, tmp_path, one_file_a_batch):
    folder, root = str(tmp_path), new_folder(spark, "l")
    drop(spark, folder, [(1, 1, 0, "x"), (1, 2, 3, "x")])
    lives = feeds.worker_sessions(stream(spark, folder), "5 minutes", "20 minutes")
    assert feeds.run(lives, root).rows("closed").count() == 0
    drop(spark, folder, [(1, 3, 10, "x"), (2, 4, 300, "x")])
    done = feeds.run(feeds.worker_sessions(stream(spark, folder), "5 minutes", "20 minutes"), root)
    assert [r["beats"] for r in done.rows("closed").collect()] == [3]
    assert sorted(r["beats"] for r in feeds.all_sessions(done, "20 minutes").collect()) == [1, 3]
