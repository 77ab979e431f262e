"""Hot keys are cut into slices; results must not change."""

import pytest
from checking import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
import checking
from lectern.operators import hot_groups, replay
from lectern.sources import views


def skewed(spark, rows=400):
    """A third of all rows has the key 0."""
    number = F.col("id")
    return spark.range(rows).select(
        F.when(number % 3 == 0, 0).otherwise(number % 40).alias("k"),
        ((number * 7919) % 1009).alias("place"), number, (number % 5).alias("v"))


def test_running_equals_a_window(spark, few_rows_are_hot):
    rows = skewed(spark)
    order = Window.partitionBy("k").orderBy("place", "id")
    wanted = rows.withColumns({
        "n": F.row_number().over(order).cast("long"),
        "s": F.coalesce(F.sum("v").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    found = hot_groups.running(rows, ["k"], ["place", "id"], {"s": F.col("v")}, number="n")
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(
        map(tuple, wanted.collect()))


def test_hot_keys_are_spread(spark, few_rows_are_hot):
    sliced, hot = hot_groups.slice_hot_groups(skewed(spark), ["k"], ["place", "id"])
    assert hot
    sizes = [r["count"] for r in sliced.where("k = 0").groupBy("_slice").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 60 and sum(sizes) >= 134


def test_no_hot_keys_is_one_window(spark):
    found = hot_groups.numbered(skewed(spark), ["k"], ["place", "id"], "n")
    plan = found._jdf.queryExecution().toString()
    assert plan.count("Window") and "Join" not in plan


@pytest.mark.parametrize("name", [
    "attempt_history", "timeline", "retry_budget", "repeat_failures", "revision_append",
    "state_replay", "bad_transitions", "review_trail", "rewrite_select", "manifest",
    "decide_v2", "chapter_pcm",
])
def test_queries_with_hot_groups(spark, few_rows_are_hot, name):
    duck = checking.connect(SMALL)
    message, _ = checking.differences(
        entry.queries()[name](spark, SMALL), duck, entry.oracle_sql()[name])
    assert message is None, message


@pytest.mark.parametrize("block", [2, 3, 16, 256])
def test_replay_of_one_hot_fragment(spark, few_rows_are_hot, block):
    """One fragment of all rows and many small ones, in blocks of blocks of any size."""
    log = views.action_log(spark, SMALL)
    events = log.withColumn("fragment_id", F.lit(1).cast("long")).union(
        log.where("event_id % 3 = 0").withColumn("fragment_id", F.col("fragment_id") + 2))
    result = replay.replay(events, "fragment_id", ["happened_at", "event_id"], block=block)
    rows = result.orderBy("fragment_id", "happened_at", "event_id").collect()
    assert len(rows) == events.count()
    state, fragment = None, None
    for row in rows:
        if row["fragment_id"] != fragment:
            state, fragment = replay.INITIAL, row["fragment_id"]
        moved = replay.TRANSITIONS[row["action"]].get(state)
        assert (row["from_state"], row["legal"]) == (state, moved is not None)
        state = moved or state
        assert row["to_state"] == state


def test_replay_stays_in_the_jvm(spark):
    for name in ("state_replay", "bad_transitions"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_unknown_actions_and_empty_logs(spark):
    events = spark.createDataFrame(
        [(1, 1, "start"), (1, 2, "fly"), (1, 3, None), (1, 4, "complete"), (None, 1, "start")],
        "f long, k long, action string")
    rows = {(r["f"], r["k"]): (r["from_state"], r["to_state"], r["legal"])
            for r in replay.replay(events, "f", ["k"]).collect()}
    assert rows == {
        (1, 1): ("pending", "generating", True), (1, 2): ("generating", "generating", False),
        (1, 3): ("generating", "generating", False), (1, 4): ("generating", "ready", True),
        (None, 1): ("pending", "generating", True)}
    assert replay.replay(events.limit(0), "f", ["k"]).count() == 0
