"""Cases of the third round's findings, under their numbers."""

from types import SimpleNamespace

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import parquet

import checking
from lectern.functions import keys
from lectern.functions import text as tx
from lectern.operators import align as al
from lectern.operators import hot_groups
from lectern.operators import infer as inf
from lectern.operators import selection as se
from lectern.plans import CHECKS, QUERIES, audits
from lectern.sources import bookfiles
from lectern.streaming import stateful

WORDS = [f"w{i % 700}" for i in range(6_000)]
EDITS = {
    "dropped": [word for i, word in enumerate(WORDS, 1) if i % 17],
    "replaced": ["zz" if i % 23 == 0 else word for i, word in enumerate(WORDS, 1)],
}


@pytest.mark.parametrize("edit", EDITS)
def test_f2_texts_of_one_kind_of_edit_need_no_table(monkeypatch, edit):
    """F2, F9 to F12: where bounds prove the cost, no row of the edit table is made."""
    monkeypatch.setattr(al, "_rows", None)
    other = EDITS[edit]
    lost = len(WORDS) - len(other)
    replaced = WORDS.count("zz") + other.count("zz")
    counts = len(other) - replaced, replaced, lost, 0
    assert al.count_edits(WORDS, other) == counts
    assert al.count_edits(other, WORDS) == (*counts[:2], 0, lost)
    steps = al.align_words(WORDS, other)
    assert [sum(step["op"] == op for step in steps) for op in al.OPERATIONS] == [*counts]


def test_f1_alignments_come_in_bounded_batches():
    """a batch of long texts is given out in parts, whatever its number of rows."""
    frame = SimpleNamespace(schema=SimpleNamespace(fields=[]), mapInArrow=lambda f, schema: f)
    text = " ".join(WORDS)
    batch = pa.RecordBatch.from_pydict({"e": [text] * 60, "a": [None, *[text] * 58, "w0"]})
    parts = list(al.align(frame, "e", "a")(iter([batch])))
    sizes = [len(part.column("alignment").flatten()) for part in parts]
    assert sum(sizes) == 60 * len(WORDS) and len(parts) > 2
    assert max(sizes) <= al.BATCH_OPERATIONS
    assert sum(part.num_rows for part in parts) == 60
    last = parts[-1].column("alignment")[-1].as_py()
    assert [step["op"] for step in last[:2]] == ["match", "deletion"]


def test_f2_only_wanted_operations_leave_python(spark):
    frame = spark.createDataFrame([(1, "a b c d", "a x c d e"), (2, "a", "a")], "id int, e string, a string")
    found = {row.id: row.alignment for row in al.align(frame, "e", "a", ("substitution",)).collect()}
    assert [tuple(step) for step in found[1]] == [("substitution", "b", "x", 1, 1)]
    assert found[2] == []


LETTERS = "Straße, ŉ ǰ ΐ ﬁ ᾳ ᾼ ᾈ ﬗ."


@pytest.mark.parametrize("name", ["phrase_guard", "prompt_rows", "rewrite_rollup", "rewrite_state"])
def test_f3_to_f6_letters_with_long_capitals(spark, tmp_path, name):
    """F3 to F6: capitals letter by letter, as the SQL takes them."""
    path = f"{tmp_path}/benchmark.parquet"
    parquet.write_table(pa.table({
        "item_id": pa.array([1, 2, 21, 25], pa.int64()),
        "text": ["Plain text.", LETTERS, LETTERS, "weiß."]}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{path}'")
    assert checking.differences(QUERIES[name](spark, str(tmp_path)), con, CHECKS[name])[0] is None
    capitals = con.execute("SELECT unnest(list_transform(string_split(?, ''), lambda c: upper(c)))",
                           [tx.LONG_CAPITALS]).fetchall()
    assert "".join(c for c, in capitals) == tx.ONE_CAPITAL


def test_f8_stale_keys_read_the_books_once(spark):
    """F8: one scan for all changes; the counts are those of the join with the earlier keys."""
    frame = QUERIES["stale_keys"](spark, checking.SMALL)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    attempts = audits._attempt_rows(spark, checking.SMALL)
    before = keys.key_graph(attempts, keys.Versions())
    now = keys.key_graph(attempts, keys.Versions(contract="2"))
    joined = keys.stale_keys(now, before).groupBy("kind").count().collect()
    found = frame.where("changed = 'contract'").select("kind", "stale").collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, found))


def test_f19_failing_batches_are_halved():
    """few calls for one bad row among many, and bounded batches."""
    sizes = []

    def model(rows):
        sizes.append(len(rows))
        if (rows["id"] == 700).any():
            raise ValueError("bad")
        return rows[["id"]].rename(columns={"id": "same"})

    frame = SimpleNamespace(columns=["id"], schema=SimpleNamespace(fields=[]),
                            mapInPandas=lambda f, schema: f)
    parts = list(inf.infer(frame, lambda: model, "same long")(iter([
        pd.DataFrame({"id": range(2_500)})])))
    assert [len(part) for part in parts] == [1_000, 1_000, 500]
    assert max(sizes) == 1_000 and len(sizes) < 30
    found = pd.concat(parts)
    assert list(found["id"]) == list(range(2_500))
    assert list(found.loc[found["error"].notna(), "id"]) == [700]


def test_f14_orphans_are_counted_without_a_join(spark):
    frame = QUERIES["orphans"](spark, checking.SMALL)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 4
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(2,), (3,)], "p long")
    found = se.orphan_counts(child, parent, "k", "p").collect()
    assert sorted(map(tuple, found)) == [(1, 2, 0), (2, 1, 1), (3, 0, 1)]


def test_f13_small_books_share_tasks():
    """a task has many small books, and large ones still go by their size."""
    def files(count, size):
        return [SimpleNamespace(path=f"/b/{k}.fb2", size=size) for k in range(count)]

    parts = bookfiles.packed(files(100_000, 4_000), bookfiles.PARTITION_BYTES)
    assert len(parts) <= 200
    assert [name for part in parts for name, _ in part.files] == [f"/b/{k}.fb2" for k in range(100_000)]
    large = bookfiles.packed(files(40, 30 << 20), bookfiles.PARTITION_BYTES)
    assert max(sum(size for _, size in part.files) for part in large) <= bookfiles.PARTITION_BYTES


@pytest.mark.parametrize("name", ["rewrite_select", "retry_jobs", "retry_select"])
def test_f15_f16_many_rows_are_dealt_into_more_tasks(spark, monkeypatch, name):
    """F15, F16: a task numbers and joins so many rows at most, whatever the session's partitions."""
    monkeypatch.setattr(hot_groups, "TASK_ROWS", 300)
    frame = QUERIES[name](spark, checking.SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    numbering, joins = -(-6_000 // 300), -(-7_000 // 300)
    assert f", {numbering}), REPARTITION_BY_NUM" in plan
    assert f", {joins}), REPARTITION_BY_NUM" in plan
    assert checking.differences(frame, checking.connect(checking.SMALL), CHECKS[name])[0] is None


def test_f15_hot_keys_are_counted_in_large_buckets_only(spark):
    """buckets without room for a hot key are not counted by key; a null key may be hot."""
    rows = spark.createDataFrame([(k,) for k in [1, 2, None] for _ in range(4)] + [(7,)] * 30
                                 + [(None,)] * 10, "k long")
    assert hot_groups._hot_keys(rows, ["k"], 30) is None
    found = hot_groups._hot_keys(rows, ["k"], 12).collect()
    assert sorted(map(tuple, found), key=str) == [(7, 30), (None, 14)]


def test_f17_waiting_events_are_few_entries():
    """a fragment's events of one batch are one entry of the state and one message, not one each."""
    kept, timers = [], []
    replayed = stateful.Replay(1_000)
    replayed.handle = SimpleNamespace(registerTimer=timers.append)
    replayed.folded = SimpleNamespace(get=lambda: None)
    replayed.pending = SimpleNamespace(appendValue=kept.append)
    rows = [{"at": 9_000_000 + k, "event_id": k, "action": "start"} for k in range(500)]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    assert not list(replayed.handleInputRows((1,), iter(rows), now))
    assert len(kept) == 1 and len(timers) == 1
    replayed.pending.get = lambda: iter(kept)
    assert replayed._waiting() == [(9_000_000 + k, k, "start") for k in range(500)]
