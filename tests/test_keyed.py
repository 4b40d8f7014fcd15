"""The keyed table: batches count once, a writer that fails leaves nothing, streams end where batch operators do."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from cuewright.operators import progress as S
from cuewright.plans.adapters import status_events
from cuewright.sources.keyed import KeyedTable
from cuewright.sources.sinks import write_step_status
from cuewright.streaming import events as E

from .test_streams import SF, log

SCHEMA = "task_id long, step_id int, status string, note string, started_at string"


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def updates(spark, *of):
    return spark.createDataFrame(of, "task_id long, step_id int, status string, note string, event_time string, sequence long")


def test_batches_count_once_and_touch_their_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["task_id", "step_id"], 4)
    assert rows(table) == []
    first = updates(spark, (1, 0, "processing", None, "t1", 1), (1, 0, "completed", "n", "t2", 2), (1, 0, None, "m", "t3", 3), (2, 1, "failed", None, "t4", 4), (None, 1, "failed", None, "t4", 4))
    assert write_step_status(table, first, 0)
    want = [(1, 0, "completed", "m", "t1"), (2, 1, "failed", None, None), (None, 1, "failed", None, None)]
    assert rows(table) == want
    before = table.version()
    assert not write_step_status(table, first.withColumn("status", F.lit("wrong")), 0) and rows(table) == want
    assert write_step_status(table, updates(spark, (2, 1, "processing", None, "t5", 5)), 0, "other")
    after = table.version()
    assert sum(before["buckets"].get(b) != p for b, p in after["buckets"].items()) == 1
    assert rows(table)[1] == (2, 1, "processing", None, "t5") and after["batches"] == {"main": 0, "other": 0}
    assert write_step_status(table, first.limit(0), 1) and table.version()["buckets"] == after["buckets"]


def test_old_folders_go(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["task_id", "step_id"], 1)
    for n in range(6):
        write_step_status(table, updates(spark, (1, 0, f"s{n}", None, "t", n)), n)
    assert len(list((tmp_path / "data").iterdir())) == 3 and rows(table) == [(1, 0, "s5", None, None)]


def test_a_writer_that_dies_or_is_overtaken(spark, tmp_path, monkeypatch):
    table, other = (KeyedTable(spark, str(tmp_path), SCHEMA, ["task_id", "step_id"], 2) for _ in range(2))
    write_step_status(table, updates(spark, (1, 0, "processing", None, "t1", 1)), 0)
    publish = KeyedTable._publish

    def dies(self, version):
        raise OSError("gone")

    monkeypatch.setattr(KeyedTable, "_publish", dies)
    with pytest.raises(OSError, match="gone"):
        write_step_status(table, updates(spark, (1, 0, "failed", "x", "t2", 2)), 1)
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert rows(table) == [(1, 0, "processing", None, "t1")]
    overtaken = []

    def late(self, version):
        if self is table and not overtaken:
            overtaken.append(write_step_status(other, updates(spark, (1, 1, "failed", None, "t3", 3)), 7, "other"))
        return publish(self, version)

    monkeypatch.setattr(KeyedTable, "_publish", late)
    assert write_step_status(table, updates(spark, (1, 0, "completed", None, "t2", 2)), 1)
    assert rows(table) == [(1, 0, "completed", None, "t1"), (1, 1, "failed", None, None)]
    assert [json.loads((tmp_path / "versions" / f"{n:012d}").read_text())["number"] for n in (1, 2, 3)] == [1, 2, 3]


def test_a_stream_that_is_killed_in_a_batch_and_restarted(spark, tmp_path, monkeypatch):
    """The batch is applied, but the query dies before its checkpoint knows; then a write dies before it is published."""
    events = status_events(spark, SF).filter("step_id is not null").withColumn("event_time", F.col("event_time").cast("string"))
    kind = F.col("kind")
    changes = events.select("task_id", "step_id", F.when(kind == "completed", "completed").when(kind == "failed", "failed").otherwise("processing").alias("status"), F.col("error_message").alias("note"), "event_time", "sequence")
    folder = f"{tmp_path}/in"
    for part in range(4):
        changes.filter(F.col("sequence") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table, apply, publish, deaths = KeyedTable(spark, f"{tmp_path}/table", SCHEMA, ["task_id", "step_id"], 4), KeyedTable.apply, KeyedTable._publish, []

    def apply_and_die(self, rows, batch, *rest):
        done = apply(self, rows, batch, *rest)
        if batch == 1 and "after" not in deaths:
            deaths.append("after")
            raise OSError("killed behind the write")
        return done

    def die_and_publish(self, version):
        if version["number"] == 3 and "before" not in deaths:
            deaths.append("before")
            raise OSError("killed in front of the write")
        return publish(self, version)

    monkeypatch.setattr(KeyedTable, "apply", apply_and_die)
    monkeypatch.setattr(KeyedTable, "_publish", die_and_publish)
    for _ in range(3):
        query = E.upsert_stream(stream, table, f"{tmp_path}/cp")
        try:
            E.flush_events(query)
        except Exception as error:  # noqa: BLE001
            assert "killed" in str(error)
        query.stop()
    assert deaths == ["after", "before"] and table.version()["number"] == 4
    other = KeyedTable(spark, f"{tmp_path}/other", SCHEMA, ["task_id", "step_id"], 3)
    # The batches in the order in which the stream read the files.
    for n, path in enumerate(sorted(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime)):
        write_step_status(other, spark.read.parquet(path), n)
    assert rows(table) == rows(other)


def test_snapshots_and_critical_events_meet_in_one_table(spark, tmp_path):
    batch, stream = log(spark, tmp_path)
    table = E.step_table(spark, f"{tmp_path}/steps", 4)
    queries = E.sync_snapshots(stream, table, f"{tmp_path}/cp", "200 milliseconds")
    E.flush_events(*queries)
    for query in queries:
        query.stop()
    want = S.fold_step_state(batch, True)
    columns = sorted(want.columns)
    key = lambda df: sorted(map(str, map(tuple, df.filter("task_id >= 0").select(columns).collect())))
    assert key(table.read()) == key(want) and set(table.version()["batches"]) == {"snapshots", "critical"}
