"""Streams give what the batch operators give on the same log."""

import time

from pyspark.sql import functions as F

from cuewright.operators import progress as S
from cuewright.plans.adapters import status_events
from cuewright.streaming import events as E

SF = "/root/testdata/sf0.001"
COLUMNS = ["sequence", "event_time", "task_id", "step_id", "event_type", "current_item", "total_items", "error_message"]


def log(spark, folder):
    events = status_events(spark, SF)
    events = events.withColumn("event_time", events.event_time.cast("timestamp")).select(COLUMNS)
    events.coalesce(1).write.parquet(f"{folder}/log")
    # A last event far behind moves the watermark past all others.
    late = events.limit(1).selectExpr("-1L AS sequence", "timestamp'2100-01-01' AS event_time", "-1L AS task_id", "0 AS step_id", "'step_progress' AS event_type", "0 AS current_item", "0 AS total_items", "string(null) AS error_message")
    late.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    E.flush_events(query)
    query.stop()


def test_dedup(spark, tmp_path):
    batch, stream = log(spark, tmp_path)
    day = 86_400_000
    run(E.dedup_stream(stream, day, 4 * day), "deduped")
    mine = {r[0] for r in spark.sql("SELECT sequence FROM deduped WHERE sequence >= 0").collect()}
    assert mine == {r[0] for r in S.dedup_events(batch, day, 4 * day).select("sequence").collect()}


def test_step_state(spark, tmp_path):
    batch, stream = log(spark, tmp_path)
    run(E.step_state_stream(stream), "steps", "complete")
    key = lambda df: sorted((r["task_id"], r["step_id"], r["status"], r["current_item"]) for r in df.collect() if r["task_id"] >= 0)
    assert key(spark.table("steps")) == key(S.fold_step_state(batch))


def test_callback_errors_do_not_end_a_query(spark, tmp_path):
    _, stream = log(spark, tmp_path)
    seen = []

    def callback(batch, number):
        seen.append(number)
        raise ValueError("told")

    query = E.on_event(stream, "step_failed", callback, str(tmp_path / "cp"))
    E.flush_events(query)
    assert query.isActive and len(seen) >= 2
    query.stop()


def test_absences_as_timers_tell_them(spark, tmp_path):
    batch, stream = log(spark, tmp_path)
    for keys in (["task_id"], []):
        name = f"absent_{len(keys)}"
        run(E.absence_stream(stream, keys, 6 * 3600), name)
        told = sorted(map(tuple, spark.table(name).collect()))
        want = S.absences(batch, keys, 6 * 3600, F.lit("2099-12-31 00:00:00").cast("timestamp")).drop("seen_again").collect()
        assert told == sorted(map(tuple, want)) and len(told) == len(set(told)) > 0


def test_absence_of_all_is_a_pause_between_neighbours(spark):
    times = [0, 10, 40, 71, 71, 200, 230, 261]
    events = spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("event_time"))
    got = S.absences(events, [], 30, F.timestamp_seconds(F.lit(300))).select(F.unix_seconds("last_seen"), F.unix_seconds("alert_at"), F.unix_seconds("seen_again"))
    assert sorted(map(tuple, got.collect())) == [(40, 70, 71), (71, 101, 200), (230, 260, 261), (261, 291, None)]


def test_reports_and_callbacks_beside_a_failing_one(spark, tmp_path):
    _, stream = log(spark, tmp_path)
    told, seen = [], []

    def fails(*_):
        raise ValueError("told of")

    reports = E.QueryReports(fails, told.append)
    spark.streams.addListener(reports)
    try:
        query = E.on_event(stream, "step_failed", [fails, lambda batch, number: seen.append((number, batch.count()))], str(tmp_path / "cp"))
        E.flush_events(query)
        query.stop()
        deadline = time.time() + 20
        while not any(r["what"] == "ended" for r in told) and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(reports)
    own = [r["what"] for r in told if r["id"] == str(query.id)]
    assert own[0] == "started" and own[-1] == "ended" and own.count("progress") >= 2 and len(seen) >= 2
    assert sum(r["rows"] for r in told if r["what"] == "progress") > 0
