"""Statistics and states from the status-event log and from step tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walks import clocked, most_at_once

STEP_COUNT = 8
LAST, DEFAULT_SECONDS = 1000, 60.0
HOUR_US = 3_600_000_000
STATUSES = ["pending", "processing", "completed", "failed"]
QUEUE_EVENTS = ["task_added", "task_removed", "task_completed", "task_failed", "queue_empty", "queue_full"]
KEY_FIELDS = ["task_id", "event_type", "step_id"]


def _latest(value: Column, when: Column | None = None) -> Column:
    order = F.col("sequence") if when is None else F.when(when, F.col("sequence"))
    return F.max_by(value, order)


def status_events(events: DataFrame) -> DataFrame:
    """Events with progress, which follows from the counters where it isn't given."""
    return events.withColumn("progress", F.when(F.col("total_items") > 0, F.col("current_item") * 100.0 / F.col("total_items")).otherwise(0.0))


def route_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    queue = F.when(kind.contains("progress"), "progress").when(kind.startswith("task_"), "task").when(kind.startswith("step_"), "step").otherwise("other")
    return events.withColumn("queue", queue)


def critical_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin("task_completed", "task_failed", "step_completed", "step_failed"))


def dedup_window(short_ms: int, long_ms: int) -> Column:
    """Milliseconds in which an event of a key repeats: short for starts, ends and failures of steps and ends and failures of tasks."""
    short = F.col("event_type").isin("step_started", "step_completed", "step_failed", "task_completed", "task_failed")
    return F.when(short, short_ms).otherwise(long_ms).cast("bigint")


def dedup_events(events: DataFrame, short_ms: int = 25, long_ms: int = 100, keys: list[str] = KEY_FIELDS) -> DataFrame:
    """Events without those that come within the window of their key's last accepted one; events without a time stay.

    Acceptance depends on what was accepted before, which is the clock of walks.clocked(): an event that is accepted sets it to its time. The window
    has to be one for all events of a key.
    """
    if "event_type" not in keys and short_ms != long_ms:
        raise ValueError("a key without event_type has events of two windows")
    at = F.unix_micros(F.col("event_time").cast("timestamp"))
    rows = events.withColumns({"_at_us": at, "_ahead_us": dedup_window(short_ms, long_ms) * 1000 - 1, "_own_us": F.lit(0).cast("long")})
    walked = clocked(rows.filter("_at_us is not null"), keys, ["_at_us", "sequence"], "_at_us", "_own_us", "_ahead_us")
    return walked.filter("is_set").select(events.columns).unionByName(events.filter("event_time is null"))


def throttle_progress(events: DataFrame, window_ms: int = 200) -> DataFrame:
    """At most one progress event of a task and step in a window."""
    return dedup_events(events.filter("event_type = 'step_progress'"), window_ms, window_ms, ["task_id", "step_id"])


def fold_step_state(events: DataFrame, numbered: bool = False) -> DataFrame:
    """The state of each task and step: status of the latest event; a start sets the counters to 0 of total, progress to its own,
    completion to all; the error of the latest failure; the time of the latest start; `numbered` adds the sequence of the latest event."""
    rows = events.filter("step_id is not null and event_type like 'step\\_%'")
    kind = F.substring("event_type", 6, 100)
    rows = rows.withColumn("kind", kind)
    status = F.when(F.col("kind") == "completed", "completed").when(F.col("kind") == "failed", "failed").otherwise("processing")
    current = F.when(F.col("kind") == "started", 0).when(F.col("kind") == "completed", F.col("total_items")).otherwise(F.col("current_item"))
    counted = F.col("kind") != "failed"
    state = rows.groupBy("task_id", "step_id").agg(
        _latest(status).alias("status"), _latest(current, counted).alias("current_item"), _latest(F.col("total_items"), counted).alias("total_items"),
        _latest(F.col("error_message"), F.col("kind") == "failed").alias("error_message"), F.max(F.when(F.col("kind") == "started", F.col("event_time"))).alias("started_at"),
        F.max("event_time").alias("updated_at"), F.count("*").alias("events"), *([F.max("sequence").alias("sequence")] if numbered else []),
    )
    progress = F.when(F.col("status") == "completed", 100.0).when(F.col("total_items") > 0, F.col("current_item") * 100.0 / F.col("total_items")).otherwise(0.0)
    return state.withColumn("progress", progress)


def fold_task_state(events: DataFrame) -> DataFrame:
    """The state of each task: status of its latest task event (processing without one), completed steps of eight, error, times."""
    steps = fold_step_state(events).groupBy("task_id").agg(F.count_if(F.col("status") == "completed").alias("steps_done"))
    kind = F.when(F.col("event_type").startswith("task_"), F.substring("event_type", 6, 100))
    word = F.when(kind == "completed", "completed").when(kind == "failed", "failed").otherwise("processing")
    tasks = events.groupBy("task_id").agg(
        _latest(word, kind.isNotNull()).alias("last"), F.max_by("error_message", F.when(kind == "failed", F.col("sequence"))).alias("error_message"),
        F.min("event_time").alias("first_at"), F.max("event_time").alias("updated_at"),
    )
    joined = tasks.join(steps, "task_id", "left").withColumn("steps_done", F.coalesce("steps_done", F.lit(0)))
    return joined.select("task_id", F.coalesce("last", F.lit("processing")).alias("status"), (F.col("steps_done") * 100.0 / STEP_COUNT).alias("progress"), "steps_done", "error_message", "first_at", "updated_at")


def status_lattice(events: DataFrame, by_priority: bool = False) -> DataFrame:
    """The status of each task and step: the latest, or by completed, failed, processing, pending before the latest."""
    rows = events.filter("step_id is not null")
    kind = F.substring_index("event_type", "_", -1)
    status = F.when(kind == "completed", "completed").when(kind == "failed", "failed").otherwise("processing")
    rank = F.when(status == "completed", 3).when(status == "failed", 2).otherwise(1)
    order = F.struct(rank.alias("rank"), F.col("sequence")) if by_priority else F.col("sequence")
    return rows.groupBy("task_id", "step_id").agg(F.max_by(status, order).alias("status"))


def step_status_summary(steps: DataFrame) -> DataFrame:
    """Per task: steps by status (those without a row are pending), per cent completed, and the step to go on with."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES[1:]]
    rows = steps.groupBy("task_id").agg(*counts, _resume().alias("current_step"))
    pending = F.lit(STEP_COUNT) - F.col("processing") - F.col("completed") - F.col("failed")
    return rows.withColumns({"pending": pending, "percent": F.col("completed") * 100.0 / STEP_COUNT})


def _done_steps() -> Column:
    return F.collect_set(F.when(F.col("status") == "completed", F.col("step_id")))


def _resume() -> Column:
    missing = F.filter(F.sequence(F.lit(0), F.lit(STEP_COUNT - 1)), lambda s: ~F.array_contains(_done_steps(), s))
    return F.coalesce(F.array_min(missing), F.lit(STEP_COUNT))


def completed_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy("task_id").agg(F.array_sort(_done_steps()).alias("steps"))


def resume_point(steps: DataFrame) -> DataFrame:
    """Per task the smallest step that isn't completed, 8 if none is left."""
    return steps.groupBy("task_id").agg(_resume().alias("resume_step"))


def start_step(steps: DataFrame) -> DataFrame:
    """Per task the step after the leading run of completed ones, -1 if all are."""
    return steps.groupBy("task_id").agg(F.when(_resume() == STEP_COUNT, -1).otherwise(_resume()).alias("start_step"))


def overall_status(steps: DataFrame) -> DataFrame:
    """Per task one word, and how many of the eight steps are done."""
    n = lambda s: F.count_if(F.col("status") == s)
    word = F.when(n("failed") > 0, "failed").when(n("completed") == STEP_COUNT, "done").when(n("processing") > 0, "processing").when(n("completed") > 0, "in_progress").otherwise("ready")
    return steps.groupBy("task_id").agg(word.alias("overall"), F.concat(n("completed").cast("string"), F.lit(f"/{STEP_COUNT}")).alias("done"))


def task_progress(step: Column, percent: Column) -> Column:
    return (step + percent / 100.0) / STEP_COUNT * 100.0


def reset_after_failure(steps: DataFrame) -> DataFrame:
    """Steps after the first failed one of their task go back to pending."""
    first = F.min(F.when(F.col("status") == "failed", F.col("step_id"))).over(Window.partitionBy("task_id"))
    return steps.withColumn("status", F.when(F.col("step_id") > first, "pending").otherwise(F.col("status")))


def step_items(details: DataFrame) -> DataFrame:
    """Step details (arrays of completed, pending and failed items) with counts, flags and per cent."""
    done, left, bad = (F.coalesce(F.size(c), F.lit(0)) for c in ("completed_items", "pending_items", "failed_items"))
    total = done + left + bad
    return details.withColumns({"is_completed": (total > 0) & (done == total), "is_partial": (done > 0) & (done < total), "percent": F.when(total > 0, done * 100.0 / total).otherwise(0.0)})


def queue_stats(events: DataFrame) -> DataFrame:
    """Counts of each kind of event, per queue and for all (queue null), in one pass."""
    kinds = ["task", "step", "progress", "other"]
    rows = route_events(events)
    return rows.rollup("task_id").agg(*[F.count_if(F.col("queue") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_all"))


def last_n(rows: DataFrame, key: str, order: str, n: int = LAST) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def processor_stats(runs: DataFrame, n: int = LAST) -> DataFrame:
    """Per step: runs, successes, failures, rate, and mean, least and most seconds of the last n runs (60 expected without any)."""
    counts = runs.groupBy("step_id").agg(F.count("*").alias("processed"), F.count_if("success").alias("succeeded"))
    times = last_n(runs, "step_id", "sequence", n).groupBy("step_id").agg(F.avg("seconds").alias("avg_seconds"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))
    out = counts.join(times, "step_id").withColumn("failed", F.col("processed") - F.col("succeeded"))
    return out.withColumns({"success_rate": F.col("succeeded") / F.col("processed"), "estimate_seconds": F.coalesce("avg_seconds", F.lit(DEFAULT_SECONDS))})


def resource_hold_stats(log: DataFrame, n: int = LAST, bucket_us: int = HOUR_US) -> DataFrame:
    """Per resource: holds, the most at one time, and mean and longest seconds of the last n."""
    most = most_at_once(log, "resource_type", F.col("acquired_us"), F.col("acquired_us") + F.col("hold_us"), bucket_us)
    holds = log.groupBy("resource_type").agg(F.count("*").alias("acquired"))
    times = last_n(log, "resource_type", "no", n).groupBy("resource_type").agg(F.avg("hold_us").alias("avg_hold_us"), F.max("hold_us").alias("max_hold_us"))
    return holds.join(most, "resource_type").join(times, "resource_type")


def retry_outcome(attempts: DataFrame, retries: int = 5) -> DataFrame:
    """Per task and segment: whether one of its first attempts (1 and the retries) was a success, and how many were made."""
    place = F.row_number().over(Window.partitionBy("task_id", "segment").orderBy("attempt"))
    rows = attempts.withColumn("try", place).filter(F.col("try") <= retries + 1)
    won = F.min(F.when(F.col("success"), F.col("try")))
    return rows.groupBy("task_id", "segment").agg(won.isNotNull().alias("success"), F.coalesce(won, F.max("try")).alias("tries"))


def synth_summary(outcomes: DataFrame) -> DataFrame:
    """Per task: segments, successes, failures with their sorted indices, and success if any segment has it."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("segment"))))
    return outcomes.groupBy("task_id").agg(F.count("*").alias("segments"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.bool_or("success").alias("success"), bad.alias("failed_segments"))


def retry_flow(events: DataFrame, most: int = 3) -> DataFrame:
    """Failures with what follows: back to the same step while the task has failed at most `most` times, then failed."""
    failed = events.filter(F.col("event_type").isin("task_failed", "step_failed"))
    n = F.row_number().over(Window.partitionBy("task_id").orderBy("sequence"))
    return failed.withColumn("retry", n).withColumn("action", F.when(F.col("retry") <= most, "requeue").otherwise("fail"))


def task_flow(events: DataFrame) -> DataFrame:
    """Completions of a step with the next one, or the completion of the task after the last."""
    done = events.filter("event_type = 'step_completed'")
    return done.select("task_id", "sequence", "step_id", F.when(F.col("step_id") < STEP_COUNT - 1, F.col("step_id") + 1).alias("next_step"), (F.col("step_id") == STEP_COUNT - 1).alias("task_done"))


def task_tracking(states: DataFrame) -> DataFrame:
    bucket = F.when(F.col("status").isin("completed", "failed", "cancelled"), F.col("status")).otherwise("active")
    return states.withColumn("bucket", bucket)


def task_summary(states: DataFrame) -> DataFrame:
    """States with progress and seconds since their first event, rounded to two places, and their bucket."""
    seconds = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 1e6
    rows = task_tracking(states)
    return rows.withColumns({"progress": F.round("progress", 2), "processing_seconds": F.round(seconds, 2)})


def status_lookup(states: DataFrame, steps: DataFrame, task_id, step_id: int) -> DataFrame:
    """What the folded tables tell of one task, one of its steps, all its steps, and all tasks that have completed that step: scope, task_id,
    step_id, status."""
    own, step = F.col("task_id") == task_id, F.col("step_id") == step_id
    of_step = lambda scope, rows: rows.select(F.lit(scope).alias("scope"), "task_id", "step_id", "status")
    task = states.filter(own).select(F.lit("task").alias("scope"), "task_id", F.lit(None).cast("int").alias("step_id"), "status")
    found = [of_step("step", steps.filter(own & step)), of_step("steps", steps.filter(own)), of_step("completed", steps.filter(step & (F.col("status") == "completed")))]
    return reduce(DataFrame.unionByName, found, task)


def scheduler_stats(states: DataFrame) -> DataFrame:
    """One row: tasks by bucket, and the per cent of successes among those that ended, N/A without any."""
    rows = task_tracking(states)
    counts = rows.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("active", "completed", "failed")])
    ended = F.col("completed") + F.col("failed")
    return counts.withColumn("success_rate", F.when(ended > 0, F.format_string("%.1f%%", F.col("completed") * 100.0 / ended)).otherwise("N/A"))


def batch_summary(states: DataFrame) -> DataFrame:
    won = F.count_if(F.col("status") == "completed")
    return states.agg(F.count("*").alias("total"), won.alias("succeeded"), (F.count("*") - won).alias("failed"), (won == F.count("*")).alias("all_succeeded"))


def system_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct("task_id").alias("tasks"), F.count_distinct("task_id", "step_id").alias("steps"), F.count_if(F.col("event_type").isin("task_completed", "task_failed", "step_completed", "step_failed")).alias("critical"))


def status_health(events: DataFrame, every: str = "5 seconds", backlog: int = 500) -> DataFrame:
    """Per window: tasks that are active in it, events, and an alert where more than the backlog came."""
    rows = events.groupBy(F.window("event_time", every).alias("w")).agg(F.count_distinct("task_id").alias("tasks"), F.count("*").alias("events"))
    return rows.select(F.col("w.start").alias("from_time"), "tasks", "events", (F.col("events") > backlog).alias("alert"))


def absences(events: DataFrame, keys: list[str], seconds: int = 30, until: Column | None = None) -> DataFrame:
    """keys, last_seen, alert_at, seen_again: a row for each time that a key had no event for more than so many seconds; the last event of a key counts
    where `until` (a time) is later than that, and is not seen again. Without keys all events count as one.

    Events are reduced to the first and last of each stretch of that length, within which no such pause has room, before they are put in order.
    """
    own, micros = keys or ["_all"], lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.withColumn("_all", F.lit(0)).filter("event_time is not null")
    stretches = rows.groupBy(*own, F.floor(micros("event_time") / F.lit(seconds * 1_000_000)).alias("_stretch")).agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    again = F.lead("first").over(Window.partitionBy(*own).orderBy("_stretch"))
    end = F.lit(None).cast("long") if until is None else F.unix_micros(until.cast("timestamp"))
    pauses = stretches.withColumn("again", again).filter(F.coalesce(micros("again"), end) - micros("last") > seconds * 1_000_000)
    return pauses.select(*keys, F.col("last").alias("last_seen"), (F.col("last") + F.expr(f"interval {seconds} seconds")).alias("alert_at"), F.col("again").alias("seen_again"))


def group_batch_updates(events: DataFrame) -> DataFrame:
    """Events that are neither of a task nor progress, as one ordered list for each task."""
    rows = route_events(events).filter(~F.col("queue").isin("task", "progress"))
    return rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "event_type", "step_id"))).alias("updates"))


def load_cached_status(steps: DataFrame, legacy: DataFrame) -> DataFrame:
    """Per task the completed steps for a dashboard, from step rows or else from legacy rows (task_id, completed_steps); tasks without a
    completed step have none."""
    own = completed_steps(steps).filter(F.size("steps") > 0)
    old = legacy.select("task_id", F.array_sort("completed_steps").alias("old")).filter(F.size("old") > 0)
    rows = own.join(old, "task_id", "full_outer")
    return rows.select("task_id", F.coalesce("steps", "old").alias("steps"), (F.size(F.coalesce("steps", "old")) * 100.0 / STEP_COUNT).alias("percent"))


def merge_metadata(old: Column, new: Column) -> Column:
    """Maps as one, the right side wins; a null is an empty map."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
