"""Clocks over groups that lie in many tasks, against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import progress as S
from cuewright.operators.walks import UNSET, clocked

SCHEMA = "g int, h string, at int, value long, own long, margin long, text string"


def plain(rows, start):
    out, key, clock, number = [], None, start, 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2])):
        if (r[0], r[1]) != key:
            key, clock, number = (r[0], r[1]), start, 0
        is_set = r[3] > clock + r[5]
        at = r[3] if is_set else clock
        out.append((*r, is_set, clock, at, number))
        clock, number = at + r[4], number + 1 + is_set
    return out


@pytest.fixture
def apart(spark):
    """Ranges stay apart, and batches are short."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_clock_is_the_walk(apart, seed):
    rng = random.Random(seed)
    step, lengths = rng.choice([(900, 1000), (1000, 900), (1000, 1000), (50, 0)])
    rows = [(1, "a", n, n * step + rng.randrange(2000), rng.randrange(lengths + 1) if lengths else 0, 40, f"t{n}") for n in range(2500)]
    rows += [(rng.choice([None, 0, 1, 2]), rng.choice([None, "b"]), n, rng.randrange(10**6), rng.randrange(500), 0, None) for n in range(300)]
    rows += [(3, "c", n, n * 10**15, 5, 0, None) for n in range(60)] + [(4, "d", 0, -5, 1, 3, None)]
    start = rng.choice([0, UNSET // 4])
    got = clocked(apart.createDataFrame(rows, SCHEMA).repartition(5), ["g", "h"], ["at"], "value", "own", "margin", start, numbered=True)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, start)))


def test_one_key_is_many_even_tasks(apart):
    events = apart.range(6000).select(F.col("id").alias("sequence"), F.timestamp_micros(F.col("id") * 30_000 + F.col("id") % 7 * 4000).alias("event_time"), F.lit(1).alias("task_id"), F.lit(2).alias("step_id"), F.lit("step_progress").alias("event_type"))
    kept = S.dedup_events(events)
    want, last = [], None
    for r in events.orderBy("event_time", "sequence").collect():
        if last is None or (r["event_time"] - last).total_seconds() >= 0.1:
            want.append(r["sequence"])
            last = r["event_time"]
    assert sorted(r["sequence"] for r in kept.collect()) == sorted(want)
    sizes = sorted(r[1] for r in clocked(events.withColumns({"v": F.col("sequence"), "o": F.lit(0).cast("long")}), ["task_id"], ["v"], "v", "o", "o").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) > 8 and sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_no_rows_and_windows_within_a_key(spark):
    events = spark.createDataFrame([], "sequence long, event_time timestamp, task_id int, step_id int, event_type string")
    assert S.dedup_events(events).count() == 0
    with pytest.raises(ValueError, match="two windows"):
        S.dedup_events(events, 25, 100, ["task_id"])
