"""Times the headline queries: python bench.py, with BENCH_SF_DIR and BENCH_CPUS. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from cuewright.operators import retime as R
from cuewright.operators import timeline as L
from cuewright.plans import adapters as D
from cuewright.plans.queries import QUERIES
from cuewright.session import configure

HEADLINE = [
    "retime_adaptive", "playout_timeline", "speed_plan", "srt_roundtrip", "ass_roundtrip", "basic_clean", "process_text", "split_length", "audio_measures",
    "replace_silent", "fold_step_state", "dedup_events", "resource_hold_stats", "pair_media_subtitles",
]
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def big_retime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-timing over the line items as cues."""
    cues = D.cues_big(spark, sf_dir)
    return R.retime(cues, D.clips(cues), "adaptive")


def big_speed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from two tracks to a speed plan over the line items as cues."""
    cues = D.cues_big(spark, sf_dir)
    media = D.media(cues)
    return L.speed_plan(L.coalesce_short(L.merge_segments(L.fill_gaps(cues, media), L.fill_gaps(cues, media))))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = {n: QUERIES[n] for n in HEADLINE} | {"big_retime": big_retime, "big_speed_plan": big_speed_plan}
    took = {}
    for name, query in queries.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
