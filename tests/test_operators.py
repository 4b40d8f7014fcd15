"""Properties and small cases of the operators that no query covers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import audio as A
from cuewright.operators import pairing as P
from cuewright.operators import progress as S
from cuewright.operators import retime as R
from cuewright.operators import timeline as L
from cuewright.plans import adapters as D
from cuewright.plans.queries import QUERIES
from cuewright.plans.stages import run_stages, text_pipeline
from cuewright.sources import documents as J

SF = "/root/testdata/sf0.001"


def test_segments_cover_the_media(spark):
    cues = D.cues(spark, SF).withColumn("end_us", F.least("end_us", F.col("start_us") + 500_000))
    media = D.media(cues)
    sums = L.fill_gaps(cues, media).groupBy("media_id").agg(F.sum("duration_us").alias("s")).join(media, "media_id")
    assert sums.count() > 0 and sums.filter("s <> duration_us").count() == 0


def test_fast_starts_are_the_walk_without_tolerance(spark):
    cues = D.cues(spark, SF)
    clips = D.clips(cues)
    walk = L.playout_timeline(cues, clips, 0).filter("kind <> 'gap'").select("media_id", "cue_no", "start_us")
    fast = L.playout_starts(cues, clips)
    assert walk.join(fast, ["media_id", "cue_no"]).filter("start_us <> play_us").count() == 0 and walk.count() == fast.count()


def test_results_do_not_depend_on_partitions(spark):
    events = D.status_events(spark, SF)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(S.fold_step_state(events.repartition(7))) == key(S.fold_step_state(events.coalesce(1)))


def test_dedup_is_idempotent(spark):
    day = 86_400_000
    once = S.dedup_events(D.status_events(spark, SF), day, 4 * day)
    assert S.dedup_events(once, day, 4 * day).count() == once.count()


def _greedy(times, window):
    last, kept = None, []
    for at, number in sorted(times):
        if last is None or at - last >= window:
            last, kept = at, [*kept, number]
    return kept


def test_dedup_of_a_busy_key(spark):
    """Against a plain walk: one key with most events, bursts and pauses, ties, a null step, and events without a time."""
    draw = random.Random(5)
    rows, at = [], 0
    for n in range(3000):
        at += draw.choice([0, 3, 10, 40, 99, 100]) if draw.random() < 0.98 else draw.choice([150, 200, 201, 5000])
        rows.append((n, at * 1000, 1 if draw.random() < 0.8 else draw.randrange(4), draw.choice([None, 2]), "step_progress"))
    rows += [(3000 + n, None, 1, 2, "step_progress") for n in range(3)]
    events = spark.createDataFrame(rows, "sequence long, us long, task_id int, step_id int, event_type string").withColumn("event_time", F.timestamp_micros("us"))
    want = {3000, 3001, 3002}
    for key in {r[2:4] for r in rows}:
        want.update(_greedy([(r[1], r[0]) for r in rows if r[2:4] == key and r[1] is not None], 100_000))
    found = S.dedup_events(events.repartition(5), 25, 100)
    assert found.columns == events.columns
    assert sorted(r.sequence for r in found.collect()) == sorted(want)
    assert S.dedup_events(events.limit(0)).count() == 0
    assert S.throttle_progress(events, 100).count() == len(want)


def test_most_holds_at_once(spark):
    draw = random.Random(6)
    rows = [(n, "gpu" if draw.random() < 0.9 else "cpu", draw.randrange(500), draw.randrange(60)) for n in range(800)]
    log = spark.createDataFrame(rows, "no long, resource_type string, acquired_us long, hold_us long")
    for bucket in (1, 7, 100, 10_000):
        for r in S.resource_hold_stats(log, bucket_us=bucket).collect():
            own = [(a, a + h) for _, kind, a, h in rows if kind == r.resource_type]
            assert r.most_held == max(sum(a <= t < b for a, b in own) for t in range(600)) and r.acquired == len(own)


def test_timeline_walk(spark):
    """Late and early cues, a tolerance, clips that are missing or empty, in a media that reaches over many batches, and one of a single cue."""
    draw = random.Random(7)
    cues = [(1, n + 1, n * 1000 + draw.randrange(900), n * 1000 + 950, f"t{n}") for n in range(2500)] + [(2, 1, 5, 9, None)]
    clips = [(1, n + 1, draw.randrange(300, 1600), draw.random() < 0.1) for n in range(2500) if n % 9]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = L.playout_timeline(
            spark.createDataFrame(cues, "media_id long, cue_no int, start_us long, end_us long, text string").repartition(6),
            spark.createDataFrame(clips, "media_id long, index int, clip_us long, is_empty boolean"), 50,
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own, want, now, number = {c[1]: c for c in clips}, [], 0, 0
    for media, n, start, end, text in cues:
        clip = own.get(n) if media == 1 else None
        now, number = (0, 0) if n == 1 else (now, number)
        if start - now > 50:
            want.append((media, number, now, start, True, "gap", n, text))
            now, number = start, number + 1
        until = now + (clip[2] if clip else end - start)
        want.append((media, number, now, until, clip[3] if clip else True, "clip" if clip else "missing", n, text))
        now, number = until, number + 1
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == want


def test_chunked_audio(spark):
    chunks = spark.createDataFrame([(1, k, 10, [float(10 * k + i) for i in range(10)]) for k in range(3)], "media_id int, chunk_no bigint, sample_rate int, samples array<double>")
    cues = spark.createDataFrame([(1, 1, 500_000, 2_300_000), (1, 2, 2_900_000, 9_000_000)], "media_id int, cue_no int, start_us bigint, end_us bigint")
    got = {r["cue_no"]: r["samples"] for r in A.cut_by_cue(chunks, cues, 1_000_000).collect()}
    assert got == {1: [float(i) for i in range(5, 23)], 2: [29.0]}
    loud = spark.createDataFrame([([0.0, 0.5, 0.0],), ([0.0],), ([],)], "s array<double>").select(A.trim_silence(F.col("s")).alias("t"), A.normalize_volume(F.col("s")).alias("v"), A.is_silence(F.col("s")).alias("q")).collect()
    assert [r["t"] for r in loud] == [[0.5], [0.0], []] and [r["q"] for r in loud] == [False, True, True] and loud[1]["v"] == [0.0]


def test_centred_frames(spark):
    """Levels and volume of clips of no, one and many frames, against plain Python."""
    clips = [[], [0.25], [0.0] * 9, [((i * 37) % 11 - 5) / 20 for i in range(53)], [0.5] * 10 + [0.0] * 90]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(clips)], "i int, s array<double>")
    got = rows.select("i", A.frame_levels(F.col("s"), 16, 4).alias("levels"), A.normalize_volume(F.col("s"), 0.15, 16, 4).alias("v")).collect()
    for i, levels, v in got:
        padded = [0.0] * 8 + clips[i] + [0.0] * 8
        want = [math.sqrt(sum(x * x for x in padded[k : k + 16]) / 16) for k in range(0, len(clips[i]) + 1, 4)]
        assert levels == pytest.approx(want)
        heard = [x for x in want if x > 0]
        gain = min(10.0, max(0.1, 0.15 * len(heard) / sum(heard))) if heard else None
        assert v == pytest.approx([x if gain is None else math.tanh(x * gain * 0.95) * 0.95 for x in clips[i]])


def test_pairing_and_paths(spark):
    files = spark.createDataFrame([(p,) for p in ("/m/a.mp4", "/m/a.MKV", "/m/a.vtt", "/m/a.srt", "/m/b.mp4", "/m/b_en.srt", "/m/c.mp4")], "path string")
    assert sorted(map(tuple, P.pair_media_subtitles(files).collect())) == [("/m/a.MKV", "/m/a.srt"), ("/m/a.mp4", "/m/a.vtt")]
    assert dict(P.match_subtitle_prefix(files).collect())["/m/b.mp4"] == "/m/b_en.srt"
    assert {r[0] for r in P.unmatched_media(files).collect()} == {"/m/b.mp4", "/m/c.mp4"}
    assert P.plan_paths(files.limit(1), "/out").first()["paths"]["aligned_srt"] == "/out/a/aligned/a_aligned.srt"
    tasks = spark.createDataFrame([("t1", "my clip"), ("t2", "b")], "task_id string, stem string")
    assert dict(P.match_task_names(tasks, spark.createDataFrame([("my_clip!",), ("my-clip",), ("b",)], "name string")).collect()) == {"my_clip!": None, "my-clip": "t1", "b": "t2"}


def test_documents(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"success": true, "tts_audio_segments": [{"index": 1, "duration": 2.5, "is_empty": false}, {"duration": 1}]}')
    (tmp_path / "r" / "b.json").write_text('{"success": false, "tts_audio_segments": [{"index": 9, "duration": 2.5}]}')
    assert [(r["index"], r["is_silence"]) for r in J.read_synth_results(spark, str(tmp_path / "r")).collect()] == [(1, False)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "step_status.json").write_text('{"0": {"step_id": 0, "status": "completed", "result_files": ["x"]}, "1": {"step_id": 1, "status": "failed"}}')
    assert sorted((r["step_id"], r["status"]) for r in J.read_step_status(spark, str(tmp_path / "s")).collect()) == [(0, "completed"), (1, "failed")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "new.json").write_text('{"metadata": {"version": "2.0"}, "task": {"task_id": "t", "current_step": 2, "status": "processing", "progress": 25.0, "step_results": {"0": {"success": true}, "1": {"success": false}}}}')
    (tmp_path / "t" / "old.json").write_text('{"completed_steps": {"preprocess_subtitle": {"completed": true}, "separate_media": {"completed": true}, "generate_tts": {"completed": false}}, "file_paths": {}}')
    got = {r["document"].split("/")[-1]: (r["current_step"], r["progress"], r["completed_steps"]) for r in J.read_task_docs(spark, str(tmp_path / "t")).collect()}
    assert got == {"new.json": (2, 25.0, [0]), "old.json": (2, 25.0, [0, 1])}
    (tmp_path / "log.txt").write_text("2024-01-01 - INFO - task t7 success\nnoise\n2024-01-01 - ERROR - task t8 broke\n")
    assert [(r["level"], r["task"]) for r in J.read_log_lines(spark, str(tmp_path / "log.txt")).collect()] == [("INFO", "t7"), ("ERROR", None)]


def test_stages(spark):
    cues = D.cues(spark, SF)
    refs = spark.createDataFrame([], "media_id bigint, index int, file_path string")
    out = run_stages({"cues": cues, "clips": D.clips(cues), "media": D.media(cues), "references": refs})
    assert out["mux"].count() == cues.select("media_id").distinct().count() and out["speed_plan"].count() > 0
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "n int, text string")
    assert [r["piece"] for r in text_pipeline(texts.filter("n < 3"), str.upper).collect()] == ["A B", None]
    got = text_pipeline(texts, lambda t: [1 / len(t) and w for w in t.split()] if t != "c" else None).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", None), (1, 1, "b", None), (2, None, None, None)]
    failed = text_pipeline(texts, lambda t: t[0]).collect()
    assert [(r["n"], r["piece"], (r["error"] or "").split(":")[0]) for r in failed] == [(1, "a", ""), (2, None, ""), (3, None, "IndexError"), (4, "c", "")]


def test_longer_stems_without_pairs_of_a_folder(spark):
    names = ["b.mp4", "b.s.mp4", "none.mkv", "é.mp4", "é.mkv", "b.srt.x", "b.szz.srt", "b_en-x.srt", "b_en.srt", "éa.vtt", "xb.srt", "same.mp4", "same.vtt", "same2.srt", "b.s.srtx"]
    files = spark.createDataFrame([(f"/m{d}/{n}",) for d in (1, 2) for n in names if d == 1 or n != "b_en.srt"], "path string")
    got = P.match_subtitle_prefix(files)
    want = {"b.mp4": "b.szz.srt", "b.s.mp4": "b.szz.srt", "none.mkv": None, "é.mp4": "éa.vtt", "é.mkv": "éa.vtt", "same.mp4": "same.vtt"}
    assert dict(got.collect()) == {f"/m{d}/{m}": s and f"/m{d}/{s}" for d in (1, 2) for m, s in want.items()}
    assert "StartsWith" not in got._jdf.queryExecution().optimizedPlan().toString()


def _walked_styles(rows):
    """merge_repeated_style of one media, row after row."""
    names, out, i = sorted({r[1] for r in rows}), [], 0
    while i < len(rows):
        now = list(rows[i])
        if len(names) > 1 and i + 1 < len(rows) and rows[i + 1][1] == now[1]:
            again, other = rows[i + 1], next(s for s in names if s != now[1])
            target = next((r for r in reversed(out) if r[1] == other), None)
            if target is not None:
                target[3] = ", ".join(t for t in (target[3], again[3]) if t)
                target[2] = now[2] = again[2]
            i += 1
        out.append(now)
        i += 1
    return [tuple(r) for r in out]


def test_styles_do_not_follow_themselves(spark):
    draw = random.Random(8)
    media = {m: [(n, draw.choice("abcd"[: m % 5] or "a"), n * 10, draw.choice(["", f"t{n}", f"u{n}"])) for n in range(draw.randrange(1, 40))] for m in range(40)}
    cues = spark.createDataFrame([(m, *r) for m, rows in media.items() for r in rows], "media_id int, cue_no int, style string, end_us long, text string")
    got = R.merge_repeated_style(cues.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted((m, *r) for m, rows in media.items() for r in _walked_styles(rows))
    assert "FlatMapGroupsInPandas" not in R.merge_repeated_style(cues)._jdf.queryExecution().executedPlan().toString()


def test_tracks_meet_at_the_nearest_start(spark):
    draw = random.Random(9)
    track = [(m, n, draw.randrange(200)) for m in range(3) for n in range(80)] + [(9, 1, 5)]
    other = [(m, n, draw.randrange(0, 200, 3)) for m in range(3) for n in range(60)] + [(8, 1, 5)]
    frames = [spark.createDataFrame(rows, "media_id int, cue_no int, start_us long") for rows in (track, other)]
    for tolerance in (1, 2, 7):
        want = []
        for m, n, at in track:
            near = min(((abs(s - at), s, k) for k_m, k, s in other if k_m == m and abs(s - at) < tolerance), default=None)
            want.append((m, n, *((near[2], near[1] - at) if near else (None, None))))
        assert sorted(map(tuple, R.pair_tracks(*frames, tolerance).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["text_stats", "process_text", "basic_clean", "split_length", "preprocess_cues"])
def test_a_file_of_one_row_group_is_worked_on_by_many_tasks(spark, name):
    """the texts of a file are dealt out before they are worked on, not after."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " in plan or "RepartitionByExpression" in plan
    below = plan[plan.index("Repartition") :]
    assert "regexp_replace" not in below.split("Relation")[0] and "transform" not in below
