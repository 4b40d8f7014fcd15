"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

# Fixed values, written out here so that the SQL takes nothing from the code that it is compared with: words, terms, ends, failures, formats, error texts, steps.
SIGN_WORDS = {"&": "和", "®": "", "™": "", "©": "", "℃": "摄氏度", "℉": "华氏度", "€": "欧元", "$": "美元", "£": "英镑", "¥": "人民币", "@": "艾特", "#": "井号"}
TERMS = {
    "AI": "人工智能", "API": "应用程序接口", "URL": "网址", "CPU": "中央处理器", "GPU": "图形处理器",
    "iPhone": "苹果手机", "iPad": "苹果平板", "Android": "安卓", "Windows": "视窗系统", "macOS": "苹果系统",
}
SENTENCE_ENDS, CLAUSE_ENDS = "。！？；.!?;", "，。！？；：,.:;!?"
FAILURES = [
    (["out of memory", "cuda out of memory"], "memory"),
    (["no cuda capable", "cuda device"], "no_device"),
    (["unsupported format", "codec not supported"], "codec"),
    (["invalid argument", "invalid data"], "invalid_input"),
    ([("decoder", "not found"), ("decoder", "unavailable")], "no_decoder"),
    (["permission denied"], "permission"),
    (["busy", "device busy"], "busy"),
    (["hardware accelerated", "hwaccel"], "acceleration"),
    (["format not supported", "pixel format"], "pixel_format"),
    (["cannot initialize", "initialization failed"], "initialization"),
    (["nvenc", "nvdec"], "hardware_codec"),
    (["driver"], "driver"),
    (["timeout"], "timeout"),
    (["connection refused", "device not found"], "connection"),
    (["resource temporarily unavailable"], "unavailable"),
    (["impossible to convert between", "auto_scale"], "conversion"),
    (["function not implemented"], "not_implemented"),
]
FORMATS = {
    ".srt": "SubRip Text", ".ass": "Advanced SubStation Alpha", ".ssa": "SubStation Alpha", ".vtt": "WebVTT", ".sub": "MicroDVD/SubViewer", ".lrc": "LRC Lyrics",
    ".sbv": "YouTube SBV", ".smi": "SAMI", ".sami": "SAMI", ".ttml": "Timed Text Markup Language", ".dfxp": "Distribution Format Exchange Profile", ".txt": "Plain Text",
}
VIDEO_EXTENSIONS = ["mp4", "avi", "mov", "mkv", "wmv", "flv", "m4v", "webm", "ts"]
SUBTITLE_EXTENSIONS = ["srt", "ass", "ssa", "sub", "vtt"]
MESSAGES = [
    "CUDA out of memory", "no CUDA capable device", "unsupported format", "Invalid argument", "decoder not found", "Permission denied", "device busy", "hwaccel failed", "pixel format wrong",
    "cannot initialize", "nvenc trouble", "driver too old", "timeout reached", "connection refused", "resource temporarily unavailable", "impossible to convert between", "function not implemented", "ffmpeg error 1", "something else", "",
]
STEP_COUNT = 8

CUES = """cues AS (
  SELECT conv_id AS media_id, (turn + 1)::INTEGER AS cue_no, s * 1000 AS start_us, (s + 500 + n * 37 % 4200) * 1000 AS end_us, coalesce(text, '') AS text,
         role AS style FROM (SELECT *, turn * 4000 + n % 900 AS s FROM (SELECT *, coalesce(length(text), 0)::BIGINT AS n FROM conversations)))"""
CLIPS = """clips AS (
  SELECT media_id, cue_no, (end_us - start_us) // 1000 * p // 100 * 1000 AS clip_us, (media_id + cue_no) % 17 = 0 AS is_empty FROM (
    SELECT *, CASE media_id % 3 WHEN 0 THEN 85 + (cue_no * 13 + media_id * 7) % 30 WHEN 1 THEN 140 + (cue_no * 13 + media_id * 7) % 20
                                ELSE 20 + (cue_no * 67 + media_id * 7) % 200 END AS p FROM cues) WHERE (media_id * 7 + cue_no) % 11 <> 0)"""
LENGTHS = """lengths AS (
  SELECT c.*, end_us - start_us AS old_us, coalesce(clip_us, end_us - start_us) AS new_us, clip_us IS NOT NULL AS has_clip, clip_us, is_empty,
         greatest(coalesce(lead(start_us) OVER (PARTITION BY media_id ORDER BY cue_no) - end_us, 0), 0) AS gap_us
  FROM cues c LEFT JOIN clips USING (media_id, cue_no))"""
CHOICE = """choice AS (
  SELECT media_id, sum(old_us)::BIGINT AS old_total, sum(new_us)::BIGINT AS new_total, avg(new_us / old_us) AS avg_ratio, var_pop(new_us / old_us) AS var_ratio FROM lengths GROUP BY 1),
strategies AS (
  SELECT *, CASE WHEN var_ratio < 0.1 AND avg_ratio BETWEEN 0.8 AND 1.2 THEN 'gap_preserving' WHEN var_ratio < 0.1 THEN 'proportional' ELSE 'cumulative' END AS strategy FROM choice)"""
BASE = f"WITH RECURSIVE {CUES}, {CLIPS}, {LENGTHS}, {CHOICE}"


def _retimed(strategy: str) -> str:
    return f"""retimed AS (
  SELECT media_id, cue_no, text, {strategy} AS strategy, coalesce(sum(new_us + gap) OVER (PARTITION BY media_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start_us, new_us
  FROM (SELECT *, CASE WHEN {strategy} = 'cumulative' OR old_total = 0 THEN gap_us ELSE floor(gap_us * new_total / old_total)::BIGINT END AS gap
        FROM lengths JOIN strategies USING (media_id)))"""


PLAYOUT = """q AS (SELECT media_id, cue_no, start_us, old_us, text, clip_us, is_empty FROM lengths),
r AS (
  SELECT q.*, 0::BIGINT AS now_us, CASE WHEN start_us > 10000 THEN start_us ELSE 0 END AS at_us FROM q WHERE cue_no = 1
  UNION ALL
  SELECT q.*, r.at_us + coalesce(r.clip_us, r.old_us), CASE WHEN q.start_us - (r.at_us + coalesce(r.clip_us, r.old_us)) > 10000 THEN q.start_us ELSE r.at_us + coalesce(r.clip_us, r.old_us) END
  FROM r JOIN q ON q.media_id = r.media_id AND q.cue_no = r.cue_no + 1),
played AS (
  SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY cue_no, part) - 1)::INTEGER AS seg_no FROM (
    SELECT media_id, cue_no, 0 AS part, now_us AS start_us, at_us AS end_us, true AS is_silence, 'gap' AS kind FROM r WHERE at_us > now_us
    UNION ALL
    SELECT media_id, cue_no, 1, at_us, at_us + coalesce(clip_us, old_us), coalesce(is_empty, true), CASE WHEN clip_us IS NULL THEN 'missing' ELSE 'clip' END FROM r))"""


def _segments(name: str, cues: str) -> str:
    """fill_gaps of a table (media_id, cue_no, start_us, end_us) whose media last up to three seconds longer."""
    return f"""{name} AS (
  SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY by_cue, part) - 1)::INTEGER AS seg_no, kind, cue_no, start_us, end_us, end_us - start_us AS duration_us FROM (
    SELECT media_id, cue_no AS by_cue, 0 AS part, CASE WHEN row_number() OVER w = 1 THEN 'prefix' ELSE 'gap' END AS kind, NULL::INTEGER AS cue_no, lag(end_us, 1, 0) OVER w AS start_us, start_us AS end_us
    FROM {cues} WINDOW w AS (PARTITION BY media_id ORDER BY cue_no)
    UNION ALL SELECT media_id, cue_no, 1, 'subtitle', cue_no, start_us, end_us FROM {cues}
    UNION ALL SELECT c.media_id, c.cue_no, 2, 'suffix', NULL, c.end_us, m.last + c.media_id % 3 * 1000000
    FROM {cues} c JOIN (SELECT media_id, max(end_us) AS last, max(cue_no) AS n FROM {cues} GROUP BY 1) m ON m.media_id = c.media_id AND m.n = c.cue_no
    WHERE m.last + c.media_id % 3 * 1000000 >= c.end_us))"""


TRACKS = f"""{_retimed("'cumulative'")},
newcues AS (SELECT media_id, cue_no, new_start_us AS start_us, new_start_us + new_us AS end_us FROM retimed),
{_segments('a', 'cues')}, {_segments('b', 'newcues')},
merged AS (
  SELECT media_id, seg_no, coalesce(a.kind, b.kind) AS kind, CASE WHEN a.kind IS NULL THEN b.cue_no ELSE coalesce(a.cue_no, b.cue_no) END AS cue_no, coalesce(a.start_us, b.start_us) AS start_us,
         coalesce(a.end_us, b.end_us) AS end_us, coalesce(a.duration_us, b.duration_us) AS duration_us,
         CASE WHEN agree THEN coalesce(b.start_us, a.start_us) END AS new_start_us, CASE WHEN agree THEN coalesce(b.end_us, a.end_us) END AS new_end_us, CASE WHEN agree THEN coalesce(b.duration_us, a.duration_us) END AS new_duration_us
  FROM (SELECT media_id, seg_no, a, b, a.kind IS NULL OR b.kind IS NULL OR ((a.kind = 'subtitle') = (b.kind = 'subtitle')) AS agree FROM a FULL JOIN b USING (media_id, seg_no)))"""
ISLANDS = """islands AS (
  SELECT *, sum(CASE WHEN seg_no = 0 OR NOT (duration_us < 300000 OR coalesce(new_duration_us, 0) < 300000) THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seg_no) AS island FROM merged),
short AS (
  SELECT media_id, (island - 1)::INTEGER AS seg_no, arg_min(kind, seg_no) AS kind, (list(cue_no ORDER BY seg_no))[1] AS cue_no, min(start_us) AS start_us, max(end_us) AS end_us, max(end_us) - min(start_us) AS duration_us,
         min(new_start_us) AS new_start_us, max(new_end_us) AS new_end_us, max(new_end_us) - min(new_start_us) AS new_duration_us, count(*) AS parts
  FROM islands GROUP BY media_id, island)"""
PLAN = """plan AS (
  SELECT *, sum(target_us) OVER (PARTITION BY media_id ORDER BY seg_no)::BIGINT AS target_end_us,
         CASE WHEN target_us > 0 THEN round(duration_us / target_us, 8) WHEN duration_us > 0 THEN 1.0 ELSE 0.0 END AS speed_ratio
  FROM (SELECT *, coalesce(new_duration_us, duration_us) AS target_us FROM short))"""

EVENTS = """ev AS (
  SELECT event_id AS sequence, ts AS event_time, user_id % 20 AS task_id, CASE WHEN k % 10 <> 9 THEN k % 8 END AS step_id, k, kind,
         CASE WHEN k % 10 <> 9 THEN 'step_' ELSE 'task_' END || kind AS event_type, least(floor(value), 100)::INTEGER AS current_item, 100 AS total_items,
         CASE WHEN kind = 'failed' THEN 'error ' || k END AS error_message
  FROM (SELECT *, (props->>'$.k')::INTEGER AS k, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind FROM events))"""
QUEUE = """CASE WHEN event_type LIKE '%progress%' THEN 'progress' WHEN event_type LIKE 'task%' THEN 'task' WHEN event_type LIKE 'step%' THEN 'step' ELSE 'other' END"""
STEPS = """steps AS (
  SELECT *, CASE WHEN status = 'completed' THEN 100.0::DOUBLE WHEN total_items > 0 THEN current_item * 100.0::DOUBLE / total_items ELSE 0.0::DOUBLE END AS progress FROM (
    SELECT task_id, step_id, arg_max(CASE kind WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'processing' END, sequence) AS status,
           arg_max(CASE kind WHEN 'started' THEN 0 WHEN 'completed' THEN total_items ELSE current_item END, sequence) FILTER (kind <> 'failed') AS current_item,
           arg_max(total_items, sequence) FILTER (kind <> 'failed') AS total_items, arg_max(error_message, sequence) FILTER (kind = 'failed') AS error_message,
           max(event_time) FILTER (kind = 'started') AS started_at, max(event_time) AS updated_at, count(*) AS events
    FROM ev WHERE step_id IS NOT NULL GROUP BY task_id, step_id))"""
RESUME = f"""resume AS (
  SELECT t.task_id, coalesce(min(n.step) FILTER (s.status IS DISTINCT FROM 'completed'), {STEP_COUNT})::INTEGER AS step
  FROM (SELECT DISTINCT task_id FROM steps) t CROSS JOIN (SELECT unnest(range({STEP_COUNT})) AS step) n LEFT JOIN steps s ON s.task_id = t.task_id AND s.step_id = n.step GROUP BY 1)"""
TASKS = f"""tasks AS (
  SELECT task_id, coalesce(arg_max(CASE kind WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'processing' END, sequence) FILTER (event_type LIKE 'task%'), 'processing') AS status,
         coalesce(any_value(d.n), 0) * 100.0::DOUBLE / {STEP_COUNT} AS progress, coalesce(any_value(d.n), 0) AS steps_done,
         arg_max(error_message, sequence) FILTER (event_type = 'task_failed') AS error_message, min(event_time) AS first_at, max(event_time) AS updated_at
  FROM ev LEFT JOIN (SELECT task_id, count(*) FILTER (status = 'completed') AS n FROM steps GROUP BY 1) d USING (task_id) GROUP BY task_id)"""
LOG, STATE = f"WITH RECURSIVE {EVENTS}", f"WITH RECURSIVE {EVENTS}, {STEPS}, {RESUME}, {TASKS}"
ATTEMPTS = """tries AS (
  SELECT *, row_number() OVER (PARTITION BY task_id, segment ORDER BY attempt) AS n FROM (
    SELECT user_id % 20 AS task_id, (props->>'$.k')::INTEGER AS segment, event_id AS attempt, event_type = 'purchase' AS success FROM events WHERE event_type IN ('purchase', 'error'))),
outcome AS (SELECT task_id, segment, bool_or(success) AS success, coalesce(min(n) FILTER (success), max(n))::INTEGER AS tries FROM tries WHERE n <= 6 GROUP BY 1, 2)"""
LISTING = """listing AS (
  SELECT '/m/' || g % 7 || '/clip' || g || CASE WHEN r = 0 THEN '.mp4' WHEN r = 1 THEN '.srt' WHEN r = 2 AND g % 3 = 0 THEN '.ass' WHEN r = 2 THEN '.log' WHEN g % 5 = 0 THEN '.mkv' ELSE '.vtt' END AS path
  FROM (SELECT page_id // 4 AS g, page_id % 4 AS r FROM pages)),
parts AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem, lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS ext FROM listing)""".replace("\\\\", "\\")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SIDES = f"""{LISTING},
media AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY path) AS rank FROM parts WHERE list_contains({_list(VIDEO_EXTENSIONS)}, ext)),
subs AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY list_position({_list(SUBTITLE_EXTENSIONS)}, ext), path) AS rank FROM parts WHERE list_contains({_list(SUBTITLE_EXTENSIONS)}, ext))"""
AUDIO = """au AS (SELECT label AS media_id, vec_id + 1 AS index, list_transform(embedding::DOUBLE[], lambda x: x * CASE WHEN vec_id % 5 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END) AS s FROM embeddings),
ab AS (SELECT *, len(s) AS n, list_transform(s, lambda x: abs(x)) AS a, sqrt(list_sum(list_transform(s, lambda x: x * x)) / len(s)) AS rms FROM au),
ac AS (SELECT *, len(list_filter(a, lambda x: x < 0.01::DOUBLE)) / n AS silence_ratio, len(list_filter(a, lambda x: x > 0.01::DOUBLE)) AS loud FROM ab),
ad AS (SELECT *, rms < 0.005 OR silence_ratio > 0.8 AS is_silence, least(1.0, (CASE WHEN n / 32 BETWEEN 0.5 AND 3 THEN 1.0 WHEN n / 32 < 0.5 THEN n / 32 / 0.5 ELSE greatest(0.1, 3.0 / (n / 32)) END) * 0.3
         + least(1.0, rms / 0.1) * 0.3 + least(1.0, (list_max(a) - list_sum(a) / n) / 0.5) * 0.2 + greatest(0.1, 1.0 - silence_ratio) * 0.2) AS quality FROM ac),
ae AS (SELECT *, CASE WHEN is_silence THEN 0.0 ELSE quality END AS score FROM ad)"""


def _time(us: str, fmt: str) -> str:
    h, m, s = f"({us} // 3600000000 % 24)", f"({us} // 60000000 % 60)", f"({us} // 1000000 % 60)"
    ms, cs = f"({us} // 1000 % 1000)", f"({us} // 10000 % 100)"
    return {
        "srt": f"printf('%02d:%02d:%02d,%03d', {h}, {m}, {s}, {ms})", "vtt": f"printf('%02d:%02d:%02d.%03d', {h}, {m}, {s}, {ms})", "sbv": f"printf('%02d:%02d:%02d.%03d', {h}, {m}, {s}, {ms})",
        "ass": f"printf('%d:%02d:%02d.%02d', {h}, {m}, {s}, {cs})", "lrc": f"printf('[%02d:%02d.%02d]', {h} * 60 + {m}, {s}, {cs})",
    }[fmt]


LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
#: What a format keeps: its times in microseconds, and its texts.
_KEPT = {
    "srt": ("start_us // 1000 * 1000", "end_us // 1000 * 1000", "'Default'"), "vtt": ("start_us // 1000 * 1000", "end_us // 1000 * 1000", "'Default'"), "sbv": ("start_us // 1000 * 1000", "end_us // 1000 * 1000", "'Default'"),
    "ass": ("start_us // 10000 * 10000", "end_us // 10000 * 10000", "style"), "lrc": ("start_us // 10000 * 10000", "start_us // 10000 * 10000 + 3000000", "'Default'"),
    "txt": ("(row_number() OVER w - 1) * 3000000", "row_number() OVER w * 3000000", "'Default'"),
}


def _roundtrip(fmt: str) -> str:
    start, end, style = _KEPT[fmt]
    order = "start_us // 10000, style, cue_no" if fmt == "ass" else "cue_no"
    return f"""WITH {CUES} SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY {order}))::INTEGER AS cue_no, {start} AS start_us, {end} AS end_us, {LINE} AS text, {style} AS style FROM cues
    WINDOW w AS (PARTITION BY media_id ORDER BY cue_no)"""


def _documents(*columns: str) -> str:
    return f"SELECT doc_id, {', '.join(columns)} FROM documents"


def _replaced(pairs: dict[str, str]) -> str:
    out = "text"
    for k, v in pairs.items():
        out = f"replace({out}, '{k}', '{v}')"
    return out


def _share(kind: str) -> str:
    return f"length(regexp_replace(t, '[^{kind}]', '', 'g')) / greatest(length(t), 1)"


def _failure() -> str:
    def has(part) -> str:
        return " AND ".join(f"contains(m, '{p}')" for p in ([part] if isinstance(part, str) else part))

    whens = " ".join(f"WHEN {' OR '.join(f'({has(p)})' for p in parts)} THEN '{reason}'" for parts, reason in FAILURES)
    return f"""SELECT CASE {whens} WHEN contains(m, 'ffmpeg error') AND length(m) < 50 THEN 'encoder' ELSE 'other' END AS reason, count(*) AS failures
    FROM (SELECT lower({_list(MESSAGES)}[event_id % 20 + 1]) AS m FROM events WHERE event_type = 'error') GROUP BY 1"""


def _dedup(keys: str, only: str, short_us: int, long_us: int) -> str:
    """Events that are accepted, found by going from each key's last accepted one to the next that is far enough behind it."""
    return f"""{LOG},
    x AS (SELECT *, epoch_us(event_time) AS at_us, CASE WHEN event_type IN ('step_started', 'step_completed', 'step_failed', 'task_completed', 'task_failed') THEN {short_us} ELSE {long_us} END AS window_us,
                 row_number() OVER (PARTITION BY {keys} ORDER BY event_time, sequence) AS n FROM ev WHERE {only}),
    go AS (SELECT x.*, at_us AS last_us, true AS taken FROM x WHERE n = 1
           UNION ALL SELECT x.*, CASE WHEN x.at_us - go.last_us >= x.window_us THEN x.at_us ELSE go.last_us END, x.at_us - go.last_us >= x.window_us
           FROM go JOIN x ON x.n = go.n + 1 AND {' AND '.join(f'x.{k} IS NOT DISTINCT FROM go.{k}' for k in keys.split(', '))})"""


_STAT = "round(avg_ratio, 6) AS avg_ratio, round(var_ratio, 6) AS var_ratio"
ORACLE_SQL: dict[str, str] = {
    "cue_gaps": f"{BASE} SELECT media_id, cue_no, gap_us FROM lengths",
    "cue_summary": f"{BASE} SELECT media_id, count(*) AS cues, max(end_us) AS last_end_us FROM cues GROUP BY 1",
    "time_formats": f"{BASE} SELECT media_id, cue_no, {', '.join(f'{_time("start_us", f)} AS {f}' for f in ('srt', 'ass', 'vtt', 'lrc', 'sbv'))} FROM cues",
    "shifted_cues": f"{BASE}, m AS (SELECT media_id, cue_no, (start_us - 2500000 + 86400000000) % 86400000000 AS start_us, (end_us - 2500000 + 86400000000) % 86400000000 AS end_us FROM cues) SELECT * FROM m WHERE start_us < end_us",
    "choose_retiming": f"{BASE} SELECT media_id, {_STAT}, strategy FROM strategies",
    "duration_change_stats": f"""{BASE} SELECT media_id, count(*) AS cues, sum(old_us)::BIGINT AS old_total_us, sum(new_us)::BIGINT AS new_total_us, count(*) FILTER (has_clip) AS found, count(*) FILTER (NOT has_clip) AS missing,
        round(avg(new_us / old_us), 6) AS avg_ratio, round(min(new_us / old_us), 6) AS min_ratio, round(max(new_us / old_us), 6) AS max_ratio, round((sum(new_us) - sum(old_us)) * 100.0::DOUBLE / sum(old_us), 6) AS change_percent FROM lengths GROUP BY 1""",
    "sync_track_times": f"""{BASE}, {_retimed("'cumulative'")},
        t AS (SELECT *, coalesce(sum((style = 'user')::INTEGER) OVER (PARTITION BY media_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cues)
        SELECT t.media_id, t.cue_no, coalesce(r.new_start_us, t.start_us) AS start_us, coalesce(r.new_start_us + r.new_us, t.end_us) AS end_us FROM t LEFT JOIN retimed r ON r.media_id = t.media_id AND r.cue_no = t.o + 1""",
    "playout_timeline": f"{BASE}, {PLAYOUT} SELECT media_id, seg_no, start_us, end_us, is_silence, kind FROM played",
    "playout_starts": f"""{BASE}, q AS (SELECT media_id, cue_no, start_us, new_us FROM lengths),
        r AS (SELECT q.*, start_us AS play_us FROM q WHERE cue_no = 1 UNION ALL SELECT q.*, greatest(q.start_us, r.play_us + r.new_us) FROM r JOIN q ON q.media_id = r.media_id AND q.cue_no = r.cue_no + 1)
        SELECT media_id, cue_no, play_us FROM r""",
    "timeline_summary": f"{BASE}, {PLAYOUT} SELECT media_id, count(*) AS segments, count(*) FILTER (is_silence) AS silent, count(*) FILTER (NOT is_silence) AS spoken, max(end_us) AS duration_us FROM played GROUP BY 1",
    "align_by_position": f"""{BASE}, {PLAYOUT}, s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_no) AS n FROM played WHERE NOT is_silence)
        SELECT s.media_id, s.n::INTEGER AS cue_no, s.start_us, s.end_us, c.text AS cue_text FROM s JOIN (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY cue_no) AS n FROM cues) c USING (media_id, n)""",
    "fill_gaps": f"{BASE}, {TRACKS} SELECT * FROM a",
    "merge_segments": f"{BASE}, {TRACKS} SELECT * FROM merged",
    "coalesce_short": f"{BASE}, {TRACKS}, {ISLANDS} SELECT * FROM short",
    "speed_plan": f"{BASE}, {TRACKS}, {ISLANDS}, {PLAN} SELECT media_id, seg_no, kind, target_end_us - target_us AS target_start_us, target_end_us, round(speed_ratio, 6) AS speed_ratio FROM plan",
    "speed_commands": f"""{BASE}, {TRACKS}, {ISLANDS}, {PLAN} SELECT media_id, seg_no, round(applied, 5) AS applied, round(1 / applied, 4) AS pts
        FROM (SELECT *, CASE WHEN speed_ratio = 1 THEN 1.0::DOUBLE ELSE speed_ratio * 0.99::DOUBLE END AS applied FROM plan WHERE speed_ratio > 0) WHERE abs(applied - 1) >= 0.01""",
    "concat_quality": f"""{BASE}, {TRACKS}, {ISLANDS}, {PLAN}, {PLAYOUT}, p AS (SELECT media_id, sum(target_us)::BIGINT AS planned_us, count(*) FILTER (speed_ratio <> 1) AS sped_up FROM plan GROUP BY 1),
        t AS (SELECT media_id, max(end_us) AS actual_us FROM played GROUP BY 1)
        SELECT media_id, planned_us, actual_us, abs(planned_us - actual_us) AS off_us, abs(planned_us - actual_us) > 1000000 AS alert, sped_up, round(CASE WHEN planned_us > 0 THEN greatest(0.0, (1 - abs(planned_us - actual_us) / planned_us) * 100) END, 5) AS accuracy
        FROM p LEFT JOIN t USING (media_id)""",
    "mux_plan": f"""{BASE}, {PLAYOUT}, t AS (SELECT media_id, max(end_us) AS audio_us FROM played GROUP BY 1), v AS (SELECT media_id, max(end_us) + media_id % 3 * 1000000 AS video_us FROM cues GROUP BY media_id)
        SELECT media_id, video_us, audio_us, greatest(video_us, audio_us) AS final_us, CASE WHEN video_us < audio_us THEN 'video' WHEN audio_us < video_us THEN 'audio' ELSE 'none' END AS padded, abs(video_us - audio_us) AS pad_us FROM v JOIN t USING (media_id)""",
    "mix_plan": f"""{BASE}, {PLAYOUT}, m AS (SELECT *, floor(max(end_us) OVER (PARTITION BY media_id) * 16000 / 1000000)::BIGINT AS track_samples, floor(start_us * 16000 / 1000000)::BIGINT AS from_sample, floor((end_us - start_us) * 16000 / 1000000)::BIGINT AS size FROM played)
        SELECT media_id, seg_no, track_samples, from_sample, least(from_sample + size, track_samples) AS to_sample FROM m""",
    "ass_styles": f"WITH {CUES} SELECT media_id, string_agg(DISTINCT style, ',' ORDER BY style) AS styles FROM cues GROUP BY 1",
    "convert_format": f"""WITH {CUES} SELECT media_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg({_time('start_us', 'vtt')} || ' --> ' || {_time('end_us', 'vtt')} || chr(10) || {LINE} || chr(10) || chr(10), '' ORDER BY cue_no)) AS digest FROM cues GROUP BY 1""",
    "detect_language": f"""SELECT doc_id, CASE WHEN regexp_matches(t, '[가-힯]') THEN 'ko' WHEN regexp_matches(t, '[぀-ヿ]') THEN 'ja' WHEN {_share('一-鿿')} > 0.3 AND {_share('a-zA-Z')} > 0.2 THEN 'mixed'
        WHEN {_share('一-鿿')} > 0.3 THEN 'zh' WHEN {_share('a-zA-Z')} > 0 THEN 'en' ELSE 'unknown' END AS language FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)""",
    "strip_brackets": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'),
        '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '\{[^}]*\}', '', 'g'), '<[^>]*>', '', 'g'), '（[^）]*）', '', 'g'), '【[^】]*】', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""",
    "spell_symbols": _documents(f"md5({_replaced(SIGN_WORDS)}) AS digest"),
    "replace_terms": _documents(f"md5({_replaced(TERMS)}) AS digest"),
    "space_capitals": _documents(r"md5(CASE WHEN regexp_matches(text, '^[A-Z]') THEN substr(regexp_replace(text, '([A-Z])', ' \1', 'g'), 2) ELSE regexp_replace(text, '([A-Z])', ' \1', 'g') END) AS digest"),
    "split_sentences": f"""SELECT doc_id, len(p)::INTEGER AS pieces, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::INTEGER AS longest FROM (SELECT doc_id,
        list_filter(list_transform(regexp_extract_all(text, '(?s)[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM documents)""",
    "split_punctuation": f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?s)[^{CLAUSE_ENDS}]*[{CLAUSE_ENDS}]|[^{CLAUSE_ENDS}]+$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''))::INTEGER AS pieces FROM documents""",
    "split_length": r"""SELECT doc_id, CASE WHEN s IS NULL THEN 0 ELSE len(string_split(s, chr(1))) END::INTEGER AS pieces, md5(coalesce(replace(s, chr(1), '|'), '')) AS digest FROM (SELECT doc_id,
        CASE WHEN len(w) > 0 THEN list_reduce(w, lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + 1 + length(x) <= 200 THEN a || ' ' || x ELSE a || chr(1) || x END) END AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents))""",
    "validate_text": r"""SELECT doc_id, m IS NULL AS is_valid, m AS error_message FROM (SELECT doc_id, CASE WHEN coalesce(NOT regexp_matches(text, '\S'), true) THEN 'empty text' WHEN length(text) > 2000 THEN 'text too long: ' || length(text) END AS m FROM documents)""",
    "strip_html": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""",
    "sanitize_name": r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '[<>:"/\\|?*]', '_', 'g'), '[@#&%=+]', '_', 'g'), '[.\-\s]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unnamed') AS name FROM pages""",
    "scan_media": f"WITH {LISTING} SELECT DISTINCT path FROM parts WHERE list_contains({_list(VIDEO_EXTENSIONS)}, ext)",
    "supported_formats": f"WITH {LISTING} SELECT path, format FROM parts JOIN (SELECT unnest({_list(k.lstrip('.') for k in FORMATS)}) AS ext, unnest({_list(FORMATS.values())}) AS format) USING (ext)",
    "pair_media_subtitles": f"WITH {SIDES} SELECT m.path AS media, s.path AS subtitle FROM media m JOIN subs s USING (dir, stem, rank)",
    "unmatched_media": f"WITH {SIDES} SELECT path AS media FROM media ANTI JOIN subs USING (dir, stem, rank)",
    "match_prefix": f"""WITH {SIDES} SELECT m.path AS media, coalesce((SELECT arg_min(s.path, s.rank) FROM subs s WHERE s.dir = m.dir AND s.stem = m.stem),
        (SELECT min(s.path) FROM subs s WHERE s.dir = m.dir AND starts_with(s.stem, m.stem))) AS subtitle FROM media m""",
    "audio_measures": f"""WITH {AUDIO} SELECT index, CASE WHEN loud = 0 THEN n ELSE n - list_position(list_transform(list_reverse(a), lambda x: x > 0.01::DOUBLE), true) - list_position(list_transform(a, lambda x: x > 0.01::DOUBLE), true) + 2 END::INTEGER AS trimmed,
        round(rms, 6) AS rms, round(silence_ratio, 6) AS silence_ratio, is_silence, round(quality, 6) AS quality_score FROM ad""",
    "best_segment": f"WITH {AUDIO} SELECT media_id, index, round(score, 6) AS quality_score FROM ae WHERE NOT is_silence QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score DESC, index) = 1",
    "replace_silent": f"""WITH {AUDIO}, best AS (SELECT media_id, index, score, n FROM ae WHERE NOT is_silence QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score DESC, index) = 1)
        SELECT ae.media_id, ae.index, ae.is_silence AND b.index IS NULL AS is_silence, CASE WHEN ae.is_silence THEN b.index END AS replaced_with,
               round(CASE WHEN ae.is_silence AND b.index IS NOT NULL THEN b.score ELSE ae.score END, 6) AS quality_score, (CASE WHEN ae.is_silence AND b.index IS NOT NULL THEN b.n ELSE ae.n END)::INTEGER AS audio_length
        FROM ae LEFT JOIN best b USING (media_id)""",
    "classify_failures": _failure(),
    "route_events": f"{LOG} SELECT {QUEUE} AS queue, event_type, count(*) AS events FROM ev GROUP BY 1, 2",
    "critical_events": f"{LOG} SELECT sequence, task_id, event_type FROM ev WHERE kind IN ('completed', 'failed')",
    "dedup_events": f"{_dedup('task_id, event_type, step_id', 'true', 86_400_000_000, 345_600_000_000)} SELECT sequence, task_id, event_type, step_id FROM go WHERE taken",
    "throttle_progress": f"""{_dedup('task_id, step_id', "event_type = 'step_progress'", 172_800_000_000, 172_800_000_000)} SELECT sequence, task_id, step_id FROM go WHERE taken""",
    "fold_step_state": f"{STATE} SELECT * FROM steps",
    "fold_task_state": f"{STATE} SELECT * FROM tasks",
    "status_lattice": f"""{LOG} SELECT task_id, step_id, CASE WHEN bool_or(kind = 'completed') THEN 'completed' WHEN bool_or(kind = 'failed') THEN 'failed' ELSE 'processing' END AS status FROM ev WHERE step_id IS NOT NULL GROUP BY 1, 2""",
    "step_status_summary": f"""{STATE}, n AS (SELECT task_id, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM steps GROUP BY 1)
        SELECT task_id, processing, completed, failed, {STEP_COUNT} - processing - completed - failed AS pending, completed * 100.0::DOUBLE / {STEP_COUNT} AS percent, step AS current_step FROM n JOIN resume USING (task_id)""",
    "completed_steps": f"{STATE} SELECT task_id, coalesce(string_agg(step_id::VARCHAR, ',' ORDER BY step_id) FILTER (status = 'completed'), '') AS steps FROM steps GROUP BY 1",
    "resume_point": f"{STATE} SELECT task_id, step AS resume_step FROM resume",
    "start_step": f"{STATE} SELECT task_id, CASE WHEN step = {STEP_COUNT} THEN -1 ELSE step END AS start_step FROM resume",
    "reset_after_failure": f"{STATE} SELECT task_id, step_id, CASE WHEN step_id > min(step_id) FILTER (status = 'failed') OVER (PARTITION BY task_id) THEN 'pending' ELSE status END AS status FROM steps",
    "overall_status": f"""{STATE}, n AS (SELECT task_id, count(*) FILTER (status = 'processing') AS p, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'failed') AS f FROM steps GROUP BY 1)
        SELECT task_id, CASE WHEN f > 0 THEN 'failed' WHEN c = {STEP_COUNT} THEN 'done' WHEN p > 0 THEN 'processing' WHEN c > 0 THEN 'in_progress' ELSE 'ready' END AS overall, c || '/{STEP_COUNT}' AS done FROM n""",
    "queue_stats": f"{LOG}, x AS (SELECT task_id, {QUEUE} AS q FROM ev) SELECT task_id, {', '.join(f"count(*) FILTER (q = '{q}') AS n_{q}" for q in ('task', 'step', 'progress', 'other'))}, count(*) AS n_all FROM x GROUP BY ROLLUP (task_id)",
    "processor_stats": f"""{LOG}, x AS (SELECT step_id, kind, current_item::DOUBLE AS s, row_number() OVER (PARTITION BY step_id ORDER BY sequence DESC) AS n FROM ev WHERE step_id IS NOT NULL AND kind IN ('completed', 'failed'))
        SELECT step_id, count(*) AS processed, count(*) FILTER (kind = 'completed') AS succeeded, count(*) FILTER (kind = 'failed') AS failed, min(s) FILTER (n <= 50) AS min_seconds, max(s) FILTER (n <= 50) AS max_seconds,
               round(avg(s) FILTER (n <= 50), 6) AS avg_seconds, round(count(*) FILTER (kind = 'completed') / count(*), 6) AS success_rate FROM x GROUP BY 1""",
    "resource_hold_stats": """WITH l AS (SELECT event_type AS resource_type, epoch_us(ts) AS a, round(value * 1000000)::BIGINT AS h, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events),
        e AS (SELECT resource_type, a AS at_us, 1 AS d FROM l UNION ALL SELECT resource_type, a + h, -1 FROM l),
        m AS (SELECT resource_type, max(held)::BIGINT AS most_held FROM (SELECT resource_type, sum(d) OVER (PARTITION BY resource_type ORDER BY at_us, d) AS held FROM e) GROUP BY 1)
        SELECT resource_type, count(*) AS acquired, any_value(most_held) AS most_held, max(h) FILTER (n <= 1000) AS max_hold_us, round(avg(h) FILTER (n <= 1000), 3) AS avg_hold_us FROM l JOIN m USING (resource_type) GROUP BY 1""",
    "retry_outcome": f"WITH {ATTEMPTS} SELECT * FROM outcome",
    "synth_summary": f"""WITH {ATTEMPTS} SELECT task_id, count(*) AS segments, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, bool_or(success) AS success,
        coalesce(string_agg(segment::VARCHAR, ',' ORDER BY segment) FILTER (NOT success), '') AS failed_segments FROM outcome GROUP BY 1""",
    "retry_flow": f"{LOG}, f AS (SELECT sequence, task_id, (row_number() OVER (PARTITION BY task_id ORDER BY sequence))::INTEGER AS retry FROM ev WHERE kind = 'failed') SELECT *, CASE WHEN retry <= 3 THEN 'requeue' ELSE 'fail' END AS action FROM f",
    "task_flow": f"{LOG} SELECT task_id, sequence, step_id, CASE WHEN step_id < {STEP_COUNT - 1} THEN step_id + 1 END AS next_step, step_id = {STEP_COUNT - 1} AS task_done FROM ev WHERE event_type = 'step_completed'",
    "scheduler_stats": f"""{STATE}, n AS (SELECT count(*) FILTER (status NOT IN ('completed', 'failed')) AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM tasks)
        SELECT *, CASE WHEN completed + failed > 0 THEN printf('%.1f%%', completed * 100.0::DOUBLE / (completed + failed)) ELSE 'N/A' END AS success_rate FROM n""",
    "batch_summary": f"{STATE} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status <> 'completed') AS failed, bool_and(status = 'completed') AS all_succeeded FROM tasks",
    "system_stats": f"{LOG} SELECT count(*) AS events, count(DISTINCT task_id) AS tasks, (SELECT count(*) FROM (SELECT DISTINCT task_id, step_id FROM ev WHERE step_id IS NOT NULL)) AS steps, count(*) FILTER (kind IN ('completed', 'failed')) AS critical FROM ev",
    "status_health": f"{LOG} SELECT date_trunc('day', event_time) AS from_time, count(DISTINCT task_id) AS tasks, count(*) AS events, count(*) > 20 AS alert FROM ev GROUP BY 1",
    "dependency_check": f"{STATE} SELECT w.task_id, w.step_id, bool_and(n.step IS NULL OR s.task_id IS NOT NULL) AS may_run FROM steps w LEFT JOIN (SELECT unnest(range({STEP_COUNT})) AS step) n ON n.step < w.step_id LEFT JOIN steps s ON s.task_id = w.task_id AND s.step_id = n.step AND s.status = 'completed' GROUP BY 1, 2",
    "skip_completed": f"{STATE} SELECT task_id, step_id FROM steps WHERE status <> 'completed'",
    "resume_plan": f"{STATE} SELECT task_id, step_id, CASE status WHEN 'completed' THEN 'skip' WHEN 'processing' THEN 'resume' WHEN 'failed' THEN 'clear_and_run' ELSE 'run' END AS action FROM steps",
}
for _strategy in ("proportional", "cumulative", "gap_preserving"):
    ORACLE_SQL[f"retime_{_strategy}"] = f"{BASE}, {_retimed(repr(_strategy))} SELECT media_id, cue_no, strategy, new_start_us, new_start_us + new_us AS new_end_us FROM retimed"
ORACLE_SQL["retime_adaptive"] = f"{BASE}, {_retimed('strategy')} SELECT media_id, cue_no, strategy, new_start_us, new_start_us + new_us AS new_end_us FROM retimed"
for _fmt in _KEPT:
    ORACLE_SQL[f"{_fmt}_roundtrip"] = _roundtrip(_fmt)
ORACLE_SQL["srt_lines"] = _roundtrip("srt")

from .record_oracles import RECORD_SQL  # noqa: E402

ORACLE_SQL |= RECORD_SQL

from .file_oracles import FILE_SQL  # noqa: E402

ORACLE_SQL |= FILE_SQL

from .text_oracles import TEXT_SQL  # noqa: E402

ORACLE_SQL |= TEXT_SQL
