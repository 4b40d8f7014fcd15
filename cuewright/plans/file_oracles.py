"""DuckDB SQL with the results of the queries in file_queries.py."""

from __future__ import annotations

from .oracles import BASE, CLIPS, CUES, LOG, ORACLE_SQL, PLAYOUT, STATE
from .record_oracles import LEGACY

MILLIS = "start_us // 1000 * 1000 AS start_us, end_us // 1000 * 1000 AS end_us"
PLAIN = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '', 'g')"
#: What stays as it is between words.
PROTECTED = r"[vV]\d+\.\d+|IP\d+\.\d+\.\d+\.\d+|IP地址|(?:API|URL|CPU|GPU)\d*"

FILE_SQL = {
    "decode_text": f"SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN 'Ã¿é ' ELSE '中文字幕 ' END || {PLAIN}) AS digest FROM documents",
    "srt_allow_empty": f"WITH {CUES} SELECT media_id, cue_no, {MILLIS}, CASE WHEN cue_no % 4 = 0 THEN '' ELSE 'a line' END AS text FROM cues",
    "srt_regex": f"WITH {CUES} SELECT media_id, cue_no, {MILLIS}, CASE cue_no % 4 WHEN 2 THEN 'go to 5 和 ' || cue_no WHEN 3 THEN 'two words' ELSE '' END AS text FROM cues",
    "write_subtitles": ORACLE_SQL["srt_roundtrip"],
    "reference_results": "SELECT label AS media_id, (vec_id + 1)::INTEGER AS index, 2.0::DOUBLE AS duration, 32 AS sample_rate, len(embedding) AS audio_length, (vec_id + 1) % 3 = 0 AS is_silence FROM embeddings",
    "synth_results": f"WITH {CUES}, {CLIPS} SELECT media_id, cue_no AS index, round(clip_us / 1e6, 6) AS duration, is_empty AS is_silence FROM clips WHERE cue_no % 5 <> 0",
    "aligned_results": f"{BASE}, {PLAYOUT} SELECT media_id, seg_no AS index, round(start_us / 1e6, 6) AS start_time, round(end_us / 1e6, 6) AS end_time FROM played WHERE NOT is_silence",
    "status_docs": f"""{STATE} SELECT 'step' AS kind, task_id, step_id::VARCHAR AS field, concat_ws('|', status, current_item::VARCHAR, error_message) AS value FROM steps
        UNION ALL SELECT 'state', task_id, 'status', concat_ws('|', task_id::VARCHAR, status, error_message) FROM tasks UNION ALL SELECT 'metadata', task_id, 'version', '1.0' FROM tasks
        UNION ALL SELECT 'metadata', task_id, 'last', status FROM tasks UNION ALL SELECT 'metadata', task_id, 'counts', '{{"steps_done":' || steps_done || '}}' FROM tasks""",
    "task_docs": f"""{STATE}, {LEGACY} SELECT task_id + 1000 AS task_id, n::INTEGER AS current_step, CASE n WHEN 8 THEN 'completed' WHEN 0 THEN 'pending' ELSE 'processing' END AS status, n * 100.0::DOUBLE / 8 AS progress,
        array_to_string(range(n), ',') AS steps FROM legacy UNION ALL SELECT task_id, 3, status, progress,
        coalesce((SELECT string_agg(step_id::VARCHAR, ',' ORDER BY step_id) FROM steps s WHERE s.task_id = tasks.task_id AND s.status = 'completed'), '') FROM tasks""",
    "task_dicts": f"{STATE} SELECT task_id, step_id, status = 'completed' AS success, status AS message, error_message AS error, current_item::DOUBLE AS processing_time, status = 'processing' AS is_partial FROM steps",
    "log_lines": f"""{LOG} SELECT sequence, CASE kind WHEN 'failed' THEN 'ERROR' ELSE 'INFO' END AS level, CASE kind WHEN 'completed' THEN 'Task t' || task_id || ' success' ELSE 'task: t' || task_id || ' - ' || kind END AS message,
        CASE kind WHEN 'completed' THEN 't' || task_id END AS task FROM ev WHERE sequence % 9 <> 0""",
    "space_protected": f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '{PROTECTED}') AS gaps, regexp_extract_all(coalesce(text, ''), '{PROTECTED}') AS kept FROM documents),
        s AS (SELECT doc_id, t, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: regexp_replace(regexp_replace(regexp_replace(gaps[i], '([a-zA-Z])(\\d)', '\\1 \\2', 'g'), '(\\d)([a-zA-Z])', '\\1 \\2', 'g'),
            '(\\p{{Lu}})', ' \\1', 'g') || coalesce(kept[i], '')), '') AS x FROM p)
        SELECT doc_id, md5(CASE WHEN regexp_matches(t, '^\\p{{Lu}}') THEN ltrim(x, ' ') ELSE x END) AS digest FROM s""",
    "text_pipeline": """WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s)[^!?]*[!?]') AS p FROM documents WHERE contains(text, 'e'))
        SELECT doc_id, (i - 1)::INTEGER AS piece_no, length(p[i])::INTEGER AS length, NULL::VARCHAR AS error FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)
        UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN text IS NOT NULL THEN 'ValueError: no e' END FROM documents WHERE text IS NULL OR NOT contains(text, 'e')""",
    "sync_snapshots": f"{STATE} SELECT * FROM steps",
    "on_event": f"{LOG} SELECT sequence, task_id, error_message FROM ev WHERE event_type = 'step_failed'",
    "stages": ORACLE_SQL["mux_plan"],
}
