"""DuckDB SQL with the results of the queries in record_queries.py."""

from __future__ import annotations

from .oracles import ATTEMPTS, AUDIO, BASE, CLIPS, CUES, ISLANDS, LINE, LISTING, LOG, PLAN, PLAYOUT, QUEUE, SIDES, STATE, TRACKS, _retimed, _time

DAY_US = 86_400_000_000
#: The ordered steps of a run.
STEP_NAMES = ["preprocess_subtitle", "separate_media", "generate_reference_audio", "generate_tts", "align_audio", "generate_aligned_srt", "process_video_speed", "merge_audio_video"]
LEGACY = """legacy AS (SELECT n_nationkey::BIGINT AS task_id, n_nationkey % 8 AS n FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey >= 20)"""
HALVES = """half AS (
  SELECT task_id, step_id, sequence % 2 AS odd, arg_max(CASE kind WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'processing' END, sequence) AS status,
         arg_max(error_message, sequence) FILTER (kind = 'failed') AS error_message, max(event_time) FILTER (kind = 'started') AS started_at, max(event_time) AS updated_at
  FROM ev WHERE step_id IS NOT NULL GROUP BY ALL)"""
#: Tracks of the labels' vectors, two seconds of 32 samples a second each, and cues in them.
TRACK = f"""{CUES}, track AS (
  SELECT label AS media_id, flatten(list(list_transform(embedding::DOUBLE[], lambda x: x * CASE WHEN vec_id % 5 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END) ORDER BY vec_id)) AS whole FROM embeddings GROUP BY 1),
spoken AS (SELECT *, start_us + cue_no * 37 % 11 * 250000 AS stop_us FROM (SELECT media_id, cue_no, start_us // 4 AS start_us FROM cues WHERE media_id < 50)),
part AS (
  SELECT media_id, cue_no AS index, start_us, stop_us, whole[floor(start_us * 32 / 1000000)::BIGINT + 1:least(floor(stop_us * 32 / 1000000)::BIGINT, len(whole))] AS s FROM spoken JOIN track USING (media_id))"""
#: A clip of n samples s is silent, and how good it is, as in AUDIO.
RATED = AUDIO[AUDIO.index("ab AS (") :].replace("FROM au)", "FROM (SELECT * FROM part WHERE len(s) > 0 AND stop_us > start_us))")
REFERENCE = f"""{TRACK}, {RATED},
clip AS (
  SELECT p.media_id, p.cue_no AS index, round((p.stop_us - p.start_us) / 1e6, 3) AS duration, coalesce(a.is_silence, true) AS is_silence, coalesce(a.score, 0) AS score, coalesce(a.n, 0) AS n, a.rms, a.s
  FROM spoken p LEFT JOIN ae a ON a.media_id = p.media_id AND a.index = p.cue_no WHERE p.stop_us > p.start_us),
best AS (SELECT media_id, index, score, n FROM clip WHERE NOT is_silence QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score DESC, index) = 1),
gained AS (SELECT *, CASE WHEN is_silence OR coalesce(rms, 0) = 0 THEN s ELSE list_transform(s, lambda x: tanh(x * least(10.0::DOUBLE, greatest(0.1::DOUBLE, 0.15::DOUBLE / rms)) * 0.95::DOUBLE) * 0.95::DOUBLE) END AS heard FROM clip),
final AS (
  SELECT g.media_id, g.index, g.duration, g.is_silence AND b.index IS NULL AS is_silence, CASE WHEN g.is_silence THEN b.index END AS replaced_with, g.is_silence AS was_silent,
         (CASE WHEN g.is_silence AND b.index IS NOT NULL THEN b.n ELSE g.n END)::INTEGER AS audio_length, round(CASE WHEN g.is_silence AND b.index IS NOT NULL THEN b.score ELSE g.score END, 6) AS quality_score,
         CASE WHEN g.n > 0 THEN round(sqrt(list_sum(list_transform(heard, lambda x: x * x)) / g.n), 5) END AS rms
  FROM gained g LEFT JOIN best b USING (media_id))"""

RECORD_SQL = {
    "cue_times": f"""WITH {CUES} SELECT media_id, cue_no, round(start_us / 1e6, 6) AS seconds, (floor(start_us / 1e6 - 7.5)::BIGINT % 86400 + 86400) % 86400 * 1000000 + floor(((start_us / 1e6 - 7.5) - floor(start_us / 1e6 - 7.5)) * 1000000)::BIGINT AS wrapped_us,
        printf('%02d:%02d:%02d,%03d', floor(x / 3600)::INTEGER, floor(x % 3600 / 60)::INTEGER, floor(x % 60)::INTEGER, floor(x % 1 * 1000)::INTEGER) AS written, end_us - start_us AS duration_us,
        start_us < end_us AND length(trim(text, ' ')) > 0 AS is_valid, abs(start_us - end_us) < 2000000 AS is_short FROM (SELECT *, start_us / 1e6::DOUBLE AS x FROM cues)""",
    "scale_time": f"WITH {CUES} SELECT media_id, cue_no, floor(start_us * 1.5::DOUBLE)::BIGINT % {DAY_US} AS start_us, floor(end_us * 1.5::DOUBLE)::BIGINT % {DAY_US} AS end_us FROM cues",
    "sort_cues": f"WITH {CUES} SELECT media_id, cue_no, (row_number() OVER (PARTITION BY media_id ORDER BY (end_us - start_us) // 1000000, cue_no))::INTEGER AS place FROM cues",
    "sort_segments": f"{BASE}, {PLAYOUT} SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us, kind) - 1)::INTEGER AS seg_no, start_us, is_silence FROM played",
    "srt_timestamps": f"WITH {CUES} SELECT media_id, cue_no, start_us // 1000 * 1000 AS start_us, end_us // 1000 * 1000 AS end_us FROM cues",
    "extract_style_to_srt": f"""WITH {CUES}, s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us // 10000, cue_no) AS n FROM cues WHERE style = 'user')
        SELECT media_id, md5(string_agg(n || chr(10) || {_time('(start_us // 10000 * 10000)', 'srt')} || ' --> ' || {_time('(end_us // 10000 * 10000)', 'srt')} || chr(10) || {LINE} || chr(10), chr(10) ORDER BY n)) AS digest FROM s GROUP BY 1""",
    "cue_json": f"WITH {CUES} SELECT media_id, cue_no, start_us, end_us, md5(text) AS text_md5, style, '' AS actor FROM cues",
    "result_json": f"WITH {CUES}, {CLIPS} SELECT media_id, cue_no AS index, round(clip_us / 1e6, 6) AS duration, is_empty FROM clips",
    "bracket_texts": r"""SELECT conv_id, turn, coalesce(regexp_matches(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '^(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>|（[^）]*）|【[^】]*】)$'), false) AS is_pure,
        md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '\{[^}]*\}', '', 'g'), '\\[Nnh]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest
        FROM (SELECT conv_id, turn, coalesce(CASE turn % 4 WHEN 0 THEN '[' || text || ']' WHEN 1 THEN '{\i1}a\Nb ' || text ELSE text END, '') AS t FROM conversations)""",
    "make_task_ids": f"WITH {SIDES} SELECT path, printf('task_%03d_%s', (row_number() OVER (PARTITION BY dir ORDER BY path) - 1)::INTEGER, stem) AS task_id FROM (SELECT DISTINCT path, dir, stem FROM media)",
    "plan_paths": f"WITH {SIDES} SELECT DISTINCT path, 16 AS files, '/out/' || stem || '/processed/' || stem || '.srt' AS subtitle, '/out/' || stem || '/' || stem || '_final.mp4' AS final_video FROM media",
    "match_task_names": f"""WITH {SIDES}, t AS (SELECT printf('task_%03d_%s', (row_number() OVER (PARTITION BY dir ORDER BY path) - 1)::INTEGER, stem) AS task_id, stem FROM (SELECT DISTINCT path, dir, stem FROM media)),
        n AS (SELECT DISTINCT CASE regexp_extract(stem, '[0-9]+')::INTEGER % 3 WHEN 0 THEN replace(stem, 'clip', 'clip-') WHEN 1 THEN stem || 'x' ELSE stem END AS name FROM t)
        SELECT name, coalesce((SELECT min(task_id) FROM t WHERE stem = name), (SELECT min(task_id) FROM t WHERE regexp_replace(stem, '[^\\w]', '', 'g') = regexp_replace(name, '[^\\w]', '', 'g'))) AS task_id FROM n""".replace("\\\\", "\\"),
    "remaining_failures": f"WITH {ATTEMPTS} SELECT DISTINCT task_id, segment FROM tries WHERE NOT success AND (task_id, segment) NOT IN (SELECT (task_id, segment) FROM outcome WHERE success)",
    "retry_selection": f"WITH {CUES}, {CLIPS}, {ATTEMPTS} SELECT media_id, cue_no AS index, clip_us FROM clips SEMI JOIN (SELECT task_id AS media_id, segment % 7 + 1 AS cue_no FROM outcome WHERE NOT success) USING (media_id, cue_no)",
    "clear_tasks": f"{STATE} SELECT task_id, status FROM tasks WHERE status <> 'failed'",
    "batch_result_lookup": f"{STATE} SELECT n_nationkey::BIGINT AS task_id, coalesce(status, 'missing') AS status, coalesce(status = 'completed', false) AS success FROM nation LEFT JOIN tasks ON task_id = n_nationkey",
    "validate_synth_files": f"WITH {CUES}, {CLIPS} SELECT media_id, cue_no AS index, '/c/' || media_id || '_' || cue_no AS file_path FROM clips WHERE NOT is_empty AND (media_id + cue_no) % 3 <> 0",
    "union_task_states": f"{STATE} SELECT task_id, status, CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'active' END AS bucket FROM tasks",
    "task_tracking": f"{STATE} SELECT task_id, status, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN status ELSE 'active' END AS bucket FROM tasks",
    "task_progress": f"{STATE} SELECT task_id, step_id, round((step_id + progress / 100.0::DOUBLE) / 8 * 100.0::DOUBLE, 6) AS percent FROM steps",
    "task_summary": f"""{STATE} SELECT task_id, status, round(progress, 2) AS progress, round((epoch_us(updated_at) - epoch_us(first_at)) / 1e6, 2) AS processing_seconds, error_message,
        CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'active' END AS bucket FROM tasks""",
    "status_lookup": f"""{STATE} SELECT 'task' AS scope, task_id, NULL::INTEGER AS step_id, status FROM tasks WHERE task_id = 3 UNION ALL SELECT 'step', task_id, step_id, status FROM steps WHERE task_id = 3 AND step_id = 2
        UNION ALL SELECT 'steps', task_id, step_id, status FROM steps WHERE task_id = 3 UNION ALL SELECT 'completed', task_id, step_id, status FROM steps WHERE step_id = 2 AND status = 'completed'""",
    "step_item_progress": """SELECT conv_id, count(*) > 0 AND count(*) FILTER (turn % 3 <> 2) = count(*) AS is_completed, count(*) FILTER (turn % 3 <> 2) BETWEEN 1 AND count(*) - 1 AS is_partial,
        round(count(*) FILTER (turn % 3 <> 2) * 100.0::DOUBLE / count(*), 6) AS percent FROM conversations GROUP BY 1""",
    "group_batch_updates": f"{LOG} SELECT task_id, count(*)::INTEGER AS n, md5(string_agg(sequence::VARCHAR, ',' ORDER BY sequence)) AS digest FROM ev WHERE {QUEUE} NOT IN ('task', 'progress') GROUP BY 1",
    "load_cached_status": f"""{STATE}, {LEGACY}, own AS (SELECT task_id, list(step_id ORDER BY step_id) AS s FROM steps WHERE task_id % 2 = 1 AND status = 'completed' GROUP BY 1),
        old AS (SELECT task_id, list_transform(range(n), lambda x: x::INTEGER) AS s FROM legacy WHERE n > 0)
        SELECT task_id, array_to_string(coalesce(own.s, old.s), ',') AS steps, len(coalesce(own.s, old.s)) * 100.0::DOUBLE / 8 AS percent FROM own FULL JOIN old USING (task_id)""",
    "convert_legacy_tasks": f"""WITH {LEGACY} SELECT task_id::VARCHAR AS document, n::INTEGER AS current_step, CASE n WHEN 8 THEN 'completed' WHEN 0 THEN 'pending' ELSE 'processing' END AS status, n * 100.0::DOUBLE / 8 AS progress, array_to_string(range(n), ',') AS steps FROM legacy""",
    "cache_inventory": f"{STATE}, f AS (SELECT task_id, count(*) FILTER (status = 'completed') AS done, sum(step_id + 1)::BIGINT AS files FROM steps GROUP BY 1) SELECT task_id AS document, coalesce(done, 0) AS steps_done, coalesce(files, 0) AS files, coalesce(done, 0) > 0 AS is_valid FROM tasks LEFT JOIN f USING (task_id)",
    "step_status_upsert": f"""{LOG}, {HALVES}, o AS (SELECT * FROM half WHERE odd = 0), n AS (SELECT * FROM half WHERE odd = 1)
        SELECT task_id, step_id, coalesce(n.status, o.status) AS status, coalesce(n.error_message, o.error_message) AS error_message, coalesce(o.started_at, CASE WHEN n.status = 'processing' THEN n.updated_at END) AS started_at FROM o FULL JOIN n USING (task_id, step_id)""",
    "merge_metadata": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE n_name END AS name, n_regionkey::VARCHAR AS region, 2 AS keys FROM nation",
    "speed_analysis": f"{BASE}, {TRACKS}, {ISLANDS}, {PLAN} SELECT media_id, seg_no, kind, target_end_us - target_us AS target_start_us, target_end_us, round(speed_ratio, 6) AS speed_ratio FROM plan",
    "synth_requests": f"""WITH {CUES}, {CLIPS}, c AS (SELECT *, cue_no % 5 = 0 OR trim(text, ' ') = '' AS blank FROM cues)
        SELECT c.media_id, c.cue_no, blank AS is_empty, CASE WHEN blank THEN c.end_us - c.start_us END AS silence_us, CASE WHEN NOT blank AND p.cue_no IS NOT NULL THEN 'ref_' || p.cue_no END AS reference_file FROM c LEFT JOIN clips p ON p.media_id = c.media_id AND p.cue_no = c.cue_no""",
    "silence_samples": f"WITH {CUES} SELECT media_id, cue_no, floor(16000 * greatest(0.01::DOUBLE, (end_us - start_us) / 1e6::DOUBLE - 1.5::DOUBLE))::BIGINT AS samples FROM cues",
    "audio_file_info": "SELECT vec_id + 1 AS index, CASE WHEN (vec_id + 1) % 4 <> 0 THEN 32 ELSE 44100 END AS sample_rate, (CASE WHEN (vec_id + 1) % 4 <> 0 THEN len(embedding) ELSE 0 END)::INTEGER AS audio_length, CASE WHEN (vec_id + 1) % 4 <> 0 THEN (vec_id + 1) * 10 ELSE 0 END AS file_size FROM embeddings",
    "normalize_volume": f"""WITH {AUDIO}, g AS (SELECT index, n, CASE WHEN rms = 0 THEN s ELSE list_transform(s, lambda x: tanh(x * least(10.0::DOUBLE, greatest(0.1::DOUBLE, 0.15::DOUBLE / rms)) * 0.95::DOUBLE) * 0.95::DOUBLE) END AS h FROM ab)
        SELECT index, round(sqrt(list_sum(list_transform(h, lambda x: x * x)) / n), 6) AS rms, round(list_max(h), 6) AS peak FROM g""",
    "normalize_volume_centred": f"""WITH {AUDIO}, f AS (
          SELECT index, n, s, list_transform(range(0, n // 8 + 1), lambda i: sqrt(coalesce(list_sum(list_transform(s[greatest(8 * i - 16, 0) + 1:least(8 * i + 16, n)], lambda x: x * x)), 0) / 32)) AS levels FROM ab),
        m AS (SELECT *, list_avg(list_filter(levels, lambda x: x > 0)) AS mean FROM f),
        g AS (SELECT index, n, len(levels)::INTEGER AS n_frames, CASE WHEN mean IS NULL THEN s ELSE list_transform(s, lambda x: tanh(x * least(10.0::DOUBLE, greatest(0.1::DOUBLE, 0.15::DOUBLE / mean)) * 0.95::DOUBLE) * 0.95::DOUBLE) END AS h FROM m)
        SELECT index, n_frames, round(sqrt(list_sum(list_transform(h, lambda x: x * x)) / n), 6) AS rms, round(list_max(h), 6) AS peak FROM g""",
    "cut_by_cue": f"WITH {TRACK} SELECT media_id, index AS cue_no, len(s)::INTEGER AS n, CASE WHEN len(s) > 0 THEN round(sqrt(list_sum(list_transform(s, lambda x: x * x)) / len(s)), 6) END AS rms FROM part WHERE start_us < (SELECT len(whole) * 1000000 / 32 FROM track t WHERE t.media_id = part.media_id)",
    "reference_segments": f"WITH {REFERENCE} SELECT media_id, index, duration, is_silence, replaced_with, audio_length, quality_score, rms FROM final",
    "reference_summary": f"WITH {REFERENCE}, a AS (SELECT media_id, count(*) AS requested FROM spoken GROUP BY 1), g AS (SELECT media_id, count(*) AS produced, count(*) FILTER (is_silence) AS silent, count(replaced_with) AS replaced FROM final GROUP BY 1) SELECT media_id, requested, coalesce(produced, 0) AS produced, coalesce(silent, 0) AS silent, coalesce(replaced, 0) AS replaced FROM a LEFT JOIN g USING (media_id)",
}

RECORD_SQL["step_status_table"] = RECORD_SQL["step_status_upsert"]
RECORD_SQL["status_absence"] = f"""{LOG}, x AS (SELECT task_id, event_time AS last_seen, lead(event_time) OVER (PARTITION BY task_id ORDER BY event_time, sequence) AS seen_again FROM ev)
        SELECT task_id, last_seen, last_seen + INTERVAL 8 HOUR AS alert_at, seen_again FROM x WHERE epoch_us(seen_again) - epoch_us(last_seen) > 28800000000"""
RECORD_SQL["pair_tracks"] = f"""{BASE}, {_retimed("'cumulative'")}, x AS (
          SELECT c.media_id, c.cue_no, r.cue_no AS other_no, r.new_start_us - c.start_us AS off_us,
                 row_number() OVER (PARTITION BY c.media_id, c.cue_no ORDER BY abs(r.new_start_us - c.start_us), r.new_start_us, r.cue_no) AS n
          FROM cues c LEFT JOIN retimed r ON r.media_id = c.media_id AND abs(r.new_start_us - c.start_us) < 2000000)
        SELECT media_id, cue_no, other_no, off_us FROM x WHERE n = 1"""


def _folded(style: str) -> str:
    """merge_repeated_style of the cues with another style: a folded row looks for the last kept row of the first other style of its media."""
    return f"""WITH {CUES}, c AS (SELECT media_id, cue_no, end_us, {style} AS style, 't' || cue_no AS text FROM cues),
        p AS (SELECT *, cue_no - row_number() OVER (PARTITION BY media_id, style ORDER BY cue_no) AS island FROM c),
        k AS (SELECT *, (row_number() OVER (PARTITION BY media_id, style, island ORDER BY cue_no) - 1) % 2 = 1 AS folded, count(DISTINCT style) OVER (PARTITION BY media_id) AS styles,
                     (SELECT min(o.style) FROM c o WHERE o.media_id = p.media_id AND o.style <> p.style) AS other FROM p),
        t AS (SELECT *, CASE WHEN folded THEN (SELECT max(o.cue_no) FROM k o WHERE o.media_id = k.media_id AND o.style = k.other AND NOT o.folded AND o.cue_no < k.cue_no) END AS target FROM k),
        f AS (SELECT media_id, target, string_agg(text, ', ' ORDER BY cue_no) AS more, arg_max(end_us, cue_no) AS far FROM t WHERE target IS NOT NULL GROUP BY 1, 2)
        SELECT t.media_id, t.cue_no, t.style, coalesce(f.far, n.end_us, t.end_us) AS end_us, t.text || coalesce(', ' || f.more, '') AS text
        FROM t LEFT JOIN f ON f.media_id = t.media_id AND f.target = t.cue_no LEFT JOIN t n ON n.media_id = t.media_id AND n.cue_no = t.cue_no + 1 AND n.target IS NOT NULL
        WHERE t.styles = 1 OR NOT t.folded"""


RECORD_SQL["merge_repeated_style"] = _folded("CASE WHEN (cue_no * 7 + media_id) % 5 < 3 THEN 'top' ELSE 'bottom' END")
RECORD_SQL["merge_three_styles"] = _folded("CASE WHEN (cue_no * 7 + media_id) % 11 < 4 THEN 'top' WHEN (cue_no * 7 + media_id) % 11 < 8 THEN 'bottom' ELSE 'middle' END")

# Texts. A text is taken apart into the forms that count and single characters, and put together again.

#: Forms of numbers whose marks stay, marks and what stands for them, contractions, and marks that end what belongs to a dash.
FORMS = r"\d+\.\d+|\d+:\d+:\d+|\d+:\d+|\d+\.\d+\.\d+\.\d+|\d+\.\d+\.\d+|v\d+\.\d+|V\d+\.\d+|\d+\)|\(\d+\)"
MARKS = {"...": "。", "…": "。", "!": "！", "?": "？", ":": "：", ";": "；", ",": "，", ".": "。", "(": "（", ")": "）"}
SHORT = [("don't", "do not"), ("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am")]
STOPS = r"，。！？；：,.:;!?()（）\[\]【】{}\"<>"


def _by_token(pattern: str, change: str) -> str:
    return f"SELECT doc_id, md5(coalesce(array_to_string(list_transform(regexp_extract_all(text, '(?s){pattern}|.'), lambda x: {change}), ''), '')) AS digest FROM documents"


def _spelled(n: str) -> str:
    """A whole number in words, up to 9999."""
    digit = lambda k: f"substr('零一二三四五六七八九', {k} + 1, 1)"
    ones = lambda r: f"CASE WHEN {r} % 10 > 0 THEN {digit(f'{r} % 10')} ELSE '' END"
    tens = lambda r, first: f"CASE WHEN {r} < 20 THEN '{first}' ELSE {digit(f'{r} // 10')} END || '十' || {ones(r)}"
    low = f"({n} % 100)"
    hundreds = lambda r: f"{digit(f'{r} // 100')} || '百' || CASE WHEN {low} = 0 THEN '' WHEN {low} < 10 THEN '零' || {digit(low)} ELSE {tens(low, '一')} END"
    rest = f"({n} % 1000)"
    after = f"CASE WHEN {rest} = 0 THEN '' WHEN {rest} < 10 THEN '零零' || {digit(rest)} WHEN {rest} < 100 THEN '零' || {tens(rest, '')} ELSE {hundreds(rest)} END"
    return f"CASE WHEN {n} < 10 THEN {digit(n)} WHEN {n} < 100 THEN {tens(n, '')} WHEN {n} < 1000 THEN {hundreds(n)} WHEN {n} < 10000 THEN {digit(f'{n} // 1000')} || '千' || {after} END"


def _expanded() -> str:
    out = "coalesce(text, '')"
    for short, long in SHORT:
        out = f"regexp_replace({out}, '(?i)\\b{short.replace(chr(39), chr(39) * 2)}\\b', '{long}', 'g')"
    return f"SELECT doc_id, md5({out}) AS digest FROM documents"


_WHOLE = "split_part(rtrim(x, ' %' || chr(9) || chr(10) || chr(13)), '.', 1)"
_PART = "split_part(rtrim(x, ' %' || chr(9) || chr(10) || chr(13)), '.', 2)"
_LONG = f"translate({_WHOLE}, '0123456789', '零一二三四五六七八九')"
RECORD_SQL |= {
    "map_punctuation": _by_token(rf"(?:{FORMS})|\.\.\.", "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in MARKS.items()) + "}[x], x)"),
    "percent_to_words": _by_token(
        r"\d+(?:\.\d+)?\s*%",
        f"CASE WHEN regexp_matches(x, '^\\d.*%$') THEN '百分之' || coalesce({_spelled(f'try_cast({_WHOLE} AS BIGINT)')}, {_LONG}) || CASE WHEN {_PART} <> '' THEN '点' || translate({_PART}, '0123456789', '零一二三四五六七八九') ELSE '' END ELSE x END",
    ),
    "expand_contractions": _expanded(),
    # A group of digits behind 。 that is followed by more digits is left out of the last rule.
    "fix_numbers": r"""SELECT doc_id, md5(translate(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '０１２３４５６７８９．', '0123456789.'), '(\d+)。(\d+)。(\d+)。(\d+)', '\1.\2.\3.\4', 'g'),
        '([vV])。(\d+)', '\1.\2', 'g'), '(\d+)。(\d{1,3})(\D|$)', '\1.\2\3', 'g'), '：', ':')) AS digest FROM documents""",
    "dash_to_words": rf"""WITH p AS (SELECT doc_id, string_split(replace(coalesce(text, ''), '–', '-'), '-') AS p FROM documents)
        SELECT doc_id, md5(p[1] || array_to_string(list_transform(range(2, len(p) + 1), lambda i: CASE WHEN regexp_matches(right(array_to_string(p[greatest(i - 6, 1):i - 1], '-'), 5), '\d[^{STOPS}]{{0,4}}$')
            AND regexp_matches(left(array_to_string(p[i:i + 5], '-'), 5), '^[^{STOPS}]{{0,4}}\d') THEN '至' ELSE '，' END || p[i]), '')) AS digest FROM p""",
}
