"""DuckDB SQL of the whole way of a text: encodable, cleaned, normalised, split and checked. Texts in Han are left to hand-worked values."""

from __future__ import annotations

from .oracles import CUES
from .record_oracles import _LONG, _PART, _WHOLE, FORMS, MARKS, SHORT, STOPS, _spelled

# Words for signs, terms, brackets, and marks that end a sentence.
SIGNS = {"&": "和", "®": "", "™": "", "©": "", "℃": "摄氏度", "℉": "华氏度", "€": "欧元", "$": "美元", "£": "英镑", "¥": "人民币", "@": "艾特", "#": "井号"}
WORDS = {
    "AI": "人工智能", "API": "应用程序接口", "URL": "网址", "CPU": "中央处理器", "GPU": "图形处理器",
    "iPhone": "苹果手机", "iPad": "苹果平板", "Android": "安卓", "Windows": "视窗系统", "macOS": "苹果系统",
}
BRACKETS = [r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", "<[^>]*>", "（[^）]*）", "【[^】]*】"]
ENDS = "。！？；.!?;"
#: White space, as Unicode has it.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _writable() -> str:
    """What GBK can write beyond ASCII, without symbols, dingbats and variation marks."""
    found = []
    for i in [*range(0x80, 0x2600), *range(0x27C0, 0xD800), *range(0xE000, 0xFE00), *range(0xFE10, 0x10000)]:
        try:
            chr(i).encode("gbk")
        except UnicodeEncodeError:
            continue
        found.append(chr(i))
    return "".join(found)


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _collapse(t: str) -> str:
    return _strip(f"regexp_replace({t}, '{WHITE}+', ' ', 'g')")


def _replaced(t: str, pairs: dict[str, str]) -> str:
    for k, v in pairs.items():
        t = f"replace({t}, '{k}', '{v}')"
    return t


def _encodable(t: str) -> str:
    kept = f"array_to_string(list_filter(regexp_extract_all({t}, '(?s).'), lambda c: c <= chr(127) OR contains(writable, c)), '')"
    return _strip(f"CASE WHEN regexp_matches({t}, '[^\\x00-\\x7f]') THEN {kept} ELSE {t} END")


def _fixed(t: str) -> str:
    t = f"translate({t}, '０１２３４５６７８９．', '0123456789.')"
    for pattern, by in ((r"(\d+)。(\d+)。(\d+)。(\d+)", r"\1.\2.\3.\4"), (r"([vV])。(\d+)", r"\1.\2"), (r"(\d+)。(\d{1,3})(\D|$)", r"\1.\2\3")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return f"translate({t}, '：', ':')"


def _bare(t: str) -> str:
    for pattern in BRACKETS:
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    return _collapse(t)


def _tokens(t: str, pattern: str, change: str) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({t}, '(?s){pattern}|.'), lambda x: {change}), ''), '')"


def _dashes(p: str) -> str:
    """A text that is parted at its dashes."""
    return f"""{p}[1] || coalesce(array_to_string(list_transform(range(2, len({p}) + 1), lambda i: CASE WHEN regexp_matches(right(array_to_string({p}[greatest(i - 6, 1):i - 1], '-'), 5), '\\d[^{STOPS}]{{0,4}}$')
        AND regexp_matches(left(array_to_string({p}[i:i + 5], '-'), 5), '^[^{STOPS}]{{0,4}}\\d') THEN '至' ELSE '，' END || {p}[i]), ''), '')"""


def _percents(t: str) -> str:
    spelled = _spelled(f"try_cast({_WHOLE} AS BIGINT)")
    return _tokens(t, r"\d+(?:\.\d+)?\s*%", f"CASE WHEN regexp_matches(x, '^\\d.*%$') THEN '百分之' || coalesce({spelled}, {_LONG}) || CASE WHEN {_PART} <> '' THEN '点' || translate({_PART}, '0123456789', '零一二三四五六七八九') ELSE '' END ELSE x END")


def _expanded(t: str) -> str:
    out = t
    for short, long in SHORT:
        out = f"regexp_replace({out}, '(?i)\\b{short.replace(chr(39), chr(39) * 2)}\\b', '{long}', 'g')"
    return out


def _capitals(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^[A-Z]') THEN substr(regexp_replace({t}, '([A-Z])', ' \\1', 'g'), 2) ELSE regexp_replace({t}, '([A-Z])', ' \\1', 'g') END"


def _marks(t: str) -> str:
    return _tokens(t, rf"(?:{FORMS})|\.\.\.", "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in MARKS.items()) + "}[x], x)")


def _share(kind: str) -> str:
    return f"length(regexp_replace(t, '[^{kind}]', '', 'g')) / greatest(length(t), 1)"


#: text of `src` cleaned, as c3.
CLEANED = f"""ok AS (SELECT '{_writable()}' AS writable),
  c1 AS (SELECT *, {_encodable("coalesce(text, '')")} AS e FROM src, ok),
  c2 AS (SELECT *, {_strip(_replaced(_bare(_fixed("e")), SIGNS))} AS b FROM c1),
  c3 AS (SELECT *, CASE WHEN length(b) <= 1 OR NOT regexp_matches(b, '[\\pL\\pM\\pN\\p{{Pc}}]') THEN '' ELSE {_encodable(f"regexp_replace(b, '{WHITE}+', ' ', 'g')")} END AS clean FROM c2)"""


def _processed(source: str, strategy: str, longest: int) -> str:
    """CTEs up to `done`, with language, is_valid, error_message, cleaned and segments beside the columns of the source."""
    words = f"list_reduce(string_split(s, ' '), lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + 1 + length(x) <= {longest} THEN a || ' ' || x ELSE a || chr(1) || x END)"
    sentences = f"list_filter(list_transform(regexp_extract_all(cleaned, '(?s)[^{ENDS}]*[{ENDS}]|[^{ENDS}]+$'), lambda x: trim(x, ' ')), lambda x: x <> '')"
    cut = sentences if strategy == "sentence" else f"flatten(list_transform({sentences}, lambda s: CASE WHEN length(s) <= {longest} THEN [s] ELSE string_split({words}, chr(1)) END))"
    return f"""WITH src AS ({source}), {CLEANED},
  v AS (SELECT *, CASE WHEN coalesce({_strip("text")} = '', true) THEN 'empty text' WHEN length(text) > {longest * 10} THEN 'text too long: ' || length(text) END AS m1, {_strip("coalesce(text, '')")} AS t FROM c3),
  l AS (SELECT *, CASE WHEN m1 IS NOT NULL THEN 'unknown' WHEN regexp_matches(t, '[가-힯]') THEN 'ko' WHEN regexp_matches(t, '[぀-ヿ]') THEN 'ja' WHEN {_share('一-鿿')} > 0.3 AND {_share('a-zA-Z')} > 0.2 THEN 'mixed'
      WHEN {_share('一-鿿')} > 0.3 THEN 'zh' WHEN regexp_matches(t, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END AS language FROM v),
  d1 AS (SELECT *, {_replaced("clean", WORDS)} AS x1 FROM l),
  d2 AS (SELECT *, {_capitals("x1")} AS x2 FROM d1),
  d3 AS (SELECT *, regexp_replace(regexp_replace(x2, '([a-zA-Z])(\\d)', '\\1 \\2', 'g'), '(\\d)([a-zA-Z])', '\\1 \\2', 'g') AS x3 FROM d2),
  parted AS (SELECT *, string_split(replace(x3, '–', '-'), '-') AS p FROM d3),
  d4 AS (SELECT *, {_dashes("p")} AS x4 FROM parted),
  d5 AS (SELECT *, {_percents("x4")} AS x5 FROM d4),
  d6 AS (SELECT *, CASE WHEN language = 'en' AND contains(x5, '''') THEN {_expanded("x5")} ELSE x5 END AS x6 FROM d5),
  d7 AS (SELECT *, CASE WHEN m1 IS NULL THEN {_collapse(_marks("x6"))} ELSE '' END AS cleaned FROM d6),
  d8 AS (SELECT *, CASE WHEN cleaned = '' THEN []::VARCHAR[] WHEN length(cleaned) <= {longest} THEN [cleaned] ELSE {cut} END AS segments FROM d7),
  d9 AS (SELECT *, list_position(list_transform(segments, lambda x: length(x) > {longest}), true) AS over FROM d8),
  done AS (SELECT *, coalesce(m1, CASE WHEN cleaned = '' THEN 'no text left' WHEN len(segments) = 0 THEN 'no segments' WHEN over > 0 THEN 'segment ' || over || ' too long' END) AS error_message FROM d9)"""


_DOCUMENTS = _processed("SELECT doc_id, text FROM documents", "adaptive", 300)
TEXT_SQL = {
    "basic_clean": f"WITH src AS (SELECT doc_id, text FROM documents), {CLEANED} SELECT doc_id, md5(clean) AS digest FROM c3",
    "process_text": f"{_DOCUMENTS} SELECT doc_id, language, error_message IS NULL AS is_valid, error_message, len(segments)::INTEGER AS pieces, md5(cleaned) AS digest FROM done",
    "text_stats": f"{_DOCUMENTS} SELECT count(*) AS processed, count(error_message) AS errors, (count(*) - count(error_message)) / count(*) AS success_rate FROM done",
    "preprocess_cues": _processed(f"WITH {CUES} SELECT media_id, cue_no, text FROM cues WHERE start_us < end_us", "sentence", 300)
    + " SELECT media_id, cue_no, md5(coalesce(segments[1], '')) AS digest, error_message IS NULL AS is_valid FROM done",
}
