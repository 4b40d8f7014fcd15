"""Text columns: cleaning, normalising and splitting cue text for speech."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, from here to PRESETS: spoken words for signs, terms in order, punctuation in order, contractions in order, digits, patterns of brackets,
# numbers, counted numbers and annotations in order, signs that a dash stops at, ends of sentences and clauses, and lengths.
SIGN_WORDS = {"&": "和", "®": "", "™": "", "©": "", "℃": "摄氏度", "℉": "华氏度", "€": "欧元", "$": "美元", "£": "英镑", "¥": "人民币", "@": "艾特", "#": "井号"}
TERMS = {
    "AI": "人工智能", "API": "应用程序接口", "URL": "网址", "CPU": "中央处理器", "GPU": "图形处理器",
    "iPhone": "苹果手机", "iPad": "苹果平板", "Android": "安卓", "Windows": "视窗系统", "macOS": "苹果系统",
}
PUNCTUATION = {"...": "。", "…": "。", "!": "！", "?": "？", ":": "：", ";": "；", ",": "，", ".": "。", '"': '"', "'": "'", "(": "（", ")": "）"}
CONTRACTIONS = {"don't": "do not", "won't": "will not", "can't": "cannot", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am"}
DIGITS = "零一二三四五六七八九"
BRACKETS = [r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", r"<[^>]*>", r"（[^）]*）", r"【[^】]*】"]
NUMBER_FORMS = [r"\d+\.\d+", r"\d+:\d+:\d+", r"\d+:\d+", r"\d+\.\d+\.\d+\.\d+", r"\d+\.\d+\.\d+", r"v\d+\.\d+", r"V\d+\.\d+", r"\d+\)", r"\(\d+\)"]
COUNTED_FORMS = [
    r"\d+、", r"第\d+", r"\d+[年月日号]", r"\d+[点时分秒]", r"\d+[个件条项次遍回趟]", r"\d+[万千百十亿]", r"\d+[页章节段行列]",
    r"\d+[楼层]", r"\d+[级岁届期]", r"[约大概超过不到]\d+", r"\d+多", r"[第共总计累计约]\d+",
]
DASH_STOPS = "，。！？；：,.:;!?()（）\\[\\]【】{}\"<>"
ANNOTATIONS = [r"\(字幕翻译[：:][^)]*\)", r"\([说注备][明注：][：:][^)]*\)", r"\(单元[^)]*预览[^)]*\)"]
SENTENCE_ENDS, CLAUSE_ENDS = "。！？；.!?;", "，。！？；：,.:;!?"
PRESETS = {"short": 100, "subtitle": 150, "default": 200, "long": 300}

_SPACE = r"(?U)\s+"


def _sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return _sub(text, r"(?U)^\s+|\s+$")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(_sub(text, _SPACE, " "))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; a column that is named twice may else be computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_html(text: Column, mode: str = "tags") -> Column:
    """Without tags: `tags` trims, `collapse` also collapses white space, `vtt` also drops {…}, `plain` also drops special characters."""
    text = _sub(_none(text), r"<[^>]*>")
    if mode == "collapse":
        return collapse(text)
    if mode == "vtt":
        return strip(_sub(text, r"\{[^}]*\}"))
    if mode == "plain":
        return collapse(_sub(text, r"""(?U)[^\w\s一-鿿　-〿＀-￯.,!?;:'"()\-]"""))
    return strip(text)


def clean_ass_text(text: Column) -> Column:
    """Without {…}, and with written line breaks and hard spaces as spaces."""
    return collapse(_sub(_sub(_none(text), r"\{[^}]*\}"), r"\\[Nnh]", " "))


@lru_cache(maxsize=1)
def _encodable() -> str:
    """A character class of what GBK can write, as ranges, without symbols and dingbats."""

    def good(i: int) -> bool:
        try:
            chr(i).encode("gbk")
        except UnicodeEncodeError:
            return False
        return not (0x2600 <= i <= 0x27BF or 0xFE00 <= i <= 0xFE0F)

    ranges: list[list[int]] = []
    for i in filter(good, range(0xD800)):
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    for i in filter(good, range(0xE000, 0x10000)):
        if ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" if a < b else f"\\u{a:04x}" for a, b in ranges)


def strip_unencodable(text: Column) -> Column:
    """Without emoji, symbols and whatever GBK can't write."""
    # The class has thousands of ranges; ASCII, all of which is kept, does not get that far.
    return strip(_sub(_none(text), f"(?=[^\\x00-\\x7f])[^{_encodable()}]"))


def fix_numbers(text: Column) -> Column:
    """Full-width digits and marks inside numbers as ASCII."""
    text = F.translate(_none(text), "０１２３４５６７８９．", "0123456789.")
    text = _sub(text, r"(\d+)。(\d+)。(\d+)。(\d+)", "$1.$2.$3.$4")
    text = _sub(text, r"([vV])。(\d+)", "$1.$2")
    text = _sub(text, r"(\d+)。(\d{1,3})(?!\d)", "$1.$2")
    return F.translate(text, "：", ":")


def strip_brackets(text: Column) -> Column:
    """Without brackets of six kinds and what they hold."""
    return collapse(reduce(_sub, BRACKETS, _none(text)))


def gentle_strip_brackets(text: Column) -> Column:
    """Without annotations in brackets only; where nothing else is left, what stands outside of round brackets."""
    clean = strip_unencodable(text)
    kept = collapse(reduce(_sub, ANNOTATIONS, clean))
    return F.when(kept != "", kept).otherwise(collapse(_sub(clean, r"[\(（][^\)）]*[\)）]", " ")))


def is_pure_bracket(text: Column) -> Column:
    """Whether the text is one bracket and nothing else."""
    return F.coalesce(strip(text).rlike("^(?:" + "|".join(BRACKETS) + ")$"), F.lit(False))


def spell_symbols(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), SIGN_WORDS.items(), _none(text))


def basic_clean(text: Column) -> Column:
    """Encodable, numbers mended, no brackets, signs spelled; nothing where only marks or one character are left."""
    bare = strip(spell_symbols(strip_brackets(fix_numbers(strip_unencodable(text)))))

    def rest(t: Column) -> Column:
        return F.when(t.rlike(r"(?U)^[^\w\s]*$") | (F.char_length(t) <= 1), F.lit("")).otherwise(strip_unencodable(_sub(t, _SPACE, " ")))

    return _let(bare, rest)


def validate_text(text: Column, longest: int = 200) -> Column:
    """struct(is_valid, error_message) of a text before it is processed."""
    blank = F.coalesce(strip(text) == "", F.lit(True))
    size = F.char_length(text)
    message = F.when(blank, F.lit("empty text")).when(size > longest * 10, F.concat(F.lit("text too long: "), size))
    return F.struct(message.isNull().alias("is_valid"), message.alias("error_message"))


def _count(text: Column, kind: str) -> Column:
    return F.char_length(_sub(text, f"[^{kind}]+"))


def detect_language(text: Column) -> Column:
    """ko for any Hangul, ja for any kana, zh or mixed by the share of Han and Latin, en for any Latin, else unknown."""
    return _let(strip(_none(text)), _language)


def _language(text: Column) -> Column:
    size = F.greatest(F.char_length(text), F.lit(1))
    han, latin = _count(text, r"一-鿿"), _count(text, "a-zA-Z")
    # Nothing is counted twice, and the letters only where they decide.
    return (
        F.when(text.rlike(r"[가-힯]"), "ko")
        .when(text.rlike(r"[぀-ヿ]"), "ja")
        .when(han / size > 0.3, F.when(latin / size > 0.2, "mixed").otherwise("zh"))
        .when(text.rlike("[a-zA-Z]"), "en")
        .otherwise("unknown")
    )


def replace_terms(text: Column) -> Column:
    """Terms replaced in order, inside of words too."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), TERMS.items(), _none(text))


def space_capitals(text: Column) -> Column:
    return _sub(_none(text), r"(?<!^)([A-Z])", " $1")


def space_alnum(text: Column) -> Column:
    return _sub(_none(text), r"(?U)(?<=[a-zA-Z])(?=\d)|(?<=\d)(?=[a-zA-Z])", " ")


def _outside(text: Column, keep: str, change) -> Column:
    """Applies `change` to what lies between the matches of `keep`, which stay as they are."""

    def parts(t: Column) -> Column:
        kept = F.regexp_extract_all(t, F.lit(f"({keep})"), F.lit(1))
        return F.array_join(F.zip_with(F.split(t, keep, -1), kept, lambda gap, own: F.concat(change(gap), F.coalesce(own, F.lit("")))), "")

    return _let(text, parts)


def space_protected(text: Column) -> Column:
    """space_capitals and space_alnum outside of versions, addresses and a few names."""
    keep = r"[vV]\d+\.\d+|IP\d+\.\d+\.\d+\.\d+|IP地址|(?:API|URL|CPU|GPU)\d*"
    spaced = _outside(_none(text), keep, lambda t: _sub(space_alnum(t), r"(?U)(\p{Lu})", " $1"))
    return F.when(F.substring(_none(text), 1, 1).rlike(r"\p{Lu}"), F.ltrim(spaced)).otherwise(spaced)


def dash_to_words(text: Column) -> Column:
    """A dash between digits, each within five characters and before any mark, reads 至; any other is a comma."""
    near = f"[^{DASH_STOPS}]" + "{0,4}"
    ranges = _sub(_none(text), f"(?<=\\d{near})[-–](?={near}\\d)", "至")
    return F.translate(ranges, "-–", "，，")


def number_to_words(digits: Column) -> Column:
    """A number up to 9999 in words; a larger one digit by digit. 1005 reads with two zeros."""
    n = digits.cast("bigint")
    word = lambda d: F.element_at(F.array(*[F.lit(c) for c in DIGITS]), (d + 1).cast("int"))
    ones = lambda d: F.when(d > 0, word(d)).otherwise("")

    def tens(r: Column, first: str) -> Column:
        """10 to 99; `first` is how its ten begins below 20."""
        return F.when(r < 20, F.concat(F.lit(first), F.lit("十"), ones(r % 10))).otherwise(F.concat(word(F.floor(r / 10)), F.lit("十"), ones(r % 10)))

    def hundreds(r: Column) -> Column:
        low = r % 100
        rest = F.when(low == 0, F.lit("")).when(low < 10, F.concat(F.lit("零"), word(low))).otherwise(tens(low, "一"))
        return F.concat(word(F.floor(r / 100)), F.lit("百"), rest)

    low = n % 1000
    small = F.when(low < 10, F.concat(F.lit("零零"), word(low))).otherwise(F.concat(F.lit("零"), tens(low, "")))
    rest = F.when(low == 0, F.lit("")).when(low < 100, small).otherwise(hundreds(low))
    thousands = F.concat(word(F.floor(n / 1000)), F.lit("千"), rest)
    spelled = F.when(n < 10, word(n)).when(n < 100, tens(n, "")).when(n < 1000, hundreds(n)).when(n < 10_000, thousands)
    return F.coalesce(spelled, digitwise(digits))


def digitwise(digits: Column) -> Column:
    return F.translate(digits, "0123456789", DIGITS)


def percent_to_words(text: Column) -> Column:
    """A number before a per cent sign, spelled behind 百分之."""
    pattern = r"(\d+(?:\.\d+)?)\s*%"

    def spell(n: Column) -> Column:
        whole = number_to_words(F.substring_index(n, ".", 1))
        part = F.when(F.contains(n, F.lit(".")), F.concat(F.lit("点"), digitwise(F.substring_index(n, ".", -1)))).otherwise("")
        return F.concat(F.lit("百分之"), whole, part)

    def spelled(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        pairs = F.zip_with(F.split(t, pattern, -1), found, lambda gap, n: F.concat(gap, F.when(n.isNotNull(), spell(n)).otherwise("")))
        return F.when(F.contains(t, F.lit("%")), F.array_join(pairs, "")).otherwise(t)

    return _let(_none(text), spelled)


def spell_single_digits(text: Column) -> Column:
    """Digits that stand alone, in words, outside of numbers of other forms."""
    single = lambda gap: reduce(lambda t, d: _sub(t, rf"(?U)\b{d}\b", DIGITS[d]), range(10), gap)
    # A protected form counts as a letter for the borders of words around it.
    mark = "X"
    keep = "|".join(f"(?:{p})" for p in NUMBER_FORMS + COUNTED_FORMS)
    left, right = (lambda i: (i > 0).cast("int")), (lambda i, last: (i < last).cast("int"))

    def spelled(t: Column) -> Column:
        gaps, kept = F.split(t, keep, -1), F.regexp_extract_all(t, F.lit(f"({keep})"), F.lit(1))
        last = F.size(kept)
        marked = F.transform(gaps, lambda g, i: single(F.concat(F.repeat(F.lit(mark), left(i)), g, F.repeat(F.lit(mark), right(i, last)))))
        bare = F.transform(marked, lambda g, i: F.substring(g, left(i) + 1, F.char_length(g) - left(i) - right(i, last)))
        return F.array_join(F.zip_with(bare, kept, lambda gap, own: F.concat(gap, F.coalesce(own, F.lit("")))), "")

    return _let(_none(text), spelled)


def map_punctuation(text: Column) -> Column:
    """ASCII marks as full-width ones, outside of numbers; of 192.168.1.1 the middle point is outside."""
    # All forms begin with a digit, a bracket or a v; looking for that first spares most places the nine tries.
    keep = r"(?=[\d(vV])(?:" + "|".join(f"(?:{p})" for p in NUMBER_FORMS) + ")"
    return _outside(_none(text), keep, lambda t: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), PUNCTUATION.items(), t))


def expand_contractions(text: Column) -> Column:
    """Nine contractions, in any case; isn't stays."""
    spelled = reduce(lambda t, kv: _sub(t, rf"(?iU)\b{kv[0]}\b", kv[1]), CONTRACTIONS.items(), text)
    return F.when(F.contains(text, F.lit("'")), spelled).otherwise(_none(text))


def deep_normalize(text: Column, language: Column) -> Column:
    """All of the above in their fixed order, by language."""
    text = percent_to_words(dash_to_words(space_alnum(space_capitals(replace_terms(text)))))
    by_language = lambda t: F.when(language.isin("zh", "mixed"), spell_single_digits(t)).when(language == "en", expand_contractions(t)).otherwise(t)
    return collapse(map_punctuation(_let(text, by_language)))


def _pieces(text: Column, ends: str) -> Column:
    parts = F.transform(F.split(_none(text), f"(?<=[{ends}])"), strip)
    return F.filter(parts, lambda p: p != "")


def split_sentences(text: Column) -> Column:
    return _pieces(text, SENTENCE_ENDS)


def split_punctuation(text: Column) -> Column:
    return _pieces(text, CLAUSE_ENDS)


def split_length(text: Column, longest: int = 200) -> Column:
    """Words packed greedily into pieces of at most `longest` characters; a longer word is a piece of its own."""
    # As many characters as fit, up to a last one with a space or nothing behind it; or else a word that is longer.
    more = f"(?:.{{0,{longest - 2}}}[^ ])?" if longest > 1 else ""
    return F.regexp_extract_all(collapse(_none(text)), F.lit(f"(?s)([^ ]{more}(?![^ ])|[^ ]+)"), F.lit(1))


def split_adaptive(text: Column, longest: int = 200) -> Column:
    """Sentences, and words packed where a sentence is too long."""
    return F.flatten(F.transform(split_sentences(text), lambda s: F.when(F.char_length(s) <= longest, F.array(s)).otherwise(split_length(s, longest))))


def split_text(text: Column, strategy: str = "adaptive", longest: int = 200) -> Column:
    """Pieces of a text by strategy; a text that is short enough is one piece."""
    cut = {"sentence": split_sentences, "punctuation": split_punctuation, "length": lambda t: split_length(t, longest), "adaptive": lambda t: split_adaptive(t, longest)}

    def pieces(t: Column) -> Column:
        whole = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
        return F.when(F.char_length(t) <= longest, whole).otherwise(cut.get(strategy, F.array)(t))

    return _let(_none(text), pieces)


def validate_segments(text: Column, segments: Column, longest: int = 200) -> Column:
    """struct(is_valid, error_message) of processed text; the message names the first piece that is too long."""
    at = F.array_position(F.transform(segments, lambda s: F.char_length(s) > longest), True)
    message = (
        F.when(strip(text) == "", F.lit("no text left"))
        .when(F.size(segments) == 0, F.lit("no segments"))
        .when(at > 0, F.concat(F.lit("segment "), at.cast("string"), F.lit(" too long")))
    )
    return F.struct(message.isNull().alias("is_valid"), message.alias("error_message"))


def process_text(text: Column, strategy: str = "adaptive", longest: int = 200) -> Column:
    """struct(cleaned, segments, language, is_valid, error_message): check, detect, clean, normalise, split, check again."""
    before = validate_text(text, longest)
    kind = F.when(before["is_valid"], detect_language(text)).otherwise("unknown")

    def cleaned(language: Column) -> Column:
        clean = F.when(before["is_valid"], deep_normalize(basic_clean(text), language)).otherwise("")
        return _let(clean, lambda t: F.struct(language.alias("language"), t.alias("cleaned"), split_text(t, strategy, longest).alias("segments")))

    def checked(r: Column) -> Column:
        after = validate_segments(r["cleaned"], r["segments"], longest)
        return F.struct(
            r["cleaned"].alias("cleaned"), r["segments"].alias("segments"), r["language"].alias("language"),
            (before["is_valid"] & after["is_valid"]).alias("is_valid"), F.coalesce(before["error_message"], after["error_message"]).alias("error_message"),
        )

    return _let(_let(kind, cleaned), checked)


def sanitize_name(name: Column) -> Column:
    """A file name of letters, digits and single underscores; `unnamed` where nothing is left."""
    out = reduce(lambda t, p: _sub(t, p, "_"), [r'[<>:"/\\|?*]', r"[@#&%=+]", r"(?U)[.\-\s]", "_+"], _none(name))
    return F.coalesce(F.nullif(_sub(out, "^_+|_+$"), F.lit("")), F.lit("unnamed"))


# Parts of a lower-cased error text, and the reason that they tell of; the first row that fits counts.
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


def classify_failure(message: Column) -> Column:
    """The reason that an error text tells of; a short text of the encoder is `encoder`, any other `other`."""
    low = F.lower(_none(message))
    has = lambda part: reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in ([part] if isinstance(part, str) else part)])
    out = F.when(F.contains(low, F.lit("ffmpeg error")) & (F.char_length(message) < 50), "encoder").otherwise("other")
    for parts, reason in reversed(FAILURES):
        out = F.when(reduce(lambda a, b: a | b, map(has, parts)), reason).otherwise(out)
    return out
