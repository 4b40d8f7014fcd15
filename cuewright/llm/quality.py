"""Quality rules: plain counts of a text, and bands of perplexity under a modified Kneser-Ney n-gram model for each language.

The n-grams are runs of ORDER characters of lower-cased text (UTF-16 units, so that any script and sign is itself and a run is one 64-bit
number). A text is never judged by what it taught: texts are dealt to two halves by a hash of the text, and each half is scored by the model of
the other. A half learns from its texts that pass the plain rules, each distinct one once. Spark counts n-grams by language and half (each task sums
its own first), and gets continuation counts, discounts and interpolated probabilities from them by grouping and joining, also for the n-grams
that only the scored half has. These are stored as arrays of log-probabilities in the order of the n-grams' hashes, which scoring searches. Arrays up to
MODEL_BYTES go to all tasks; a larger model stays a table that the documents' n-grams are joined with; both hold the same numbers.
A language's band of log-perplexity is the shortest interval with half of its distinct documents that pass the plain rules, so that junk moves it only
where it is over half of them, widened by BAND times its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import checkpointed, in_batches, small

ORDER, UNIT_BITS = 4, 16
#: Bound on the model that each task holds, at 12 bytes for an n-gram.
MODEL_BYTES, NGRAM_BYTES = 96 << 20, 12
#: n-grams that a task sums up before it merges them.
PENDING = 2_000_000
#: A band's least spread, and what a language of one document has more; n documents have that by the root of n.
BAND, LEAST_SPREAD, FEW_SPREAD = 8.0, 0.02, 0.3
LEAST_WORDS, MOST_REPEATED = 50, 50
MARKS = b"#*$%&|<>"

_IS_MARK = np.isin(np.arange(256), list(MARKS))
_NO_TAIL = (np.arange(256) & 0xC0) != 0x80
_IS_SPACE = np.array([chr(i).isspace() for i in range(1 << UNIT_BITS)])


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each unit of each row, and the rows' offsets in them.

    Runs of white space count as one space; each row has ORDER - 1 more before it.
    """
    text = [data[a:b].tobytes().decode().lower().encode("utf-16-le", "surrogatepass") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    cut = np.append(0, np.cumsum([len(t) // 2 for t in text]))
    s = np.frombuffer(b"".join(text), np.uint16)
    blank = _IS_SPACE[s]
    s = np.where(blank, np.uint16(32), s)
    keep = np.ones(len(s), bool)
    keep[1:] = ~blank[1:] | ~blank[:-1]
    keep[cut[:-1][cut[:-1] < len(s)]] = True
    cut = np.append(0, np.cumsum(keep))[cut]
    s = s[keep]
    pad = ORDER - 1
    rows = len(offsets) - 1
    padded = np.full(len(s) + pad * rows, 32, np.uint64)
    at = np.arange(len(s)) + pad * (np.repeat(np.arange(rows), np.diff(cut)) + 1)
    padded[at] = s
    code = padded[at]
    for k in range(1, ORDER):
        code = code | padded[at - k] << np.uint64(UNIT_BITS * k)
    return code, cut


def _by_language(languages: list, cut: np.ndarray):
    """(language, numbers of its rows' n-grams) for each language of some rows."""
    names = {c: i for i, c in enumerate(dict.fromkeys(languages))}
    of = np.repeat(np.array([names[c] for c in languages], np.int64), np.diff(cut))
    for c, i in names.items():
        yield c, np.flatnonzero(of == i) if len(names) > 1 else np.arange(len(of))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code)
    code, n = code[order], n[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.add.reduceat(n, at) if len(at) else n


def _fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _teaches(data: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Whether each row passes the plain rules."""
    start, end, first_word = W.word_spans(data, offsets)
    return (~_fails(np.diff(first_word), repeated_words(W.word_hashes(data, start, end), first_word))).tolist()


def _count(batches: Iterator[pa.RecordBatch], plain: bool = False) -> Iterator[pa.RecordBatch]:
    """How often n-grams come by language; with `plain`, how often in texts that pass the plain rules, which may be 0."""
    sums: dict = defaultdict(list)
    held = 0

    def out(language):
        code, n = _merged(sums[language])
        return pa.RecordBatch.from_arrays([pa.array([language] * len(code), pa.string()), W.as_long(code), pa.array(n)], ["lang", "code", "n"])

    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for first, last, data, offsets in W.chunked(batch):
            codes, cut = ngrams(data, offsets)
            teaches = _teaches(data, offsets) if plain else [True] * (last - first)
            for (c, counts), at in _by_language(list(zip(languages[first:last], teaches, strict=True)), cut):
                code, n = np.unique(codes[at], return_counts=True)
                sums[c].append((code, n * counts))
                held += len(code)
            if held > PENDING:
                sums = defaultdict(list, {c: [_merged(parts)] for c, parts in sums.items()})
                held = sum(len(parts[0][0]) for parts in sums.values())
                if held > PENDING // 2:
                    yield from map(out, sums)
                    sums, held = defaultdict(list), 0
    yield from map(out, sums)


def _tail(code, units: int):
    return F.col(code).bitwiseAND(F.lit((1 << UNIT_BITS * units) - 1))


def _discounts(level: DataFrame) -> DataFrame:
    """For each language the discounts d1, d2, d3 of n-grams that occur once, twice, and more often, from the numbers of those that occur 1 to 4 times."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = [F.col("lang").alias("of")]
    for k in (1, 2, 3):
        raw = F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))).otherwise(0.5)
        out.append(F.least(F.greatest(raw, F.lit(0.0)), F.lit(k - 0.01)).alias(f"d{k}"))
    return small(n.select(*out))


def estimate(counts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """lang, code, logp: modified Kneser-Ney log-probability of the last unit of each n-gram after the others, learned from counts (lang, code, n), for
    the n-grams of asked (lang, code), by default those of counts. No lang may be null. Where nothing was learned, all units weigh the same."""
    orders, wanted = [counts], [counts if asked is None else asked]
    for k in range(ORDER - 1, 0, -1):
        tail = ["lang", _tail("code", k).alias("code")]
        orders.append(checkpointed(orders[-1].groupBy(*tail).agg(F.count("*").alias("n"))))
        wanted.append(orders[-1] if asked is None else checkpointed(wanted[-1].select(*tail).distinct()))
    lower = None
    for k, (level, want) in enumerate(zip(reversed(orders), reversed(wanted), strict=True)):
        found = _discounts(level)
        own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        known = level.join(found, level.lang == found.of).drop("of").select("lang", "code", "n", own.alias("rest"))
        if asked is not None:
            known = checkpointed(known)
        context = F.shiftrightunsigned("code", UNIT_BITS)
        whole = known.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.sum("rest").alias("left"), F.count("*").alias("seen"))
        rows = known if asked is None else want.select("lang", "code").join(known, ["lang", "code"], "left")
        rows = rows.withColumn("context", context).join(whole, ["lang", "context"], "left")
        if lower is None:
            # Below single units, all that the language has, and one more for what it has not, weigh the same.
            back = F.coalesce(1 / (F.col("seen") + 1), F.lit(2.0**-UNIT_BITS))
        else:
            tail = lower.select("lang", F.col("code").alias("tail"), F.col("p").alias("back"))
            rows = rows.withColumn("tail", _tail("code", k)).join(tail, ["lang", "tail"])
            back = F.col("back")
        above = F.coalesce((F.col("n") - F.col("rest")) / F.col("total"), F.lit(0.0))
        p = F.coalesce(above + F.col("left") / F.col("total") * back, back)
        lower = checkpointed(rows.select("lang", "code", p.alias("p")))
    return lower.select("lang", "code", F.log("p").alias("logp"))


def _counts(rows: DataFrame, plain: bool = False) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batches, plain)

    return rows.select("lang", "text").transform(in_batches, work, "lang string, code long, n long")


def train(rows: DataFrame) -> DataFrame:
    """lang, code, logp: the model of the rows (lang, text), which knows every n-gram of them. No lang may be null."""
    return estimate(checkpointed(_counts(rows).groupBy("lang", "code").agg(F.sum("n").alias("n"))))


def train_halves(rows: DataFrame) -> DataFrame:
    """lang, code, logp: for each n-gram of the rows (lang, text, row_key), its log-probability under what the other half of the language teaches.
    A lang begins with its half, 0 or 1.

    Texts that come more than once teach once: their keys are found first, and only they are grouped. These keys are broadcast within the bound of
    small(); beyond that the rows are shuffled by key.
    """
    copied = small(rows.groupBy("row_key").count().filter("count > 1").select("row_key"))
    once = rows.join(copied, "row_key", "left_anti")
    first = rows.join(copied, "row_key", "left_semi").groupBy("row_key").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    found = _counts(once, True).unionByName(_counts(first, True))
    counts = checkpointed(found.groupBy("lang", "code").agg(F.sum("n").alias("n")))
    other = F.translate(F.substring("lang", 1, 1), "01", "10")
    taught = counts.filter("n > 0").withColumn("lang", F.concat(other, F.expr("substring(lang, 2)")))
    return checkpointed(estimate(taught, counts))


@dataclass
class Store:
    """Log-probabilities of n-grams in the order of their hashes, with the place where each beginning of hashes starts."""

    hashes: np.ndarray
    logs: np.ndarray
    bits: int
    starts: np.ndarray

    @staticmethod
    def of(code: np.ndarray, logs: np.ndarray) -> Store:
        hashes = W.mix(code)
        order = np.argsort(hashes)
        hashes, bits = hashes[order], max(1, len(code).bit_length())
        starts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return Store(hashes, logs[order].astype(np.float32), bits, starts.astype(np.int32))

    def find(self, code: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams that the store has."""
        h = W.mix(code)
        at = self.starts[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        on = np.flatnonzero(self.hashes[at] < h)
        while len(on):
            at[on] += 1
            on = on[self.hashes[at[on]] < h[on]]
        return self.logs[at]


def _scores(model):
    """Sum of log-probabilities, and number of n-grams, of each row of a chunk, from a broadcast store for each language."""

    def score(languages: list, codes: np.ndarray, cut: np.ndarray) -> np.ndarray:
        logs = np.zeros(len(codes))
        for c, at in _by_language(languages, cut):
            if len(at):
                logs[at] = model.value[c].find(codes[at])
        return np.diff(np.append(0.0, np.cumsum(logs))[cut])

    return score


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct n-gram of each row, with how often it comes."""
    for batch in batches:
        for first, last, data, offsets in W.chunked(batch):
            codes, cut = ngrams(data, offsets)
            found = [np.unique(codes[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            rows = pa.array(np.repeat(np.arange(first, last), [len(c) for c, _ in found]))
            flat = [np.concatenate([f[i] for f in found]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("row_key", "lang")], W.as_long(flat[0]), pa.array(flat[1].astype(np.int64))], ["row_key", "lang", "code", "m"])


def _joined_scores(rows: DataFrame, model: DataFrame) -> DataFrame:
    """row_key, joined: mean log-probability of each row's n-grams, by a join with a model too large for the tasks."""
    found = rows.transform(in_batches, _distinct, "row_key long, lang string, code long, m long").join(model, ["lang", "code"])
    return found.groupBy(F.col("row_key").alias("key")).agg((F.sum(F.col("m") * F.col("logp")) / F.sum("m")).alias("joined"))


def line_repeats(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(W.SEPARATORS)]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a run of three words that the row has twice or more."""
    at = W.gram_starts(first_word, 3)
    row = np.searchsorted(first_word, at, "right") - 1
    grams = W.mix(W.gram_hashes(hashes, at, 3) + row.astype(np.uint64))
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    cover = np.zeros(len(hashes) + 3, np.int64)
    cover[again] += 1
    cover[again + 3] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(cover)[: len(hashes)] > 0))
    return np.diff(covered[first_word])


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _measure(score):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for first, last, data, offsets in W.chunked(batch):
                start, end, first_word = W.word_spans(data, offsets)
                points = np.append(0, np.cumsum(_NO_TAIL[data]))
                chars = np.append(0, np.cumsum(points[end] - points[start]))
                marks = np.append(0, np.cumsum(_IS_MARK[data]))
                loss = np.zeros(last - first)
                if score is not None:
                    codes, cut = ngrams(data, offsets)
                    loss = -score(languages[first:last], codes, cut) / np.maximum(np.diff(cut), 1)
                lines = [line_repeats(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [
                    np.diff(first_word), np.diff(chars[first_word]), np.diff(marks[offsets]), np.array(lines),
                    repeated_words(W.word_hashes(data, start, end), first_word),
                ]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("doc_id", "lang", "row_key")], *[pa.array(c.astype(np.int64)) for c in columns], pa.array(loss)],
                    ["doc_id", "lang", "row_key", *[x.split()[0] for x in COUNTS.split(", ")], "log_perplexity"],
                )

    return measure


def quality(docs: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and log_perplexity for every row of docs (doc_id, text, lang).

    base_failed: fewer than 50 words, or over half of them in repeated runs of three. kept: not base_failed, and the
    log-perplexity lies within the band of the document's language (a null language is one of its own). Null or empty text:
    all counts 0, base_failed. Repeated rows each get their row, and teach and weigh as one. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    # A language's name with a sign before it, so that no language at all is a name too, and before that the half of the text.
    half = F.xxhash64(F.lit("half"), text).bitwiseAND(F.lit(1)).cast("string")
    lang = F.concat(half, F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang"), F.xxhash64(text, lang).alias("row_key"))
    model = train_halves(rows).select("lang", "code", F.col("logp").cast("float").alias("logp"))
    fits = model.count() * NGRAM_BYTES <= model_bytes
    score = None
    if fits:
        found = model.toArrow()
        names = found["lang"].combine_chunks().dictionary_encode()
        of, code, logs = names.indices.to_numpy(), found["code"].to_numpy().view(np.uint64), found["logp"].to_numpy()
        stores = {c: Store.of(code[at], logs[at]) for i, c in enumerate(names.dictionary.to_pylist()) for at in [np.flatnonzero(of == i)]}
        score = _scores(spark.sparkContext.broadcast(stores))
    measured = rows.transform(in_batches, _measure(score), f"doc_id long, lang string, row_key long, {COUNTS}, log_perplexity double")
    if not fits:
        joined = _joined_scores(rows.dropDuplicates(["row_key"]), model)
        measured = measured.join(joined, measured.row_key == joined.key, "left").withColumn("log_perplexity", F.coalesce(-F.col("joined"), F.lit(0.0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    # Sums in another order differ in their last digits.
    loss = F.round("log_perplexity", 9)
    measured = checkpointed(measured.withColumns({"base_failed": failed, "log_perplexity": loss, "lang": F.expr("substring(lang, 2)")}))
    distinct = measured.filter("not base_failed").groupBy("lang", "row_key").agg(F.first("log_perplexity").alias("loss"))
    hundredths = distinct.groupBy("lang").agg(F.percentile_approx("loss", [i / 100 for i in range(101)], 10_000).alias("q"), F.count("*").alias("n"))
    half_of = F.expr("array_min(transform(sequence(0, 50), i -> struct(q[i + 50] - q[i] AS length, q[i] AS low, q[i + 50] AS high)))")
    spread = F.greatest(F.col("s.length"), F.lit(LEAST_SPREAD), FEW_SPREAD / F.sqrt("n")) * BAND
    bands = small(hundredths.select("lang", "n", half_of.alias("s")).select("lang", (F.col("s.low") - spread).alias("low"), (F.col("s.high") + spread).alias("high")))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    found = measured.join(bands, "lang", "left").withColumn("kept", kept)
    return found.select("doc_id", *[x.split()[0] for x in COUNTS.split(", ")], "base_failed", "kept", "log_perplexity")
