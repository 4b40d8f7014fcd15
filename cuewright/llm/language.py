"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams, of all orders from 1 to ORDER together, that are present in
both, divided by the root of the product of the numbers present in each. Some labelled texts are the landmarks of a Nystroem
approximation, the basis in which texts are written; a one-versus-rest kernel ridge regression on it learns from all distinct labelled
texts, whose products Spark sums up, and so do counts and thresholds. The kernel with the landmarks is a matrix product of presence
vectors (n-grams hashed to DIMENSIONS places); with the regression's weights behind it, a batch of texts is scored by one product with a
matrix that has a column for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import checkpointed, in_batches, small

ORDER = 3
DIMENSIONS = 1 << 13
#: Landmarks are chosen among at most so many rows of each language, and so many of all languages together, but at least one of each.
ROWS_PER_LANGUAGE, ROWS = 400, 25_600
LANDMARKS = 256
RIDGE = 1e-2
BATCH_BYTES, BATCH_ROWS = 1 << 18, 256
#: Sums of tasks are whole numbers of these fractions, so that they do not depend on an order; a task gives its sums away when it has so many languages.
FRACTION, BIN, MOST_HELD = float(1 << 50), 1024, 128
UNKNOWN = "und"
#: What a text must be like to be of a language, see Evidence and gather_evidence().
LOW, REACH, LEAST_DISTANCE, NOISE = 0.05, 2.0, 0.3, 3.0


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the order, and the row, the place and the middle code point of all its n-grams. Letter case does not count."""
    text = [data[a:b].tobytes().decode().lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    lengths = np.array([len(t) for t in text], np.int64)
    points = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(text)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(points))
    h = np.zeros(len(points), np.uint32)
    for n in range(1, ORDER + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        h = (h[:size] + points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        place = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
        inside = at[:size] + n <= end[:size]
        yield n, row[:size][inside], place[inside], points[n // 2 : n // 2 + size][inside]


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x DIMENSIONS, true where a text has an n-gram of that place."""
    found = np.zeros((len(offsets) - 1, DIMENSIONS), bool)
    for _, row, place, _ in grams(data, offsets):
        found.reshape(-1)[row * DIMENSIONS + place] = True
    return found


def unit(found: np.ndarray) -> np.ndarray:
    """Presence rows of length 1; their products are the kernel."""
    x = found.astype(np.float32)
    return x / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    #: DIMENSIONS x languages, and a constant for each language.
    weights: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.constant


def choose(labels: list[str], languages: list[str]) -> np.ndarray:
    """Numbers of the rows that are landmarks, about as many of each language."""
    of = [np.flatnonzero(np.array(labels, object) == c) for c in languages]
    each = max(1, LANDMARKS // len(languages))
    return np.concatenate([rows[np.linspace(0, len(rows) - 1, min(each, len(rows))).astype(int)] for rows in of])


def solve(landmarks: np.ndarray, languages: list[str], products: np.ndarray, means: np.ndarray) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features, from the weighted mean of the products of all rows' kernels with the landmarks, and
    each language's mean of these kernels. Every language weighs the same, however many rows there are of it."""
    landmarks = landmarks.astype(np.float64)
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    n = len(languages)
    mean_x, mean_y = means.mean(axis=0) @ root, np.full(n, 2 / n - 1)
    gram = root.T @ products @ root - np.outer(mean_x, mean_x) + RIDGE * np.eye(root.shape[1]) / n
    goals = root.T @ (2 * means / n - means.mean(axis=0)).T - np.outer(mean_x, mean_y)
    beta = np.linalg.solve(gram, goals)
    return Model(languages, (landmarks.T @ root @ beta).astype(np.float32), (mean_y - mean_x @ beta).astype(np.float32))


NOTHING = Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32))


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """The regression of unit rows that are at hand."""
    languages = sorted(set(labels))
    if not languages:
        return NOTHING
    landmarks = x[choose(labels, languages)]
    k = (x @ landmarks.T).astype(np.float64)
    own = (np.array(labels, object) == np.array(languages, object)[:, None]).astype(np.float64)
    own /= own.sum(axis=1, keepdims=True)
    return solve(landmarks, languages, (k * own.mean(axis=0)[:, None]).T @ k, own @ k)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Presence rows as bits, with their labels."""
    for batch in batches:
        for first, last, data, offsets in W.chunked(batch, limit=BATCH_BYTES, most=BATCH_ROWS):
            bits = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(first, last - first), pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "bits"]
            )


def sample(labelled: DataFrame) -> DataFrame:
    """text, lang: the texts among which landmarks are chosen, distinct ones of every language, ROWS_PER_LANGUAGE of each at most, or an equal part of ROWS where there are many languages.

    The rows of a language are chosen by a hash of their text alone, each distinct text once, so the sample does not depend on how the table is dealt
    out. Rows with a null lang, or without a letter, are not learned from.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("hash"))
    sizes = small(rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts")))
    most = max(1, min(ROWS_PER_LANGUAGE, ROWS // max(1, sizes.count())))
    # A few times the texts that are wanted pass by their hash, so that hardly more than those are shuffled.
    share = F.least(F.lit(1.0), 4 * most / F.col("texts"))
    keyed = rows.withColumns({"h": F.pmod("hash", F.lit(1 << 40)), "h2": F.hash("text")}).join(sizes, "lang")
    keyed = keyed.filter(F.col("h") <= share * (1 << 40)).select("text", "lang", "h", "h2").dropDuplicates(["lang", "h", "h2"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "h2"))
    return keyed.withColumn("place", place).filter(F.col("place") <= most).select("text", "lang")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all n-grams of the highest order around a letter."""
    for n, row, place, middle in grams(data, offsets):
        if n == ORDER:
            good = _letters()[middle]
            return row[good], place[good]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


@dataclass
class Evidence:
    """What the texts of each language are like, whatever other languages there are."""

    #: languages x DIMENSIONS: log-probability of an n-gram around a letter.
    logs: np.ndarray
    #: For each language the least mean log-probability of a long text, and the deviation of a single n-gram.
    least: np.ndarray
    deviation: np.ndarray

    def fits(self, data: np.ndarray, offsets: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Whether each row is like the texts of its language (a number). A text of n n-grams may miss the least mean by NOISE deviations of such a
        mean; one without n-grams fits."""
        row, place = letter_grams(data, offsets)
        rows = len(offsets) - 1
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        mean = np.bincount(row, self.logs[language[row], place], minlength=rows) / n
        return mean >= self.least[language] - NOISE * self.deviation[language] / np.sqrt(n)


def distinct_rows(labelled: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """text, lang: each distinct text of each language once, all of them; and their number by language. Rows with a null lang, or without a letter, are
    not learned from. Only texts that come again are shuffled."""
    keys = ["lang", "h", "h2"]
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("h"), F.hash("text").alias("h2"))
    found = checkpointed(rows.groupBy(*keys).count())
    copied = small(found.filter("count > 1").select(*keys))
    one = checkpointed(rows.join(copied, keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text")).select("text", "lang"))
    sizes = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    return rows.join(copied, keys, "left_anti").select("text", "lang").unionByName(one), sizes


SUMS = "part int, lang string, place long, n long"


def _learned_sums(landmarks, sizes: dict[str, int]):
    """Of all rows of a task: products of their kernels with the landmarks (part 0), and by language their kernels (1) and n-grams around a letter (2)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = landmarks.value.T
        m = basis.shape[1]
        upper = np.triu_indices(m)
        products, held = np.zeros((m, m)), {}

        def rows(part: int, lang: str | None, values: np.ndarray) -> pa.RecordBatch:
            place = np.flatnonzero(values)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), part, np.int32)), pa.array([lang] * len(place), pa.string()), pa.array(place), pa.array(values[place].astype(np.int64))], ["part", "lang", "place", "n"])

        def away() -> Iterator[pa.RecordBatch]:
            for c, (kernels, counts) in held.items():
                yield rows(1, c, np.rint(kernels / sizes[c] * FRACTION))
                yield rows(2, c, counts)
            held.clear()

        for batch in batches:
            for first, last, data, offsets in W.chunked(batch, limit=BATCH_BYTES, most=BATCH_ROWS):
                k = (unit(presence(data, offsets)) @ basis).astype(np.float64)
                names = np.array(batch.column("lang").slice(first, last - first).to_pylist(), object)
                weight = np.array([1 / (len(sizes) * sizes[c]) for c in names])
                products += (k * weight[:, None]).T @ k
                row, place = letter_grams(data, offsets)
                for c in set(names):
                    kernels, counts = held.setdefault(c, (np.zeros(m), np.zeros(DIMENSIONS, np.int64)))
                    own = names == c
                    kernels += k[own].sum(axis=0)
                    counts += np.bincount(place[own[row]], minlength=DIMENSIONS)
            if len(held) > MOST_HELD:
                yield from away()
        yield from away()
        yield rows(0, None, np.rint(products[upper] * FRACTION))

    return sums


def learn(labelled: DataFrame) -> tuple[Model, DataFrame, np.ndarray]:
    """The model of all distinct texts of labelled rows (text, lang); those texts; and the n-grams around a letter of each language, languages x DIMENSIONS."""
    rows, sizes = distinct_rows(labelled)
    languages = sorted(sizes)
    if not languages:
        return NOTHING, rows, np.zeros((0, DIMENSIONS), np.int64)
    found = sorted((r["lang"], bytes(r["bits"])) for r in sample(labelled).transform(in_batches, _features, "lang string, bits binary").collect())
    picked = choose([c for c, _ in found], languages)
    bits = np.frombuffer(b"".join(found[i][1] for i in picked), np.uint8).reshape(len(picked), DIMENSIONS // 8)
    landmarks = unit(np.unpackbits(bits, axis=1))
    shared = labelled.sparkSession.sparkContext.broadcast(landmarks)
    done = rows.transform(in_batches, _learned_sums(shared, sizes), SUMS).groupBy("part", "lang", "place").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    part, place, n = (done[c].to_numpy() for c in ("part", "place", "n"))
    number = {c: i for i, c in enumerate(languages)}
    language = np.array([number.get(c, -1) for c in done["lang"].to_pylist()], np.int64)
    m, upper = len(landmarks), np.triu_indices(len(landmarks))
    products, means, counts = np.zeros((m, m)), np.zeros((len(languages), m)), np.zeros((len(languages), DIMENSIONS), np.int64)
    own = part == 0
    products[upper[0][place[own]], upper[1][place[own]]] = n[own] / FRACTION
    products = np.triu(products) + np.triu(products, 1).T
    own = part == 1
    means[language[own], place[own]] = n[own] / FRACTION
    own = part == 2
    counts[language[own], place[own]] = n[own]
    return solve(landmarks, languages, products, means), rows, counts


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=-1, keepdims=True) + 0.5 * DIMENSIONS))


def _learned_rows(counts, number: dict[str, int]):
    """Of each learned row's n-grams, as its language has them without that row: the mean log-probability in steps of 1 / BIN; by such means the number
    of rows and the sum of their variances."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals = counts.value, counts.value.sum(axis=1)
        for batch in batches:
            names, language = np.unique(np.array([number[c] for c in batch.column("lang").to_pylist()], np.int64), return_inverse=True)
            steps, spread = np.zeros(len(language), np.int64), np.full(len(language), -1.0)
            for first, last, data, offsets in W.chunked(batch, limit=BATCH_BYTES, most=BATCH_ROWS):
                row, place = letter_grams(data, offsets)
                key, times = np.unique(row * DIMENSIONS + place, return_counts=True)
                row, place = key // DIMENSIONS, key % DIMENSIONS
                of, n = names[language[first:last]], np.bincount(row, times, minlength=last - first)
                logs = np.log((sums[of[row], place] - times + 0.5) / (totals[of] - n + 0.5 * DIMENSIONS)[row])
                some = np.maximum(n, 1)
                mean = np.bincount(row, logs * times, minlength=last - first) / some
                variance = np.bincount(row, (logs - mean[row]) ** 2 * times, minlength=last - first) / some
                steps[first:last] = np.rint(mean * BIN)
                spread[first:last] = np.where(n > 0, variance, -1.0)
            good = spread >= 0
            pairs, where = np.unique(np.stack([language[good], steps[good]], axis=1), axis=0, return_inverse=True)
            rows = np.bincount(where.reshape(-1), minlength=len(pairs))
            total = np.bincount(where.reshape(-1), np.rint(spread[good] * (1 << 20)), minlength=len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(rows.astype(np.int64)), pa.array(total)], ["language", "step", "n", "variance"])

    return learned


def quantile(values: np.ndarray, times: np.ndarray, q: float) -> float:
    """numpy's quantile of sorted values that come several times each."""
    upto = np.cumsum(times)
    at = q * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, f(at), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


def gather_evidence(rows: DataFrame, counts: np.ndarray, languages: list[str]) -> Evidence:
    """From the rows and counts of learn(). A language's least mean lies below the median of its own rows by REACH times the distance of their LOW quantile."""
    least, deviation = np.full(len(languages), -np.inf), np.zeros(len(languages))
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    found = rows.transform(in_batches, _learned_rows(shared, {c: i for i, c in enumerate(languages)}), "language long, step long, n long, variance long")
    done = found.groupBy("language", "step").agg(F.sum("n").alias("n"), F.sum("variance").alias("variance")).toArrow().sort_by([("language", "ascending"), ("step", "ascending")])
    shared.unpersist()
    language, step, n, variance = (done[c].to_numpy() for c in ("language", "step", "n", "variance"))
    for c in np.unique(language):
        own = language == c
        middle, low = (quantile(step[own] / BIN, n[own], q) for q in (0.5, LOW))
        least[c] = middle - REACH * max(middle - low, LEAST_DISTANCE)
        deviation[c] = np.sqrt(variance[own].sum() / (1 << 20) / n[own].sum())
    return Evidence(_log_probabilities(counts).astype(np.float32), least, deviation)


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.chunked(batch, limit=BATCH_BYTES, most=BATCH_ROWS):
                part = batch.slice(first, last - first)
                letter = part.column("__has_letter").to_numpy(zero_copy_only=False).astype(bool)
                if model.languages:
                    scores = model.score(unit(presence(data, offsets)))
                    best = scores.argmax(axis=1)
                    sure = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
                    names = np.array(model.languages, object)[best]
                else:
                    letter, sure, names = letter & False, np.zeros(len(letter)), np.full(len(letter), UNKNOWN, object)
                columns = {n: part.column(n) for n in part.schema.names if n not in ("text", "__has_letter")}
                columns["lang_pred"] = pa.array(np.where(letter, names, UNKNOWN).tolist(), pa.string())
                columns["score"] = pa.array(np.where(letter, sure, 0.0), pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return predict


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Rows whose crc32 of doc_id leaves 2 on division by 4 are held out of learning, as are rows with a null doc_id (held_out
    false). A null text, or one without a letter: `und` with score 0; so is every row where nothing can be learned.
    Ties between languages go to the first by code point. Repeated rows each get their row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model, _, _ = learn(rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = rows.select("doc_id", "text", letters.alias("__has_letter"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.transform(in_batches, _predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose text has letters and is like the learned texts of the language that is identified, which is their lang
    from then on.

    The score cannot tell: the scores of a text add up to 1 over the languages, so one of them is always at least 1 / languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model, learned, counts = learn(rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    number = {c: i for i, c in enumerate(model.languages)}
    evidence = docs.sparkSession.sparkContext.broadcast(gather_evidence(learned, counts, model.languages))
    marked = docs.withColumn("__has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column("text"), batch.column("__has_letter")], ["text", "__has_letter"])
            done = pa.Table.from_batches(list(_predict(model)(iter([view]))), pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]))
            language = np.array([number.get(c, -1) for c in done["lang_pred"].to_pylist()], np.int64)
            good = language >= 0
            named = batch.filter(pa.array(good))
            fits = [evidence.value.fits(data, offsets, language[good][first:last]) for first, last, data, offsets in W.chunked(named, limit=BATCH_BYTES, most=BATCH_ROWS)]
            named = named.set_column(named.schema.get_field_index("lang"), "lang", done["lang_pred"].combine_chunks().filter(pa.array(good)))
            yield named.filter(pa.array(np.concatenate([*fits, np.zeros(0, bool)]))).select([n for n in batch.schema.names if n != "__has_letter"])

    return marked.transform(in_batches, keep, docs.schema)
