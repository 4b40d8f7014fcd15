"""The corpus operators against SQL, brute force, round trips or held-out accuracy, on small tables with odd rows."""

import hashlib
import re
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict
from functools import cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import language, mixing, near_dup, neighbours, pieces, pii, pii_lines, quality, shards, substring, warc
from cuewright.llm import words as W
from cuewright.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, root string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, *texts):
    """Rows with ids from 1, and columns that clash with names that operators use."""
    return spark.createDataFrame([(i + 1, t, "en", "a", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """A null text, an empty one, blanks, a null id with nulls beside it, a repeated row, marks and a long text."""
    long = " ".join(f"w{i}" for i in range(30_000))
    base = [(1, None, "en", None), (2, "", None, "a"), (3, " \t\n", "en", "a"), (None, "one two three four five six", None, None), (5, "same row here", "en", "b"), (5, "same row here", "en", "b"), (6, "?!.", "en", "b"), (7, long, "en", "b")]
    return spark.createDataFrame([(*r, 0, "x", "y") for r in base], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    mine, other = QUERIES[name](spark, SF).toPandas(), duck(SF).sql(ORACLE_SQL[name]).df()
    assert rows(mine) == rows(other)


OPERATORS = {
    "identify": language.identify, "near_duplicates": near_dup.near_duplicates, "remove_repeats": substring.remove_repeats, "mix_sources": mixing.mix_sources,
    "quality": quality.quality, "kd_shards": shards.kd_shards, "personal_data": pii.personal_data,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    assert OPERATORS[name](odd(spark)).count() == 8
    assert OPERATORS[name](odd(spark).limit(0)).count() == 0


def test_values_of_odd_rows(spark):
    """What the docstrings define for nulls, blanks, a null id, repeated rows, marks and a long text."""
    table = odd(spark)
    by = lambda frame, *names: sorted((tuple(r[n] for n in names) for r in frame.collect()), key=lambda x: [(v is None, v) for v in x])
    assert by(near_dup.near_duplicates(table), "doc_id", "n_shingles", "component_id", "kept") == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True), (7, 29_996, 7, True), (None, 2, None, True)]
    empty = hashlib.sha256(b"").hexdigest()
    got = substring.remove_repeats(table).collect()
    assert all(r["n_removed"] == 0 for r in got) and {r["doc_id"]: r["n_words"] for r in got} == {1: 0, 2: 0, 3: 0, None: 6, 5: 3, 6: 1, 7: 30_000}
    assert {r["kept_sha256"] for r in got if r["n_words"] == 0} == {empty}
    assert by(language.identify(table), "doc_id", "lang_pred")[:3] == [(1, "und"), (2, "und"), (3, "und")] and by(language.identify(table), "doc_id", "score")[5] == (6, 0.0)
    mixed = {(r["doc_id"], r["source"], r["size"], r["source_size"]) for r in mixing.mix_sources(table).collect()}
    assert mixed == {(1, None, 0, 6), (2, "a", 0, 0), (3, "a", 0, 0), (None, None, 6, 6), (5, "b", 3, 30_007), (6, "b", 1, 30_007), (7, "b", 30_000, 30_007)}
    found = {r["doc_id"]: tuple(r)[1:8] for r in quality.quality(table).collect()}
    assert found[1] == found[2] == found[3] == (0, 0, 0, 0, 0, True, False) and found[7][0] == 30_000 and found[7][5:] == (False, True)
    assert {(r["doc_id"], r["size"]) for r in shards.kd_shards(table).collect()} >= {(1, 16), (2, 16), (3, 19), (6, 19)}
    assert {(r["n_spans"], r["base_sha256"], r["spans"]) for r in pii.personal_data(table).collect()} == {(0, empty, "")}


def test_neighbours_and_archives_of_empty_tables(spark, tmp_path):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(pages, str(tmp_path / "w")), str(tmp_path / "w")).count() == 0


def test_a_very_long_page_and_text(spark, tmp_path):
    """A page of 6 MB is read back whole; a text of 120,000 words keeps its windows and pieces."""
    pages = spark.createDataFrame([(1, "u", "<p>é</p>" * 700_000), (2, "u", "<p>é</p>" * 700_000)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.read_records(warc.write_archives(pages, str(tmp_path / "w")), str(tmp_path / "w")).collect()}
    assert got == {1: (6_300_000, None), 2: (6_300_000, 1)}
    long = " ".join(f"w{i % 90_000}" for i in range(120_000))
    two = docs(spark, " ".join(f"w{i}" for i in range(89_950, 90_000)), long)
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(two).collect()} == {1: 0, 2: 50}
    assert all(r["round_trip"] for r in pieces.sample_encodings(two).collect())


def test_sampled_encodings_of_odd_rows(spark):
    got = pieces.sample_encodings(odd(spark)).collect()
    assert all(r["round_trip"] for r in got) and sum(r["n_pieces"] == 0 for r in got) == 2
    assert pieces.sample_encodings(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("stage", [language.keep_identified, near_dup.drop_near_duplicates, pii.mask_personal_data, mixing.apply_mix])
def test_stages_keep_columns(spark, stage):
    for table in (odd(spark), odd(spark).limit(0)):
        assert stage(table).columns == table.columns
        stage(table).count()


# Words.


def test_spans_and_hashes():
    texts = ["a  bb\tc", "", "é ü", "bb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    start, end, first = W.word_spans(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end)] == [w for t in texts for w in split(t)]
    assert first.tolist() == [0, 3, 3, 5, 6]
    h = W.word_hashes(data, start, end)
    assert h[1] == h[5] and len(set(h.tolist())) == 5


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_hashes_tell_complements_apart():
    """Sequences and their complements, which collide under every polynomial modulo a power of two."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    start, end, _ = W.word_spans(data, np.array([0, len(data)]))
    for seed in (0, 1):
        h = W.word_hashes(data, start, end, seed)
        assert h[0] == h[2] != h[1]
        words = np.array([h[0], h[1]])[np.array([[c == "b" for c in s] for s in (one, two, one)], int).reshape(-1)]
        ends = np.array([0, 2048, 4096, 6144])
        runs, grams = W.run_hashes(words, ends[:-1], ends[1:], seed), W.gram_hashes(words, ends[:-1], 2048, seed)
        assert runs[0] == runs[2] != runs[1] and grams[0] == grams[2] != grams[1]


@pytest.mark.parametrize("width", [1, 3, 5, 50, 64])
def test_grams_go_by_their_words_alone(width):
    words = np.random.default_rng(width).integers(0, 3, 400).astype(np.uint64)
    at = np.arange(400 - width + 1)
    for seed in (0, 1):
        by: dict = {}
        for i, h in zip(at, W.gram_hashes(words, at, width, seed).tolist(), strict=True):
            by.setdefault(tuple(words[i : i + width].tolist()), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    assert len(W.gram_hashes(words[:2], np.zeros(0, int), 5)) == 0


def test_documents_of_colliding_words_are_not_alike(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    first, second = (" ".join(w if c == "a" else f"{w}x" for c in thue_morse(16)) for w in (one, two))
    table = docs(spark, first, second, " ".join([one] * 60), " ".join([two] * 60))
    assert all(r["kept"] for r in near_dup.near_duplicates(table).collect())
    assert sum(r["n_removed"] for r in substring.remove_repeats(table).collect()) == 0


# Near duplicates.


def test_mixed_lists_lose_no_link(spark):
    """Variants of one text, some too far from all others: components as by comparing every pair."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(60):
        own = list(base)
        for i in rng.choice(120, size=int(rng.integers(0, 9)), replace=False):
            own[i] = f"x{k}_{i}"
        texts.append(" ".join(own))
    sets = [{tuple(split(t)[i : i + 5]) for i in range(len(split(t)) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in product(range(len(sets)), repeat=2):
        if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, *texts)).collect()}
    assert got == {i + 1: find(i) + 1 for i in range(len(texts))}


def test_rows_that_repeat_an_id_lose_no_link(spark):
    """Rows of one doc_id with other texts are documents of their own; one row of each component's document is left."""
    b, c = (" ".join(f"{x}{i}" for i in range(99)) for x in "bc")
    frame = spark.createDataFrame([(1, f"{b} z"), (5, f"{b} y"), (5, f"{c} y"), (7, f"{c} z"), (7, f"{c} z"), (9, None), (None, f"{b} y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(frame).collect())
    assert got == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True)]
    left = sorted((r["doc_id"] or 0, (r["text"] or "-")[0]) for r in near_dup.drop_near_duplicates(frame).collect())
    assert left == [(0, "b"), (1, "b"), (5, "c"), (9, "-")]


def test_block_links_are_exact():
    rng = np.random.default_rng(7)
    grams = [np.unique(rng.choice(400, size=200, replace=False).astype(np.uint64)) for _ in range(20)]
    grams += [np.unique(np.append(g[5:], np.uint64(1000 + i))) for i, g in enumerate(grams)]
    ids, signs = np.arange(40), np.stack([near_dup.signature(W.mix(g))[: near_dup.COMPARED].view(np.int32) for g in grams])
    found = near_dup.block_links((ids, ids, signs, grams), (ids, ids, signs, grams))
    true = {(i, j) for i in range(40) for j in range(40) if i != j and near_dup.is_link(len(np.intersect1d(grams[i], grams[j])), len(grams[i]), len(grams[j]))}
    assert set(found) == true


def test_least_matches():
    assert near_dup.least_matches(16) <= near_dup.least_matches(144) < 0.75 * 144


# Substrings.


def test_windows_that_are_equal_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = [f"s{i}" for i in rng.integers(0, 30, 90)]
    texts = [" ".join([f"l{k}_{i}" for i in range(int(rng.integers(0, 60)))] + shared + [f"r{k}_{i}" for i in range(20)]) for k in range(8)] + ["la " * 200, "la lo " * 90]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    start, end, first = W.word_spans(data, offsets)
    h = W.word_hashes(data, start, end)
    at, anchors, has = substring.window_anchors(h, first)
    by: dict = {}
    for p, a, known in zip(at, anchors, has, strict=True):
        by.setdefault(tuple(h[p : p + 50].tolist()), set()).add((int(a), bool(known)))
    assert all(len(v) == 1 for v in by.values()) and len(by) < len(at)


def test_removed_text(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs(spark, f"a b {shared} c", f"x {shared}  y\nz", shared[:-4]), with_text=True).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 60, 59] and got[2]["kept_text"] == "x y z"
    assert got[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


# Mixing and shards.


def test_mix_bounds(spark):
    got = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg({"taken": "sum", "target": "max", "size": "max"})
    assert ((by.taken - by.target).abs() <= by["size"]).all()


def test_shards_are_even(spark):
    rng = np.random.default_rng(2)
    texts = ["hot copy of one text"] * 900 + ["w" * int(n) for n in rng.integers(1, 400, 2000)]
    # The copies outweigh one of 16 shards, so they are cut up; they don't outweigh one of 8, so they share one, and half of them is what a cut may be off by.
    for n, off in ((16, 0), (8, 900 * 36 / 2 / 4)):
        got = shards.kd_shards(docs(spark, *texts), n).toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert len(sums) == n and sums.max() - sums.min() < 0.02 * sums.mean() + 4 * 416 + 2 * off
        assert (got[got.doc_id <= 900].shard.nunique() == 1) == (n == 8)
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)


def test_cuts_and_groups_of_equal_texts(spark):
    """Sizes and sums as from plain Python; a group of equal texts shares a shard unless it outweighs one; most cuts lie along measures of the text."""
    import zlib

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shards.kd_shards(table).toPandas().merge(table.select("doc_id", "text").toPandas(), on="doc_id")
    raw = [(t or "").encode() for t in got.text]
    assert got["size"].tolist() == [len(r) + 16 for r in raw] and got.text_crc32.tolist() == [zlib.crc32(r) for r in raw]
    assert (got.groupby("text").shard.nunique() == 1).all() and set(got.shard) == set(range(40))
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    sums = got.groupby("shard")["size"].sum()
    assert (sums - sums.mean()).abs().max() <= got["size"].max() and sums.std() < 0.1 * sums.mean()


def test_rows_without_or_with_one_id_are_numbered(spark):
    frame = spark.createDataFrame([(None if i % 3 else 7, f"text {i % 50}") for i in range(3000)], "doc_id long, text string")
    got = shards.kd_shards(frame, 4).toPandas()
    assert len(got) == 3000 and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)


# WARC.


def test_archives(spark, tmp_path):
    body = "<p>" + "é" * 100
    table = spark.createDataFrame([(3, "http://a/ x\r\nX: y", body, 1), (1, None, body, 2), (2, "u", "tiny", 3), (4, "u", "tiny", 4), (5, "u", None, 5), (None, "u", body, 6), (3, "v", "other" * 50, 7)], "page_id bigint, url string, html string, offset int")
    index = warc.write_archives(table, str(tmp_path / "w"))
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]).decode()) for r in warc.read_records(index, str(tmp_path / "w")).collect())
    n = len(body.encode())
    assert got == [(-1, "response", None, n, body), (1, "response", None, n, body), (2, "response", None, 4, "tiny"), (3, "response", None, 250, "other" * 50), (3, "revisit", 1, n, ""), (4, "response", None, 4, "tiny"), (5, "response", None, 0, "")]
    assert warc.read_records(index.filter("page_id = 2"), str(tmp_path / "w")).count() == 1


# Language and quality.


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_texts_of_no_learned_language_are_rejected(spark):
    """Gibberish and a language that is not learned go, long or short; short clean texts stay; all this with two languages and with six."""
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("lang in ('en', 'de') and n_chars > 400").dropDuplicates(["text"]).toPandas()
    other = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'es' and n_chars > 400").toPandas().text.tolist()[:8]
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz   ")
    made = [("l1", "aeiou", "lmn"), ("l2", "aeiou", "ptk"), ("l3", "áéíóú", "rsz"), ("l4", "àèìòù", "bdg")]
    more = [(c, " ".join("".join(rng.choice(list(b)) + rng.choice(list(a)) for _ in range(int(rng.integers(1, 4)))) for _ in range(120))) for c, a, b in made for _ in range(30)]
    base = list(zip(table.lang, table.text, strict=True))
    bad = [(None, "".join(rng.choice(letters, n))) for n in (60, 300, 2000) for _ in range(4)] + [(None, t[:n]) for t in other for n in (150, 400)]
    bad += [(None, "for (int i = 0; i < n; ++i) { x[i] = f(y[i], &z); } if (!ptr) return NULL; #define QX 0x3f\n" * 4)]
    for learned in (base, base + more):
        clean = [(c, t[50:110]) for c, t in learned[:: max(1, len(learned) // 60)] if t.isprintable()]
        rows_ = [(c, t) for c, t in learned] + bad + clean
        frame = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(rows_)], "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in language.keep_identified(frame).collect()}
        n = len(learned)
        assert not kept & set(range(n, n + len(bad)))
        assert len(kept & set(range(n + len(bad), len(rows_)))) >= 0.95 * len(clean) and len(kept & set(range(n))) >= 0.95 * n


def test_kept_documents_have_the_language_that_was_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unnamed = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(unnamed).collect()}
    kept = language.keep_identified(unnamed).collect()
    assert len(kept) > 100 and all(r["lang"] == found[r["doc_id"]] for r in kept)


def test_sample_has_all_languages_and_distinct_texts(spark):
    """Copies do not displace the distinct texts of a language, and more than 64 languages are all learned."""
    copies = spark.range(40_000).select(F.concat(F.lit("text number "), F.col("id") % 20).alias("text"), F.lit("xx").alias("lang"))
    assert sorted(r["text"] for r in language.sample(copies).collect()) == sorted(f"text number {i}" for i in range(20))
    many = spark.range(900).select(F.concat(F.lit("text number "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 90).alias("lang"))
    got = language.sample(many).toPandas().groupby("lang").size()
    assert len(got) == 90 and (got == 10).all()


def test_all_distinct_rows_teach(spark):
    """Counts, model and thresholds against those of all rows at once, on more rows than landmarks are chosen among; copies teach once."""
    rng = np.random.default_rng(5)
    made = [(c, " ".join("".join(rng.choice(list(b), 3)) for _ in range(12))) for c, b in (("aa", "aeioulmn"), ("bb", "aeiouptk")) for _ in range(700)]
    rows_ = spark.createDataFrame([(t, c) for c, t in made + made[:1] * 50 + made[-30:]], "text string, lang string").repartition(5)
    model, learned, counts = language.learn(rows_)
    assert sorted((r["lang"], r["text"]) for r in learned.collect()) == sorted(set(made))
    raw = [t.encode() for _, t in sorted(set(made))]
    names = np.array([c for c, _ in sorted(set(made))], object)
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    row, place = language.letter_grams(data, offsets)
    want = np.stack([np.bincount(place[names[row] == c], minlength=language.DIMENSIONS) for c in ("aa", "bb")])
    assert (counts == want).all()
    x = language.unit(language.presence(data, offsets))
    chosen = sorted((r["lang"], r["text"]) for r in language.sample(rows_).collect())
    assert len(chosen) == 2 * language.ROWS_PER_LANGUAGE < len(names)
    bits = lambda t: np.packbits(language.presence(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])), axis=1)[0].tobytes()
    packed = sorted((c, bits(t)) for c, t in chosen)
    marks = language.unit(np.stack([np.unpackbits(np.frombuffer(packed[i][1], np.uint8)) for i in language.choose([c for c, _ in packed], ["aa", "bb"])]))
    k = (x @ marks.T).astype(float)
    own = np.stack([(names == c) / (names == c).sum() for c in ("aa", "bb")])
    whole = language.solve(marks, ["aa", "bb"], (k * own.mean(axis=0)[:, None]).T @ k, own @ k)
    assert np.abs(model.score(x) - whole.score(x)).max() < 1e-3
    evidence = language.gather_evidence(learned, counts, model.languages)
    for i, c in enumerate(("aa", "bb")):
        logs = [language._log_probabilities(want[i] - np.bincount(place[row == r], minlength=language.DIMENSIONS))[place[row == r]] for r in np.flatnonzero(names == c)]
        mean = np.array([x.mean() for x in logs])
        middle = np.median(mean)
        assert abs(evidence.least[i] - (middle - language.REACH * max(middle - np.quantile(mean, language.LOW), language.LEAST_DISTANCE))) < 0.01
        assert abs(evidence.deviation[i] - np.sqrt(np.mean([x.var() for x in logs]))) < 1e-3


def test_kernel_is_the_share_of_common_grams():
    """The product of two presence rows against sets of n-grams of orders 1 to 3, counted in Python."""
    texts = ["Das ist ein Satz.", "das war ein SATZ", "Ünïcode çà", ""]
    raw = [t.encode() for t in texts]
    x = language.unit(language.presence(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))))
    sets = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    want = [[len(a & b) / max(np.sqrt(len(a) * len(b)), 1) for b in sets] for a in sets]
    # Two n-grams may fall on one of the 8,192 places.
    assert np.abs(x @ x.T - want).max() < 0.05


def test_ties_between_languages_go_to_the_first(spark):
    frame = spark.createDataFrame([(i, "same text here", c) for i, c in enumerate(["bb", "aa"] * 20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(frame).collect()} == {"aa"}


def test_folded_weights_are_the_kernel_machine():
    rng = np.random.default_rng(3)
    x = language.unit(rng.random((60, language.DIMENSIONS)) < 0.02)
    model = language.fit(x, ["aa", "bb", "cc"] * 20)
    assert model.languages == ["aa", "bb", "cc"] and (model.score(x).argmax(axis=1) == np.tile([0, 1, 2], 20)).all()


def brute_quality(text):
    words = split(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n)


def test_counts(spark):
    texts = ["a b c a b c d", "é ü\n\né ü\nx $ <b>", None, "la " * 100, " ".join(f"w{i}" for i in range(80))]
    got = quality.quality(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got] == [brute_quality(t) for t in texts]
    assert [r["kept"] for r in got] == [False] * 4 + [True]


def brute_kneser_ney(texts, order=4):
    """Log-probabilities of all n-grams of the texts (UTF-16 units, lower case, three spaces before each) by the formulas, in exact order."""
    from collections import Counter
    from math import log

    grams = Counter()
    for t in texts:
        s = " " * (order - 1) + re.sub(r"\s+", " ", t.lower())
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    levels = [grams]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    below = {"": 1 / (len(levels[-1]) + 1)}
    for level in reversed(levels):
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[k] else 0.5, 0.0), k - 0.01) for k in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        below = {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * below[g[1:]] for g, c in level.items()}
    return {g: log(x) for g, x in below.items()}


def test_model_is_kneser_ney(spark):
    """Every probability of two languages against the formulas, and the texts' perplexities by broadcast arrays and by a join."""
    texts = [("=en", "the cat sat on the mat and the dog sat on the log " * 3), ("=en", "A dog\n\nand a cat ran to the log"), ("=ru", "кот сидел на столе и кот ел рыбу"), ("=ru", "пёс видел кота 🐈 на столе")]
    got = {(r["lang"], r["code"] & (2**64 - 1)): r["logp"] for r in quality.train(spark.createDataFrame(texts, "lang string, text string")).collect()}
    code = lambda g: int.from_bytes(b"".join(u.to_bytes(2, "big") for u in g), "big")
    want = {}
    for lang in ("=en", "=ru"):
        units = ["".join(map(chr, np.frombuffer(t.encode("utf-16-le"), np.uint16))) for c, t in texts if c == lang]
        want |= {(lang, code([ord(u) for u in g])): x for g, x in brute_kneser_ney(units).items()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    frame = spark.createDataFrame([(i, t, c[1:]) for i, (c, t) in enumerate(texts)], "doc_id long, text string, lang string")
    one, two = ({r["doc_id"]: r["log_perplexity"] for r in quality.quality(frame, bound).collect()} for bound in (1 << 20, 0))
    assert one == pytest.approx(two, abs=1e-6) and min(one.values()) > 0


def test_bands_reject_both_ways(spark):
    """Shuffled letters and texts of another language lie above a language's band, texts drawn from its squared n-gram chances lie below; plain documents stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('en', 'de') and n_chars between 400 and 4000").dropDuplicates(["text"])
    plain = [(r["lang"], r["text"]) for r in table.collect()]
    rng = np.random.default_rng(5)
    bad = [(c, "".join(rng.permutation(list(t)))) for c, t in plain[:5]] + [("de" if c == "en" else "en", t) for c, t in plain[5:10]]
    after = defaultdict(Counter)
    for c, t in plain:
        for k in range(3, len(t) if c == "en" else 0):
            after[t[k - 3 : k]][t[k]] += 1

    def drawn():
        s = "the"
        while len(s) < 1500:
            chance = np.array(list(after[s[-3:]].values())) ** 2.0
            s += rng.choice(list(after[s[-3:]]), p=chance / chance.sum())
        return s

    rows_ = plain + bad + [("en", drawn()) for _ in range(2)]
    frame = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(rows_)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality(frame).collect()}
    n = len(plain)
    assert not any(got[i]["kept"] for i in range(n, len(rows_)) if not got[i]["base_failed"])
    good = [i for i in range(n) if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in good) >= 0.95 * len(good)


def brute_halves(texts):
    """Mean log-probability of each text, from the formulas over the n-grams (four units) of the distinct texts of the other half."""
    from collections import Counter
    from math import log

    spaced = {t: "   " + re.sub(r"\s+", " ", t.lower()) for t, _ in texts}
    losses = []
    for text, half in texts:
        levels = [Counter(g for t in {t for t, h in texts if h != half} for g in (spaced[t][i : i + 4] for i in range(len(spaced[t]) - 3)))]
        for _ in range(3):
            levels.append(Counter(g[1:] for g in levels[-1]))
        tables = []
        for level in levels:
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[k] else 0.5, 0.0), k - 0.01) for k in (1, 2, 3)]
            total, left = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3) - 1]
            tables.append((level, d, total, left))

        def p(g):
            if not g:
                return 1 / (len(levels[-1]) + 1)
            level, d, total, left = tables[4 - len(g)]  # noqa: B023
            if not total[g[:-1]]:
                return p(g[1:])
            own = (level[g] - d[min(level[g], 3) - 1]) / total[g[:-1]] if level[g] else 0.0
            return own + left[g[:-1]] / total[g[:-1]] * p(g[1:])

        grams = [spaced[text][i : i + 4] for i in range(len(spaced[text]) - 3)]
        losses.append(-sum(log(p(g)) for g in grams) / len(grams))
    return losses


def made_texts(rng, letters, n, size=120):
    words = ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words, size)) for _ in range(n)]


def test_halves_score_each_other(spark):
    """Perplexities of both ways to keep the model against the formulas; a copy teaches once and gets its text's number."""
    texts = made_texts(np.random.default_rng(7), "aeiostrn", 8, 60)
    frame = docs(spark, *texts, texts[0], texts[0])
    halves = {r["text"]: r["h"] for r in frame.selectExpr("text", "xxhash64('half', text) & 1 AS h").collect()}
    assert set(halves.values()) == {0, 1}
    want = brute_halves([(t, halves[t]) for t in texts])
    found = [{r["doc_id"]: (r["log_perplexity"], r["kept"]) for r in quality.quality(frame, bound).collect()} for bound in (1 << 20, 0)]
    assert found[0] == found[1]
    assert [found[0][i + 1][0] for i in range(8)] == pytest.approx(want, abs=1e-6) and found[0][9] == found[0][10] == found[0][1]


def test_junk_does_not_teach_that_it_is_language(spark):
    """Two junk texts in five of a language's are rejected, also where one of them comes a hundred times; the other texts stay."""
    rng = np.random.default_rng(8)
    plain = made_texts(rng, "aeiouaeiourstlnmd", 60)
    noise = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(2, 9))) for _ in range(120)) for _ in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs(spark, *plain, *noise, *noise[:1] * 100)).collect()}
    assert sum(got[i + 1] for i in range(60)) >= 57 and not any(got[i + 1] for i in range(60, 200))


# Personal data.


def test_base_patterns_are_the_regular_expressions():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1.2@-_ +.@9")) for _ in range(30))
        assert pii.emails(text) == [m.span() for m in email.finditer(text)]
        assert pii.ips(text) == [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]


def test_spans_and_masks(spark):
    text = "mail a.b@mail.com or +1 (988) 555-2485, host 10.0.0.1, card 4012 8888 8888 1881, not 4012 8888 8888 1882"
    (found,) = pii.personal_data(docs(spark, text)).collect()
    assert [found[f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and found["spans"].startswith("email:5:17,ip:45:53,card:") and found["n_spans"] == 4
    assert pii.mask_personal_data(docs(spark, text)).first()["text"].startswith("mail [EMAIL] or [PHONE], host [IP], card [CARD]")


def luhn(digits):
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def test_base_counts_and_hash_are_the_regular_expressions(spark):
    """Counts, base_sha256 and the base spans of whole documents against re."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    rng = np.random.default_rng(12)
    made = ["".join(rng.choice(list("0123456789 -+().a"), 60)) for _ in range(100)] + ["card 4012 8888 8888 1881, +49 (30) 555-0123", None]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in pii.personal_data(table).collect():
        text, spans = texts[r["doc_id"]], []
        for kind, (pattern, test) in kinds.items():
            own = [m.span() for m in re.finditer(pattern, text) if test(m[0])]
            assert r[f"n_{kind}"] == len(own)
            spans += [f"{kind}:{a}:{b}" for a, b in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        found = [x for x in r["spans"].split(",") if x]
        assert set(spans) <= set(found) and r["n_spans"] == len(found)


@cache
def fitted():
    return pii.fit(pii_lines.lines())


def field_found(model, texts):
    data, offsets = pii.as_chunk(texts)
    return [[s for s in own if pii.CHECKS[s[0]].fullmatch(t[s[1] : s[2]])] for t, own in zip(texts, pii.field_spans(model, data, offsets), strict=True)]


def test_field_on_lines_of_wordings_it_has_not_seen():
    """Precision and recall of whole spans on other values of learned wordings, and on wordings left out of learning."""
    rates = {}
    for name, learned, tested in (("values", pii_lines.TEMPLATES, pii_lines.TEMPLATES), ("wordings", pii_lines.TEMPLATES[::2], pii_lines.TEMPLATES[1::2])):
        model, parsed = pii.fit(pii_lines.lines(learned)), [pii.parse_line(x) for x in pii_lines.lines(tested, seed=77)]
        found = field_found(model, [t for t, _ in parsed])
        hits = sum(len(set(f) & set(spans)) for f, (_, spans) in zip(found, parsed, strict=True))
        rates[name] = (hits / sum(map(len, found)), hits / sum(len(s) for _, s in parsed))
    assert min(rates["values"]) > 0.8 and rates["wordings"][0] > 0.6 and rates["wordings"][1] > 0.35, rates


def test_field_finds_what_the_patterns_miss():
    model = fitted()
    lines = ["my SSN is 219-09-9999 ok", "IBAN DE89370400440532013000 now", "the API key = abcdef1234567890abcdef12", "my e-mail is bob at example dot org", "tel 0171-2345678", "use sk-abcDEF1234567890abcdef1234567890", "The quick brown fox jumps over the lazy dog. It was late."]
    found = [[(k, t[a:b]) for k, a, b in own] for t, own in zip(lines, field_found(model, lines), strict=True)]
    assert found == [[("id", "219-09-9999")], [("iban", "DE89370400440532013000")], [("secret", "abcdef1234567890abcdef12")], [("email", "bob at example dot org")], [("phone", "0171-2345678")], [("secret", "sk-abcDEF1234567890abcdef1234567890")], []]


def test_added_spans_overlap_no_base_span():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = {k: [(int(a), int(a) + int(n)) for a, n in zip(rng.integers(0, 60, 3), rng.integers(1, 9, 3))] for k in pii.KINDS[: int(rng.integers(0, 4))]}
        more = [("id", int(a), int(a) + int(n)) for a, n in zip(rng.integers(0, 70, 5), rng.integers(1, 9, 5))]
        assert pii.added(base, more) == [s for s in more if not any(a < s[2] and s[1] < b for spans in base.values() for a, b in spans)]


def test_bounds_change_no_path(monkeypatch):
    """Spans by bounds and short chains are those of Viterbi over whole texts, also under weights that like long spans."""
    model, rng = pii.fit(pii_lines.lines(pii_lines.TEMPLATES[::4], each=2)), np.random.default_rng(4)
    texts = [*pii_lines.lines(each=1, seed=5), "", " \n ", " ".join(pii_lines.lines(each=1, seed=6))]
    data, offsets = pii.as_chunk(texts)
    emit, step, some = model.emit.copy(), model.step.copy(), []
    for noise in (0.0, 0.3, 1.0, 3.0):
        model.emit, model.step = emit + noise * rng.standard_normal(emit.shape), step + noise * rng.standard_normal(step.shape)
        found = pii.field_spans(model, data, offsets)
        with monkeypatch.context() as m:
            m.setattr(pii, "possible", lambda model, scores, kind, row: np.ones(len(kind), bool))
            assert found == pii.field_spans(model, data, offsets)
        some.append(sum(map(len, found)))
    assert min(some) > 50


def test_a_worker_needs_little_memory_for_tokens_of_many_kinds():
    """All weights of 100,000 different tokens at once were 19 x 17 numbers of 8 bytes for each, 258 MB."""
    model = pii.fit(["call [phone 5550 1234] now", "the cat sat"])
    data, offsets = pii.as_chunk([" ".join(f"{'aB1-'[i % 4] * (i % 9 + 1)}{i}" for i in range(100_000)), "call 5550 1234 now"])
    found = pii.tokens(data, offsets)
    found.own[:, 3:] = np.random.default_rng(0).integers(1, 1 << 40, size=(len(found.own), 3), dtype=np.uint64)
    tracemalloc.start()
    scores, kind = model.scores(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) > 99_000 and peak < 120e6
    own, near = model.fold(found.own), [pii._around(found.first, k) for k in pii.AROUND]
    some = np.append(np.arange(0, len(own), 997), np.arange(len(own) - 4, len(own)))
    whole = model.emit[model.number(pii._features(own[some], [np.where(at[some][:, None] >= 0, own[at[some]], np.uint64(0)) for at in near]))].sum(axis=1)
    free = ~(pii._NEEDS_DIGIT & (own[some, 3] == 0)[:, None])
    assert (scores[kind[some]][free] == whole[free]).all()


def test_accounts_have_the_length_of_one():
    """A row of words with digits is no account number, however the field likes it."""
    assert pii.CHECKS["iban"].fullmatch("DE89 3704 0044 0532 0130 00") and pii.CHECKS["iban"].fullmatch("NO9386011117947")
    assert not pii.CHECKS["iban"].fullmatch(" ".join(f"w{i}" for i in range(30_000))) and not pii.CHECKS["iban"].fullmatch("DE89 3704 0044 05")


def test_long_names_and_plain_texts():
    """Spans have no greatest length, and long texts, or one word over and over, have no spans."""
    model = fitted()
    name = "my name is Karolina " + "Bergstrom" * 12
    plain = pii_lines.lines(["{prose120}", "{prose400}", "{repeat300}", "{Repeat80}", "{rows200}"], each=8, seed=123)
    found = field_found(model, [name, *plain])
    assert [(k, name[a:b]) for k, a, b in found[0]] == [("name", name[11:])] and sum(map(len, found[1:])) == 0


def test_viterbi_is_the_best_path():
    field, rng = pii.Field(), np.random.default_rng(9)
    field.step = rng.standard_normal(field.step.shape)
    scores = rng.standard_normal((5, 3, len(pii.LABELS)))
    t = field.transitions()
    for s, path in zip(scores, field.decode(scores), strict=True):
        value = lambda p: t[0, p[0]] + s[0, p[0]] + sum(t[p[k - 1], p[k]] + s[k, p[k]] for k in (1, 2)) + t[p[2], 0]
        assert value(path) == pytest.approx(max(value(p) for p in product(range(len(pii.LABELS)), repeat=3)))


# Neighbours.


def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((1500, 16)) + rng.integers(0, 5, (1500, 1))
    table = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    table += [(2000, table[100][1], 0), (2001, table[100][1], 0), (2100, None, 0), (2200, [0.0] * 16, 0), (2300, [float("nan")] * 16, 0), (None, table[0][1], 0), (2400, [1.0, 2.0], 0)]
    got = neighbours.nearest(spark.createDataFrame(table, "vec_id bigint, embedding array<float>, rank int")).toPandas()
    full = np.vstack([np.float32(vectors).astype(float), np.float32(vectors[[100, 100]]).astype(float)])
    ids = np.append(np.arange(1500), [2000, 2001])
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hits += len(set(got[got.query_id == ids[q]].vec_id) & set(ids[order]))
    assert hits >= 0.97 * 160
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist()[:2] == [2000, 2001] and set(got.query_id) <= set(ids)


def test_copies_of_a_query_alone_in_its_pack(spark):
    """More copies than neighbours: the k-th distance is 0, and projections of equal vectors may differ by rounding."""
    rng = np.random.default_rng(5)
    one, others = rng.standard_normal(128), rng.standard_normal((30, 128))
    table = [(100, one)] + [(112 - i, one) for i in range(12)][:-1] + [(113, one)] + [(201 + i, v) for i, v in enumerate(others)]
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in table], "vec_id bigint, embedding array<double>")).toPandas().sort_values("rank")
    assert got.query_id.tolist() == [100] * 10 and got.vec_id.tolist() == list(range(102, 112)) and (got.score == 0).all()
    ids, vectors = np.arange(400), np.tile(one, (400, 1))
    points = vectors @ neighbours.directions(128)
    points += rng.standard_normal(points.shape) * 1e-14
    found, _ = neighbours.search_block(one, points[0], -1, 0.0, ids, vectors, points, neighbours.quantile(neighbours.SURE))
    assert found.tolist() == list(range(10))


def test_chi_square():
    assert neighbours.chi_square(np.array(neighbours.quantile(0.9)), 8) == pytest.approx(0.9) and neighbours.quantile(0.95) == pytest.approx(15.507, abs=1e-3)


# Pieces.


def test_samples_follow_the_lattice():
    """First samples by their probabilities, second ones by what is left, and all distinct."""
    n = 20_000
    found = pieces.sample_texts(["ab c"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), k=2)
    first: dict = {}
    for a, b in found:
        assert tuple(a[0]) != tuple(b[0])
        key = tuple(a[0])
        first.setdefault(key, [0, a[1]])[0] += 1
    for count, logp in first.values():
        p = np.exp(logp)
        assert abs(count / n - p) < 4 * np.sqrt(p / n) + 1e-3
    text = "x▁y \n\t é 漢 z  two"
    vocab = pieces.vocabulary(pieces.MODEL)
    some = pieces.sample_texts([text, "a", ""], np.arange(3, dtype=np.uint64), k=4)
    assert all(pieces.decode_pieces(s[0].tolist(), vocab) == text for s in some[0]) and len(some[0]) == 4
    assert len(some[1]) == 2 and sum(np.exp(s[1]) for s in some[1]) == pytest.approx(1) and all(s[2] == 1 for s in some[1]) and len(some[2]) == 1


def test_stored_ids_decode(spark):
    rows_ = pieces.decode_encodings(pieces.sample_encodings(docs(spark, "one  two", "drei\nvier")))
    assert {r["decoded"] for r in rows_.collect()} == {"one  two", "drei\nvier"}


def test_query_returns_ids_of_more_samples_than_one_branch_gives(spark):
    got = pieces.decode_encodings(QUERIES["op2_sentencepiece"](spark, SF)).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got.doc_id) == set(texts) and all(texts[i] == t for i, t in zip(got.doc_id, got.decoded, strict=True))
    assert all(hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest() == h for x, h in zip(got.ids, got.ids_sha256, strict=True))
    assert got["sample"].max() >= 3 and not got.duplicated(["doc_id", "ids_sha256"]).any()


def test_second_samples_and_inclusion_scores():
    """Pairs of samples of a small lattice by the law of draws without replacement; a segmentation's inclusion score divided into its indicator has mean 1."""
    n = 30_000
    found = pieces.sample_texts(["ab c"] * n, np.arange(n, dtype=np.uint64) * np.uint64(104_729), k=2)
    chance = {tuple(s[0]): np.exp(s[1]) for own in found for s in own}
    pairs: dict = {}
    weights: dict = {}
    for own in found:
        pair = tuple(tuple(s[0]) for s in own)
        pairs[pair] = pairs.get(pair, 0) + 1
        for s in own:
            weights[tuple(s[0])] = weights.get(tuple(s[0]), 0) + 1 / s[2]
    for (a, b), count in pairs.items():
        p = chance[a] * chance[b] / (1 - chance[a])
        assert abs(count / n - p) < 5 * np.sqrt(p / n) + 1e-3
    for key, p in chance.items():
        if p > 0.02:
            assert weights[key] / n == pytest.approx(1, abs=0.1)


# The pipeline.


def test_pipeline(spark):
    import corpus_pipeline as P

    table = spark.read.parquet(f"{SF}/documents.parquet")
    seen = table
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == table.columns, name
        seen = spark.createDataFrame(out.collect(), table.schema)
    kept = {r["doc_id"] for r in near_dup.near_duplicates(table).filter("kept").collect()}
    assert {r["doc_id"] for r in seen.select("doc_id").collect()} <= kept
    got = P.run(spark, SF)
    assert got.filter("not round_trip").count() == 0 and got.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()


def test_sampling_takes_little_memory():
    """A worker that samples 4 MB of words that hardly repeat grows by less than 170 MB (model and libraries not counted)."""
    code = """
import resource, numpy as np, pyarrow as pa
from cuewright.llm import pieces
pieces.vocabulary(pieces.MODEL)
draw, letters = np.random.default_rng(5), np.array(list("etaoinshrdlu"))
texts = ["".join(np.where(draw.random(3000) < 0.15, " ", letters[draw.integers(12, size=3000)])) for _ in range(1400)]
batch = pa.record_batch({"doc_id": pa.array(range(1400), pa.int64()), "text": texts, "row_key": pa.array(range(1400), pa.int64())})
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
assert sum(b.num_rows for b in pieces._encode(pieces.MODEL, 4, True)(iter([batch]))) == 5600
print(peak() - before)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout)
    assert grown < 170
