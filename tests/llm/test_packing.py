"""Packing: pieces against the tokenizer itself, plans against bounds and every packing of small tables."""

import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuewright.llm import packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, length string, part string, number int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute_pieces(tokenizer, doc_id, text, most=1024):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    first = len(ids) % most or most
    ends = [0, *range(first, len(ids) + 1, most)]
    return [(doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def laid_out(rows, most=1024):
    """Checks that sequences have no gap and no overlap, and gives their fills."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return held


def test_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(p for d in docs.collect() for p in brute_pieces(tokenizer, d["doc_id"], d["text"]))
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert least <= len(laid_out(rows)) <= least + 2
    assert sorted(map(tuple, packing.pack(docs.repartition(3)).collect())) == sorted(map(tuple, rows))


def test_odd_rows(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "<|endoftext|> a"), (None, "same"), (None, "same"), (4, "word " * 60_000), (5, "x" * 30_000), (6, "é\u0085　 漢字 '\u0019ll\t\n ")] + [(7, "copy of a text")] * 40
    table = spark.createDataFrame([(*t, "x", "y", 1) for t in texts], SCHEMA)
    rows = packing.pack(table).collect()
    key = lambda p: (p[0] is not None, *(v or 0 for v in p))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted((p for t in texts for p in brute_pieces(tokenizer, *t)), key=key)
    laid_out(rows)
    assert packing.pack(table.limit(0)).count() == 0


def test_both_libraries_give_one_encoding(tokenizer):
    encode = packing.encoder()
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 500):
        text = "\n|".join(f"a{c}b {c}{c}1 {c}c{c} 'll{c}" for c in points[at : at + 500])
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plans_use_each_piece_once_and_no_more_sequences_than_best_fit():
    rng = np.random.default_rng(11)
    for counts in (np.bincount(rng.integers(1, 65, 5000), minlength=65), np.bincount(rng.integers(30, 50, 900), minlength=65), np.bincount([40] * 77 + [64] * 3 + [1], minlength=65), np.zeros(65, int)):
        made = packing.plan(counts, 64)
        used = Counter()
        for held, n in made:
            assert sum(held) <= 64
            for length in held:
                used[length] += n
        assert dict(used) == {i: int(n) for i, n in enumerate(counts) if n}
        best = sum(n for _, n in packing.best_fit(counts, 64))
        assert sum(n for _, n in made) <= best * 1.01 + 1


def least_sequences(lengths, most):
    """By trying every sequence for every piece."""
    best = len(lengths)
    for where in product(range(len(lengths)), repeat=len(lengths)):
        fills = Counter()
        for at, length in zip(where, lengths, strict=True):
            fills[at] += length
        if max(fills.values(), default=0) <= most:
            best = min(best, len(fills))
    return best


def test_small_tables_take_the_fewest_sequences():
    rng = np.random.default_rng(7)
    off = 0
    for _ in range(25):
        lengths = rng.integers(1, 17, 6)
        off += sum(n for _, n in packing.plan(np.bincount(lengths, minlength=17), 16)) - least_sequences(list(lengths), 16)
    assert off <= 1


def test_fit_is_the_least_squares_solution():
    """At the solution no pattern that is left out would help, and those that are in neither help nor harm."""
    counts = np.bincount(np.random.default_rng(5).integers(1, 33, 400), minlength=33).astype(float)
    counts[0] = 0
    ways = packing.patterns(np.flatnonzero(counts), 32)
    packing_good, packing.GOOD = packing.GOOD, 0.0
    try:
        rows, repeats = packing.fit(counts, ways)
    finally:
        packing.GOOD = packing_good
    columns = np.array([np.bincount(w, minlength=33) for w in ways], float)
    columns[:, 0] = 0
    gain = columns @ (counts - repeats @ columns[rows])
    assert repeats.min() > 0 and gain.max() < 1e-4 * counts.sum() and np.abs(gain[rows]).max() < 1e-4 * counts.sum()


def test_numbers_are_gapless_within_a_length(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("long").alias("length"), (F.col("id") % 5).alias("ids_crc32"))
    got = packing.numbered(pieces, 5000).groupBy("length").agg(F.min("number").alias("a"), F.max("number").alias("b"), F.count_distinct("number").alias("n"), F.count("*").alias("c")).collect()
    assert all((r["a"], r["b"], r["n"]) == (0, r["c"] - 1, r["c"]) for r in got)
