"""Packing documents into sequences by patterns of lengths.

Documents are encoded, closed with an end id, and those longer than a sequence are cut. What is packed is the histogram of
the pieces' lengths, which has no more bins than a sequence has places however many documents there are: patterns of few
lengths that fill a sequence exactly are enumerated, a non-negative least-squares fit tells how often each is repeated, and
what rounding leaves is packed best-fit. The plan is then laid over the pieces, which are numbered within their length.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import checkpointed, in_batches

SEQUENCE, END = 1024, 2
#: Names of the vocabulary and of the same one as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Documents of a pattern, at most.
FEW = 3
#: Columns that join the fit at a time, rounds of it, and the part of all pieces that a fit may leave to best fit without going on.
AT_ONCE, ROUNDS, GOOD = 64, 60, 0.005


def encoder(path: Callable[[str], str] = public_tokenizers.path) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Another implementation of the same merges, over three times as fast, gives them (tests/llm compare both on every code point); texts with a
    special token's string go to the tokenizer itself."""
    own = Tokenizer.from_file(path(VOCABULARY))
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    with open(path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def cuts(size: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of that many ids: all of the full length but the first."""
    first = size - (size - 1) // most * most
    return [(0, first)] + [(at, most) for at in range(first, size, most)]


def _pieces(most: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), end).astype("<u4")
                for number, (at, length) in enumerate(cuts(len(ids), most)):
                    rows.append(i)
                    numbers.append(number)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[at : at + length].tobytes()))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(lengths: np.ndarray, most: int = SEQUENCE) -> np.ndarray:
    """All ways to fill a sequence with one to FEW of the lengths, each way once: a row of lengths, the longest first, then zeros."""
    held = np.zeros(most + 1, bool)
    held[lengths] = True
    rows = [np.array([[most, 0, 0]])] if held[most] else []
    low = np.arange(1, most // 2 + 1)
    low = low[held[low] & held[most - low]]
    rows.append(np.stack([most - low, low, np.zeros_like(low)], axis=1))
    for least in np.flatnonzero(held[: most // 3 + 1]):
        middle = np.arange(least, (most - least) // 2 + 1)
        middle = middle[held[middle] & held[most - least - middle]]
        rows.append(np.stack([most - least - middle, middle, np.full_like(middle, least)], axis=1))
    return np.concatenate(rows)


def fit(goal: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of `ways`, repeats of each) with repeats > 0 that least-squares fit goal, the count of each length.

    An active set in which columns of different lengths join together: those whose repeats would help most; repeats that would be negative
    go to zero on the way to the solution, as their columns leave."""
    total = goal.sum()
    want = goal / max(total, 1)
    want[0] = 0
    taken, x = np.zeros(0, np.int64), np.zeros(0)

    def columns(which: np.ndarray) -> np.ndarray:
        made = np.zeros((len(want), len(which)))
        for place in range(FEW):
            np.add.at(made, (ways[which, place], np.arange(len(which))), 1.0)
        made[0] = 0
        return made

    held, rest = columns(taken), want.copy()
    gram = np.zeros((0, 0))
    for _ in range(ROUNDS):
        if np.abs(rest).sum() <= GOOD:
            break
        gain = rest[ways].sum(axis=1)
        gain[taken] = 0
        used, joins = np.zeros(len(want), bool), []
        for j in np.argsort(-gain, kind="stable")[: AT_ONCE * 32]:
            own = ways[j][ways[j] > 0]
            if gain[j] <= 1e-12 or len(joins) == AT_ONCE:
                break
            if not used[own].any():
                used[own] = True
                joins.append(j)
        if not joins:
            break
        taken, x = np.append(taken, joins), np.append(x, np.zeros(len(joins)))
        new = columns(np.array(joins))
        cross = held.T @ new
        gram = np.block([[gram, cross], [cross.T, new.T @ new + 1e-10 * np.eye(len(joins))]])
        held = np.concatenate([held, new], axis=1)
        while len(taken):
            z = np.linalg.solve(gram, held.T @ want)
            if z.min() > 0:
                x = z
                break
            down = z <= 0
            step = np.min(np.where(down, x / np.maximum(x - z, 1e-300), 1.0))
            x = x + step * (z - x)
            stays = ~(down & (x <= 1e-15))
            taken, x, held, gram = taken[stays], x[stays], held[:, stays], gram[np.ix_(stays, stays)]
        rest = want - held @ x
    return taken, x * total


def best_fit(counts: np.ndarray, most: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths: (lengths in a sequence, how many such sequences)."""
    pools: dict[int, list[list]] = defaultdict(list)
    for length in np.flatnonzero(counts)[::-1]:
        length, left = int(length), int(counts[length])
        for free in range(length, most):
            pool, stay = pools[free], []
            each = free // length
            while pool and left:
                held, n = pool.pop()
                full = min(n, left // each)
                if full:
                    pools[free - each * length].append([held + (length,) * each, full])
                    left -= full * each
                if full < n and 0 < left < each:
                    pools[free - left * length].append([held + (length,) * left, 1])
                    left, full = 0, full + 1
                if full < n:
                    stay.append([held, n - full])
            pool.extend(stay)
            if not left:
                break
        each = most // length
        if left // each:
            pools[most - each * length].append([(length,) * each, left // each])
        if left % each:
            pools[most - left % each * length].append([(length,) * (left % each), 1])
    return [(held, n) for free in sorted(pools) for held, n in pools[free]]


def plan(counts: np.ndarray, most: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences), which use each length as often as it is counted."""
    left = counts.astype(np.int64).copy()
    ways = patterns(np.flatnonzero(left), most)
    made = []
    for j, repeats in sorted(zip(*fit(left.astype(float), ways), strict=True), key=lambda p: (-p[1], p[0])):
        own, each = np.unique(ways[j][ways[j] > 0], return_counts=True)
        n = int(min(np.floor(repeats + 1e-6), (left[own] // each).min()))
        if n > 0:
            left[own] -= n * each
            made.append((tuple(int(v) for v in ways[j] if v), n))
    return made + best_fit(left, most)


def _slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each run of pieces of one length that one place of a pattern takes: its first piece as a key of length and number, the first
    sequence and the place; by key."""
    used: dict[int, int] = defaultdict(int)
    keys, sequences, places, first = [], [], [], 0
    for held, n in made:
        place = 0
        for length in held:
            keys.append((length << 48) + used[length])
            sequences.append(first)
            places.append(place)
            used[length] += n
            place += length
        first += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(a, np.int64)[order] for a in (keys, sequences, places))


def _placed(slots: tuple[np.ndarray, ...], names: list[str]):
    keys, sequences, places = slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("length").to_numpy() << 48) + batch.column("number").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            made = [pa.array(sequences[at] + key - keys[at]), pa.array(places[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "sequence_id", "offset"])

    return run


def numbered(pieces: DataFrame, total: int) -> DataFrame:
    """Pieces with their number, from 0, among those of their length. A length may have any share of the pieces, so its pieces are numbered in
    parts, about as many as the parts have pieces, each from where the one before ends."""
    parts = max(1, int(total**0.5))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    rows = pieces.withColumn("part", part)
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("place", place).join(firsts, ["length", "part"]).withColumn("number", F.col("first") + F.col("place")).drop("part", "place", "first")


def pack(documents: DataFrame, most: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document.

    A null text counts as empty, so it is the end id alone. Rows that repeat a doc_id, or whose doc_id is null, are documents of their own
    (pieces that are equal in all columns may swap places). Texts of any length are encoded whole. No rows give no rows; other columns are
    ignored. Sequences are numbered from 0; a rerun gives the same ones.
    """
    key = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long"
    pieces = checkpointed(documents.select("doc_id", "text").transform(in_batches, _pieces(most, end), schema))
    counts = np.zeros(most + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    rows = numbered(pieces, int(counts.sum()))
    slots = _slots(plan(counts, most))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return rows.transform(in_batches, _placed(slots, names), f"{schema}, sequence_id long, offset long")
