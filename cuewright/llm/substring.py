"""Substring deduplication by recompression.

Each document's words become symbols that shrink round by round: pairs of a left-hand and a right-hand symbol get a
common name, then runs of one symbol get a name with their length. A name is a hash of what it stands for and a
symbol's side is a bit of its hash, so names are global: equal word sequences get equal symbols, except for a few at
their ends, in every task and without a table of names. With each symbol goes the range of words that its existence
depends on. A window of words that holds such a range whole holds that symbol wherever else the window occurs.

Of the symbols whose ranges a window holds, the one of the least hash, over the words of its range, is its anchor. Spark gathers the anchors and
finds those that several documents share; a window whose anchor one document has alone can't repeat elsewhere. Only
windows with shared anchors (and windows that hold no whole range) are verified, by 128 bits of hashes of all their words. Of documents
with one word sequence only the first takes part: all windows of the others repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import BROADCAST_ROWS, checkpointed, in_batches, small

WINDOW = 50
ROUNDS = 4
KEY = ["doc_id", "text_key"]
ANCHORS = "symbol long, doc_id long, text_key long, first int, last int"


def _pairs(sym, dep_from, dep_to, doc, edges):
    """One round over pairs: (symbols, ranges, document of each symbol)."""
    right = (sym >> np.uint64(17)) & np.uint64(1) == 1
    joins = np.zeros(len(sym), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    second = np.zeros(len(sym), bool)
    second[1:] = joins[:-1]
    before, after = _neighbours(dep_from, dep_to, doc, edges)
    # A symbol stays single because of its neighbour on one side; a pair depends on nothing else.
    start = np.where(right, before, dep_from)
    stop = np.where(right, dep_to, after)
    at = np.flatnonzero(joins)
    start[at], stop[at] = dep_from[at], dep_to[at + 1]
    name = sym.copy()
    name[at] = W.mix(sym[at] * np.uint64(0xC2B2AE3D27D4EB4F) + sym[at + 1])
    keep = ~second
    return name[keep], start[keep], stop[keep], doc[keep]


def _runs(sym, dep_from, dep_to, doc, edges):
    """One round over runs: a run is named by its symbol and length, and ends where its neighbours differ."""
    opens = np.ones(len(sym), bool)
    opens[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    before, after = _neighbours(dep_from, dep_to, doc, edges)
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(sym)) - 1
    length = last - at + 1
    name = np.where(length > 1, W.mix(sym[at] + length.astype(np.uint64) * np.uint64(0x165667B19E3779F9)), sym[at])
    return name, before[at], after[last], doc[at]


def _neighbours(dep_from, dep_to, doc, edges):
    """Where the left neighbour's range begins and the right neighbour's ends; beyond the document at its ends."""
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    last = np.append(first[1:], True)
    before = np.where(first, edges[doc] - 1, np.append(dep_from[:1], dep_from[:-1]))
    after = np.where(last, edges[doc + 1] + 1, np.append(dep_to[1:], dep_to[-1:]))
    return before, after


def window_anchors(hashes: np.ndarray, first_word: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS):
    """(window starts, their anchors, whether they have one)."""
    starts = W.gram_starts(first_word, width)
    n = len(hashes)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    sym, lo, hi = hashes, np.arange(n), np.arange(1, n + 1)
    for _ in range(rounds):
        sym, lo, hi, doc = _pairs(sym, lo, hi, doc, first_word)
        sym, lo, hi, doc = _runs(sym, lo, hi, doc, first_word)
    # Both ends of the ranges ascend, so the symbols that a window holds are neighbours: j to k - 1.
    j = np.searchsorted(lo, starts)
    k = np.searchsorted(hi, starts + width, "right")
    size = k - j
    has = size > 0
    # A symbol goes by all the words that it depends on; those that depend on an end of a document are in no window.
    whole = (lo >= first_word[doc]) & (hi <= first_word[doc + 1])
    names = np.where(whole, W.span_hashes(hashes, np.where(whole, lo, 0), np.where(whole, hi, 0), 5) ^ W.mix(sym), sym)
    least = [names]
    for step in (1 << i for i in range(int(max(size.max(), 1)).bit_length() - 1)):
        row = least[-1].copy()
        np.minimum(row[:-step], least[-1][step:], out=row[:-step])
        least.append(row)
    least = np.stack(least)
    level = np.where(has, np.frexp(np.maximum(size, 1).astype(float))[1] - 1, 0)
    top = len(names) - 1
    anchors = np.minimum(least[level, np.minimum(j, top)], least[level, np.clip(k - (1 << level), 0, top)])
    return starts, np.where(has, anchors, np.uint64(0)), has


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of consecutive windows of a document with one anchor; symbol is null where there is none."""
    for batch in batches:
        for row, _, data, offsets in W.chunked(batch):
            start, end, first_word = W.word_spans(data, offsets)
            starts, anchors, has = window_anchors(W.word_hashes(data, start, end), first_word)
            if not len(starts):
                continue
            doc = np.repeat(np.arange(len(first_word) - 1), np.maximum(np.diff(first_word) - WINDOW + 1, 0))
            opens = np.ones(len(starts), bool)
            opens[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1]) | (has[1:] != has[:-1])
            at = np.flatnonzero(opens)
            last = np.append(at[1:], len(starts)) - 1
            rows, base = pa.array(doc[at] + row), first_word[doc[at]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors[at].view(np.int64), mask=~has[at]),
                    batch.column("doc_id").take(rows),
                    batch.column("text_key").take(rows),
                    pa.array((starts[at] - base).astype(np.int32)),
                    pa.array((starts[last] - base).astype(np.int32)),
                ],
                ["symbol", *KEY, "first", "last"],
            )


def _ragged(ranges: pa.ListArray, base: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lasts of the ranges of rows first to last - 1, moved by the rows' bases."""
    part = ranges.slice(first, last - first)
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = part.flatten()
    move = np.repeat(base, counts)
    return flat.field("first").to_numpy() + move, flat.field("last").to_numpy() + move


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, ends included."""
    size = last - first + 1
    return np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end_row, data, offsets in W.chunked(batch):
            start, end, first_word = W.word_spans(data, offsets)
            at = spread(*_ragged(batch.column("ranges"), first_word[:-1], row, end_row))
            pair = [W.as_long(W.gram_hashes(W.word_hashes(data, start, end, seed), at, WINDOW, seed)) for seed in (0, 1)]
            doc = np.searchsorted(first_word, at, "right") - 1
            rows = pa.array(doc + row)
            yield pa.RecordBatch.from_arrays(
                [
                    *pair,
                    batch.column("doc_id").take(rows),
                    batch.column("text_key").take(rows),
                    pa.array((at - first_word[doc]).astype(np.int32)),
                ],
                ["window", "window_b", *KEY, "at"],
            )


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end_row, data, offsets in W.chunked(batch):
            start, end, first_word = W.word_spans(data, offsets)
            n = len(start)
            first, last = _ragged(batch.column("ranges"), first_word[:-1], row, end_row)
            covered = np.zeros(n + 1, np.int64)
            np.add.at(covered, first, 1)
            np.add.at(covered, last + WINDOW, -1)
            kept = np.cumsum(covered)[:n] == 0
            words = np.diff(first_word)
            left = np.append(0, np.cumsum(kept))[first_word]
            numbers = np.flatnonzero(kept)
            ends_row = np.zeros(len(numbers), bool)
            ends_row[left[1:][np.diff(left) > 0] - 1] = True
            mask = np.zeros(len(data) + 2, np.int8)
            mask[start[numbers]] += 1
            np.add.at(mask, end[numbers] + ~ends_row, -1)
            mask = np.cumsum(mask, dtype=np.int8)[: len(data)].astype(bool)
            out = np.where(W._IS_SEPARATOR[data], 32, data).astype(np.uint8)[mask]
            cut = np.append(0, np.cumsum(mask))[offsets]
            pieces = [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            columns = [
                batch.column("doc_id").slice(row, end_row - row),
                pa.array(words.astype(np.int64)),
                pa.array((words - np.diff(left)).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in pieces]),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x.decode() for x in pieces]))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of the word sequence, and the number of words, of each document with a window."""
    for batch in batches:
        for row, _, data, offsets in W.chunked(batch):
            start, end, first_word = W.word_spans(data, offsets)
            words = np.diff(first_word)
            rows = np.flatnonzero(words >= WINDOW)
            pair = [W.as_long(W.run_hashes(W.word_hashes(data, start, end, seed), first_word[:-1], first_word[1:], seed)[rows]) for seed in (0, 1)]
            keys = [batch.column(k).take(pa.array(rows + row)) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, *pair, pa.array(words[rows].astype(np.int32))], [*KEY, "seq_a", "seq_b", "n"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of each row in order, those that touch as one."""
    for batch in batches:
        column = batch.column("ranges")
        row = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
        first, last = (column.flatten().field(c).to_numpy() for c in ("first", "last"))
        order = np.lexsort((first, row))
        row, first, last = row[order], first[order].astype(np.int64), last[order].astype(np.int64)
        # Ranges of a document do not lie within one another, so each ends behind the one before.
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
        at = np.flatnonzero(opens)
        ends = last[np.append(at[1:], len(row)) - 1]
        values = pa.StructArray.from_arrays([pa.array(first[at], pa.int32()), pa.array(ends, pa.int32())], ["first", "last"])
        cuts = np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in KEY], pa.ListArray.from_arrays(cuts, values)], [*KEY, "ranges"])


RANGES = "doc_id long, text_key long, ranges array<struct<first:int,last:int>>"


def _by_document(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """The ranges of each document. One document's ranges are as many as its words at most."""
    found = rows.groupBy(*KEY).agg(F.collect_list(F.struct(first.alias("first"), last.alias("last"))).alias("ranges"))
    return checkpointed(found.transform(in_batches, _merge, RANGES))


def _held(ranges: DataFrame) -> DataFrame:
    """A hint to broadcast the ranges if they are few."""
    held = ranges.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
    return F.broadcast(ranges) if held <= BROADCAST_ROWS else ranges


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of docs (doc_id, text).

    A word goes if a window of 50 words that covers it also starts in a document of a smaller doc_id. Kept words are
    joined by one space. Null or empty text: no words, and the hash of nothing. A row with a null doc_id is neither
    changed nor a source. Rows that repeat a doc_id are each handled, and don't count against one another. Other
    columns are ignored.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # A second key tells rows of one doc_id apart; it is 0 where that is not needed, which costs the shuffles nothing.
    again = small(texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select(F.col("doc_id").alias("again_id")))
    texts = texts.join(again, texts.doc_id == again.again_id, "left")
    texts = texts.select("doc_id", "text", F.when(F.col("again_id").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("text_key"))
    known = texts.filter("doc_id is not null")

    sequences = known.transform(in_batches, _sequences, "doc_id long, text_key long, seq_a long, seq_b long, n int")
    first = sequences.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    # Stored, so that the many copies of one text can be split at run time.
    copies = sequences.join(checkpointed(first), ["seq_a", "seq_b"]).filter("doc_id > least").select(*KEY, "n").distinct()
    copies = small(copies)
    single = known.join(copies.select(*KEY), KEY, "left_anti")

    anchors = single.transform(in_batches, _anchors, ANCHORS)
    shared = anchors.filter("symbol is not null").groupBy("symbol").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    # What many rows are joined with is stored first, so that the rows of one symbol or window can be split at run time.
    shared = checkpointed(shared.filter("a < b").select("symbol"))
    flagged = anchors.join(shared, "symbol", "left_semi").union(anchors.filter("symbol is null"))
    ranges = _by_document(flagged, F.col("first"), F.col("last"))

    windows = single.join(_held(ranges), KEY).transform(in_batches, _windows, "window long, window_b long, doc_id long, text_key long, at int")
    least = windows.groupBy("window", "window_b").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    repeats = windows.join(checkpointed(least.select("window", "window_b", "a")), ["window", "window_b"]).filter("doc_id > a")
    removed = _by_document(repeats, F.col("at"), F.col("at"))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - WINDOW).alias("last")))
    removed = removed.union(copies.select(*KEY, whole.alias("ranges")))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(_held(removed), KEY, "left").transform(in_batches, lambda batches: _apply(batches, with_text), schema)
