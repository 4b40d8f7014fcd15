"""Sharding by a k-d tree: nodes are split at distributed weighted medians of their widest metadata dimension.

A node that is to fill n shards is cut where the bytes below reach n // 2 of n parts. The cut is found by a histogram of
bytes over the node's range that is refined in the bucket holding the cut, for all nodes of a level at once; the driver
holds a few hundred sums a node. The dimensions are measures of the text (its bytes, the lengths of its words and lines, the share of characters
beyond ASCII), and the text's crc32 parts what is equal in a measure, so equal texts stay together: a group of them goes to the nearer side of a
cut as a whole, but for one that outweighs a shard, which is cut by a hash of doc_id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import checkpointed, in_batches

SHARDS = 40
ROW_BYTES = 16
#: A bucket that holds less than this part of a shard's bytes is cut at its nearer edge.
TOLERANCE = 0.002
BUCKETS = 512
#: Values of the hash of doc_id, and of the one that tells rows of a doc_id apart.
TIES, AGAIN = 1 << 40, 1 << 12
DIMENSIONS = ["by_size", "by_word", "by_line", "by_script"]
#: Parts of a doubling that a measure is told apart by; within them rows go by their text's crc32.
PARTS_OF_DOUBLING = 1 << 14
#: Rows of one shard are numbered in so many parts, and in more where a part would hold over PART_ROWS.
PARTS, PART_ROWS = 64, 100_000


@dataclass
class Node:
    """The shards first to first + n - 1, with the cut that divides them once it is known."""

    first: int
    n: int
    dimension: str = ""
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None


def leaves(root: Node, columns: dict[str, np.ndarray]) -> np.ndarray:
    """The leaf that each row falls into, by its first shard."""
    out = np.zeros(len(columns["tie"]), np.int32)
    todo = [(root, np.arange(len(out)))]
    while todo:
        node, rows = todo.pop()
        if node.left is None or node.right is None:
            out[rows] = node.first
            continue
        d = columns[node.dimension][rows]
        low = (d < node.value) | ((d == node.value) & (columns["tie"][rows] < node.tie))
        todo += [(node.left, rows[low]), (node.right, rows[~low])]
    return out


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy() for c in ("size", "tie", *DIMENSIONS)}


def _sums(rows: DataFrame, root: Node, keyed) -> dict[int, dict[int, int]]:
    """Bytes by leaf and key. keyed(columns, leaf, rows of that leaf) gives the rows' keys, fewer than BUCKETS, or None."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            columns = _columns(batch)
            leaf = leaves(root, columns)
            for k in np.unique(leaf).tolist():
                of = np.flatnonzero(leaf == k)
                if (keys := keyed({c: v[of] for c, v in columns.items()}, k)) is not None:
                    inside = (keys >= 0) & (keys < BUCKETS)
                    np.add.at(sums[k], keys[inside], columns["size"][of][inside])
        flat = [(k, int(b), int(v[b])) for k, v in sums.items() for b in np.flatnonzero(v)]
        for part in [flat] if flat else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["leaf", "key", "bytes"])

    out: dict[int, dict[int, int]] = defaultdict(dict)
    found = rows.transform(in_batches, local, "leaf long, key long, bytes long").groupBy("leaf", "key").agg(F.sum("bytes"))
    for leaf, key, total in found.collect():
        out[leaf][key] = total
    return out


def _cut(rows: DataFrame, root: Node, value: dict[int, str], span: dict[int, tuple[int, int]], need: dict[int, float], slack: float, only: dict[int, tuple[str, int]]):
    """For each leaf: (first and last value of the bucket that holds the cut, bytes below it, its bytes).

    `only` restricts a leaf to the rows of one value of a column.
    """
    below, out, open_ = dict.fromkeys(span, 0), {}, dict(span)
    while open_:
        step = {k: (hi - lo) // BUCKETS + 1 for k, (lo, hi) in open_.items()}

        def keyed(columns, k, open_=dict(open_), step=step):  # noqa: B006
            if k not in open_:
                return None
            v = columns[value[k]]
            keys = np.where((v < open_[k][0]) | (v > open_[k][1]), -1, (v - open_[k][0]) // step[k])
            return np.where(columns[only[k][0]] == only[k][1], keys, -1) if k in only else keys

        sums = _sums(rows, root, keyed)
        for k in list(open_):
            lo, hi = open_.pop(k)
            for b, s in sorted(sums[k].items()):
                if below[k] + s > need[k]:
                    first, last = lo + b * step[k], min(hi, lo + (b + 1) * step[k] - 1)
                    if step[k] == 1 or s <= slack:
                        out[k] = (first, last, below[k], s)
                    else:
                        open_[k] = (first, last)
                    break
                below[k] += s
            else:
                out[k] = (hi, hi, below[k], 0)
    return out


def _ends(rows: DataFrame, root: Node) -> dict[int, dict]:
    """Bytes, and least and largest value of each dimension, by leaf."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _columns(batch)
            leaf = leaves(root, columns)
            found = [(k, *_measure(columns, np.flatnonzero(leaf == k))) for k in np.unique(leaf).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    names = ["leaf", "bytes", *[f"{d}_{end}" for d in DIMENSIONS for end in ("min", "max")]]
    found = rows.transform(in_batches, local, ", ".join(f"{n} long" for n in names)).groupBy("leaf")
    ends = [(F.min if n.endswith("min") else F.max)(n).alias(n) for n in names[2:]]
    return {r["leaf"]: r.asDict() for r in found.agg(F.sum("bytes").alias("bytes"), *ends).collect()}


def _measure(columns: dict[str, np.ndarray], of: np.ndarray) -> list[int]:
    return [int(columns["size"][of].sum()), *[int(f(columns[d][of])) for d in DIMENSIONS for f in (np.min, np.max)]]


def _place(root: Node):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = pa.array(leaves(root, _columns(batch)), pa.int32())
            names = ["doc_id", "size", "text_crc32", "tie"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], shard], [*names, "shard"])

    return place


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Size: UTF-8 bytes of the text and ROW_BYTES; a null text counts as empty, and its text_crc32 is 0. Law: `bytes`, the
    shards' sums of size come near one another; grown_shard is null. Repeated rows each get a slot. Equal texts share a shard, unless they outweigh one together. An empty table has no rows. Other columns are
    ignored.
    """
    text_of = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of.alias("text"))
    text_of = F.col("text")
    rows = rows.withColumns({"size": (F.octet_length(text_of) + ROW_BYTES).cast("long"), "text_crc32": F.crc32(text_of.cast("binary"))})
    words, lines = F.length(text_of) - F.length(F.translate(text_of, " ", "")) + 1, F.length(text_of) - F.length(F.translate(text_of, "\n", "")) + 1
    beyond = F.octet_length(text_of) - F.char_length(text_of)
    measures = [F.col("size"), F.col("size") / words, F.col("size") / lines, 1000 * beyond / F.col("size")]
    dims = [(F.floor(F.log2(1 + m) * PARTS_OF_DOUBLING) * (1 << 32) + F.col("text_crc32")).cast("long").alias(d) for d, m in zip(DIMENSIONS, measures, strict=True)]
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(TIES // AGAIN)) * AGAIN + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(AGAIN))
    rows = checkpointed(rows.select("doc_id", "size", "text_crc32", *dims, tie.alias("tie")))
    root, total, count = Node(0, shards), *rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    width: dict[str, int] = {}
    level = [root] if shards > 1 and count else []
    while level:
        seen = _ends(rows, root)
        nodes = {n.first: n for n in level if n.first in seen}
        span, need, dims = {}, {}, {}
        for k, node in nodes.items():
            of = {d: (seen[k][f"{d}_min"], seen[k][f"{d}_max"]) for d in DIMENSIONS}
            width = width or {d: hi - lo + 1 for d, (lo, hi) in of.items()}
            dims[k] = max(DIMENSIONS, key=lambda d: (of[d][1] - of[d][0]) / width[d])
            span[k], need[k] = of[dims[k]], seen[k]["bytes"] * (node.n // 2) / node.n
        slack = TOLERANCE * total / shards
        found = _cut(rows, root, dims, span, need, slack, {})
        heavy = {k: (dims[k], f[0]) for k, f in found.items() if f[0] == f[1] and f[3] > total / shards}
        rest = {k: need[k] - found[k][2] for k in heavy}
        ties = _cut(rows, root, dict.fromkeys(heavy, "tie"), dict.fromkeys(heavy, (0, TIES - 1)), rest, slack, heavy)
        level = []
        for k, node in nodes.items():
            first, last, low, inside = found[k]
            node.dimension, node.value = dims[k], first
            if k in ties:
                t_first, t_last, t_low, t_inside = ties[k]
                node.tie = t_first if rest[k] - t_low <= t_inside / 2 else t_last + 1
            elif need[k] - low > inside / 2:
                node.value = last + 1
        for node in nodes.values():
            half = node.n // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.n - half)
            level += [x for x in (node.left, node.right) if x.n > 1]
    parts = max(PARTS, count // (shards * PART_ROWS) + 1)
    placed = rows.transform(in_batches, _place(root), "doc_id long, size long, text_crc32 long, tie long, shard int")
    # Rows that are equal in all are told apart by where they are stored.
    placed = placed.withColumn("part", F.pmod(F.xxhash64("tie", "text_crc32", F.spark_partition_id()), F.lit(parts)))
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("within", within).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
