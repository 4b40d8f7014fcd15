"""Nearest neighbours by stable projections and a k-d tree.

Vectors are projected to PROJECTED dimensions with Gaussian (2-stable) directions, in which the squared length of a
projected difference over the squared true distance has a chi-square distribution. A k-d tree, fitted on a bounded sample
of projections, deals all vectors out to cells; Spark packs a cell's vectors into blocks. A query searches its own cell
first, which bounds its k-th distance, and then each cell whose box comes near enough. In a block a query takes
the vectors in the order of their projected distance and verifies them on the originals, until a vector within the k-th
distance so far would lie at the next projected distance or beyond with a chance of 1 - SURE at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import checkpointed, in_batches

NEAREST, EVERY = 10, 100
PROJECTED = 8
SURE = 0.995
#: The tree is fitted on at most so many vectors of each dimension, chosen by a hash, and has so many cells at most.
SAMPLE, CELLS, CELL_ROWS = 20_000, 2048, 4096
#: Projections of equal vectors may differ by rounding, as products of other shapes sum in another order: by less than this part of their length.
ROUNDING = 1e-10
BLOCK_ROWS, QUERY_ROWS, VERIFIED_AT_ONCE = 1024, 256, 128


def chi_square(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, m: int = PROJECTED) -> float:
    low, high = 0.0, 50.0 * m
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), m) < p else (low, mid)
    return high


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(3000 + dimension).standard_normal((dimension, PROJECTED))


class Tree:
    """Cuts of a k-d tree, as arrays: node i has children 2 i + 1 and 2 i + 2; cells are the last level."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, np.int64)
        self.cut = np.full((1 << depth) - 1, np.inf)
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            if node >= len(self.axis) or not len(own):
                continue
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            self.axis[node], self.cut[node] = axis, np.median(own[:, axis])
            low = own[:, axis] <= self.cut[node]
            todo += [(2 * node + 1, own[low]), (2 * node + 2, own[~low])]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dimension)


def _split(batch: pa.RecordBatch):
    """The rows of a batch by dimension: (dimension, row numbers)."""
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, rows in _split(batch):
            points = _vectors(batch.column("embedding").take(pa.array(rows)), d) @ directions(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d)), pa.array(list(points), pa.list_(pa.float64()))], ["dimension", "point"])


def _assign(trees: dict[int, Tree]):
    """Adds the cell, and the block in it, that a vector goes to."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _split(batch):
                part = batch.take(pa.array(rows))
                points = _vectors(part.column("embedding"), d) @ directions(d)
                cell = trees[d].cell(points)
                ends = [pa.array(list(points), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(np.full(len(rows), d)), pa.array(cell), *ends], ["vec_id", "embedding", "dimension", "cell", "point"])

    return assign


def search_block(query: np.ndarray, query_point: np.ndarray, own: int, bound: float, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, limit: float, k: int = NEAREST):
    """(ids, distances) of at most k vectors of a block, nearest first. bound: the k-th distance known so far."""
    gap = ((points - query_point) ** 2).sum(axis=1)
    order = np.lexsort((ids, gap))
    order = order[ids[order] != own]
    best = np.zeros(0, np.int64)
    near = np.zeros(0)
    root, slack = np.sqrt(limit), ROUNDING * np.sqrt((query_point**2).sum())
    for i in range(0, len(order), VERIFIED_AT_ONCE):
        delta = np.sqrt(gap[order[i]]) - slack
        if delta > root * bound or (len(best) == k and delta > root * near[-1]):
            break
        some = order[i : i + VERIFIED_AT_ONCE]
        best = np.append(best, some)
        near = np.append(near, np.sqrt(((vectors[some] - query) ** 2).sum(axis=1)))
        rank = np.lexsort((ids[best], near))[:k]
        best, near = best[rank], near[rank]
    # Sums of one dimension after another, as in any other engine.
    square = np.zeros(len(best))
    for j in range(vectors.shape[1]):
        square += (vectors[best, j] - query[j]) ** 2
    exact = np.sqrt(square)
    rank = np.lexsort((ids[best], exact))
    return ids[best][rank], exact[rank]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a packed block of queries and a packed block of vectors."""
    limit = quantile(SURE)
    for batch in batches:
        for i in range(batch.num_rows):
            d = batch.column("dimension")[i].as_py()
            held, asked = batch.column("held")[i].values, batch.column("asked")[i].values
            ids, vectors = held.field("vec_id").to_numpy(), _vectors(held.field("embedding"), d)
            points = vectors @ directions(d)
            q_ids, q_vectors = asked.field("vec_id").to_numpy(), _vectors(asked.field("embedding"), d)
            bounds, q_points = asked.field("bound").to_numpy(), q_vectors @ directions(d)
            found = [search_block(v, p, q, b, ids, vectors, points, limit) for q, v, p, b in zip(q_ids, q_vectors, q_points, bounds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, [len(a) for a, _ in found])), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([b for _, b in found]))],
                ["query_id", "vec_id", "score"],
            )


def _visits(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A row for each cell that may hold a vector within the bound of a query."""
    limit = quantile(SURE)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("point").to_pylist()
            bounds, kinds = batch.column("bound").to_numpy(), batch.column("dimension").to_pylist()
            rows, cells = [], []
            for i, (p, d) in enumerate(zip(points, kinds, strict=True)):
                cell, low, high = boxes[d]
                gap = np.maximum(np.maximum(low - p, np.array(p) - high), 0)
                slack = ROUNDING * np.sqrt((np.array(p) ** 2).sum())
                near = cell[np.sqrt((gap**2).sum(axis=1)) <= np.sqrt(limit) * bounds[i] + slack]
                rows.append(np.full(len(near), i))
                cells.append(near)
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            columns = [batch.column(c).take(take) for c in ("vec_id", "embedding", "dimension", "bound")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64))], ["vec_id", "embedding", "dimension", "bound", "cell"])

    return visits


def _met(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """The k nearest of each query in each block of the cells that it visits."""
    part = F.pmod(F.xxhash64("vec_id"), F.col("query_parts"))
    sizes = asked.groupBy("dimension", "cell").agg((F.floor(F.count("*") / QUERY_ROWS) + 1).alias("query_parts"))
    packs = asked.join(sizes, ["dimension", "cell"]).groupBy("dimension", "cell", part.alias("query_part"))
    packs = packs.agg(F.collect_list(F.struct("vec_id", "embedding", "bound")).alias("asked"))
    pairs = packs.join(blocks, ["dimension", "cell"]).select("dimension", "asked", "held")
    return pairs.transform(in_batches, _search, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", place).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of each whose vec_id is divisible by `every`.

    Vectors that are null or zero, or that hold a null or a non-finite component, take no part, nor do rows without a
    vec_id. Vectors are compared with those of their own dimension. Ties go to the smaller vec_id; a repeated vec_id is one
    candidate, at the least of its distances. Other columns are ignored.
    """
    good = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)

    counts = {d: n for d, n in rows.groupBy(F.size("embedding")).count().collect()}
    trees = {}
    for d, n in counts.items():
        share = min(1.0, 0.8 * SAMPLE / n)
        place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
        chosen = rows.filter((F.size("embedding") == d) & (place < int(share * (1 << 30)) + 1)).orderBy(place, "vec_id").limit(SAMPLE)
        # The tree is one of a set of points, so their order does not matter; which ones they are goes by the hash alone.
        sample = [r["point"] for r in chosen.transform(in_batches, _project, "dimension long, point array<double>").collect()]
        depth = max(0, int(np.ceil(np.log2(max(1, min(n / CELL_ROWS, CELLS, len(sample) / 4))))))
        trees[d] = Tree(np.array(sample).reshape(-1, PROJECTED), depth)

    schema = "vec_id long, embedding array<double>, dimension long, cell long, point array<double>"
    placed = checkpointed(rows.transform(in_batches, _assign(trees), schema))
    ends = [f(F.col("point")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(PROJECTED)]
    boxes = {}
    cells = placed.groupBy("dimension", "cell").agg(F.count("*").alias("n"), *ends).collect()
    for d in counts:
        own = [r for r in cells if r["dimension"] == d]
        low, high = (np.array([[r[f"{e}{j}"] for j in range(PROJECTED)] for r in own]).reshape(-1, PROJECTED) for e in ("min", "max"))
        boxes[d] = (np.array([r["cell"] for r in own], np.int64), low, high)
    parts = placed.groupBy("dimension", "cell").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).alias("parts"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))
    blocks = placed.join(parts, ["dimension", "cell"]).groupBy("dimension", "cell", block.alias("part"))
    blocks = checkpointed(blocks.agg(F.collect_list(F.struct("vec_id", "embedding")).alias("held")))

    asked = placed.filter(F.col("vec_id") % every == 0)
    home = checkpointed(_ranked(_met(asked.select("vec_id", "embedding", "dimension", "cell", F.lit(float("inf")).alias("bound")), blocks), k))
    bound = home.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    known = asked.join(bound, "vec_id", "left").fillna(float("inf"), ["bound"])
    visits = known.select("vec_id", "embedding", "dimension", "bound", "point").transform(in_batches, _visits(boxes), "vec_id long, embedding array<double>, dimension long, bound double, cell long")
    return _ranked(_met(visits, blocks).unionByName(home.drop("rank")), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
