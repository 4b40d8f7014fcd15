"""Hard negatives by blocks along a Hilbert curve.

Vectors are scaled to whole numbers and written as Parquet blocks: a block holds vectors of one label that follow each
other along a Hilbert curve, and a zone map, the least and greatest value of each of its dimensions. From a zone map interval
arithmetic bounds the inner product of an anchor with any vector of the block, so zone maps alone tell which blocks an anchor
must read: those that may beat its fifth positive of its own block, and then those that may hold a score of one of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import checkpointed, in_batches, new_folder

POSITIVES, NEGATIVES, EVERY = 5, 5, 100
#: A negative scores at least LEAST of MOST parts of the positive's score, and at most the positive's.
LEAST, MOST = 80, 100
SCALE = 256
BLOCK_ROWS, ANCHORS, ZONES = 1024, 256, 256
#: Dimensions that the curve goes through, and bits of each.
CURVE, BITS = 64, 2
#: Lengths of vectors for which the curve's cells are fitted; they shape the blocks only.
LENGTHS = 64
#: Anchors whose thresholds a task carries from block to block.
CARRIED = 50_000
#: Sums below are exact in double precision.
EXACT = float(1 << 53)
#: Components are cut off here, and LEAST_SCORE is below any score, but above that of a row which is no candidate.
LARGEST, LEAST_SCORE = 1e100, -1e300
#: Scores beyond are returned as this.
FARTHEST = 9.2e18
BLOCK = "block long, label long, dimension int, n int, kind string, ids binary, vectors binary, low array<double>, high array<double>"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along a Hilbert curve of rows of cells (numbers of that many bits, a column for each dimension), as rows of bytes that sort alike.

    The coordinates are turned into the curve's transposed index by undoing its reflections and exchanges from the highest bit down."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q = 1 << bit
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= turn
    rows = [((x >> bit) & 1).T for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(rows, axis=1).astype(np.uint8), axis=1)


def whole_numbers(column: pa.Array, dimension: int) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length, within LARGEST."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(SCALE * np.clip(values, -LARGEST, LARGEST)).reshape(len(column), dimension)


def _stored(values: np.ndarray) -> tuple[str, bytes]:
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, values.astype(kind).tobytes()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), batch.take(pa.array(np.flatnonzero(sizes == d)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and sums of squares of each dimension of a batch's vectors, one row for each length."""
    for batch in batches:
        for d, part in _by_length(batch):
            x = whole_numbers(part.column("embedding"), d)
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0)]), pa.array([(x * x).sum(axis=0)])], ["dimension", "n", "sums", "squares"])


def _cells(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of the curve's dimensions of the most frequent lengths, from sums over all rows."""
    sums = rows.transform(in_batches, _sums, "dimension int, n long, sums array<double>, squares array<double>")
    each = sums.select("dimension", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("at", "of")).filter(F.col("at") < CURVE)
    each = each.groupBy("dimension", "at").agg(F.sum("n").alias("n"), F.sum("of.sums").alias("s"), F.sum("of.squares").alias("q"))
    kept = each.groupBy("dimension").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("sums")).orderBy(F.desc("n"), "dimension").limit(LENGTHS)
    out = {}
    for r in kept.collect():
        mean, square = (np.array([x[k] for x in r["sums"]]) / r["n"] for k in ("s", "q"))
        out[r["dimension"]] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def _placed(cells: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds the place along the curve: cells are the four quarters of a normal distribution of each dimension."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_length(batch):
                x = whole_numbers(part.column("embedding"), d)[:, :CURVE]
                mean, spread = cells.get(d, (np.zeros(x.shape[1]), np.ones(x.shape[1])))
                key = hilbert((x > mean - 0.6745 * spread).astype(int) + (x > mean) + (x > mean + 0.6745 * spread)) if d else np.zeros((len(x), 1), np.uint8)
                columns = [*(part.column(c) for c in ("vec_id", "label", "embedding")), pa.array(np.full(len(x), d, np.int32)), pa.array([k.tobytes() for k in key], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "embedding", "dimension", "place"])

    return place


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows, each of one label and length. Within a block ids rise, so that a stable sort by score breaks ties."""
    part, made = TaskContext.get().partitionId() << 32, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def block() -> pa.RecordBatch:
        nonlocal made
        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(ids, kind="stable")
        kind, data = _stored(x[order])
        made += 1
        values = [part + made, *now, len(ids), kind, ids[order].astype("<i8").tobytes(), data, x.min(axis=0).tolist(), x.max(axis=0).tolist()]
        return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema)

    schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dimension", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    names = schema.names
    for batch in batches:
        keys = np.stack([batch.column("label").to_numpy(), batch.column("dimension").to_numpy()], axis=1)
        ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
        first = 0
        for end in ends if len(keys) else []:
            own = tuple(int(v) for v in keys[first])
            while first < end:
                if held and (own != now or sum(len(h[0]) for h in held) == BLOCK_ROWS):
                    yield block()
                    held = []
                now = own
                last = min(end, first + BLOCK_ROWS - sum(len(h[0]) for h in held))
                some = batch.slice(first, last - first)
                held.append((some.column("vec_id").to_numpy(), whole_numbers(some.column("embedding"), own[1])))
                first = last
    if held:
        yield block()


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; Python's own numbers take over where double precision does not hold them."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


def _vectors(kind: str, data: bytes, n: int, dimension: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64).reshape(n, dimension)


def first_in(scores: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, window, column) of the first k columns, by falling score and then place, of each row's windows low <= score <= high.

    scores: rows by columns; low and high: rows by windows."""
    order = np.argsort(-scores, axis=1, kind="stable")
    ranked = np.take_along_axis(scores, order, axis=1)
    begin = (ranked[:, None, :] > high[:, :, None]).sum(axis=2)
    at = begin[:, :, None] + np.arange(k)
    inside = at < scores.shape[1]
    found = np.take_along_axis(ranked[:, None, :].repeat(low.shape[1], axis=1), np.where(inside, at, 0), axis=2)
    row, window, place = np.nonzero(inside & (found >= low[:, :, None]))
    return row, window, order[row, at[row, window, place]]


_ANCHOR = "anchor_id long, label long, dimension int, block long, vector binary, positives array<struct<vec_id:long,score:double>>"


def _home(every: int, k: int):
    """Anchors with the best of their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                mine = np.flatnonzero(ids % every == 0)
                if not len(mine):
                    continue
                x = _vectors(r["kind"], r["vectors"], r["n"], r["dimension"])
                for some in np.array_split(mine, -(-len(mine) // ANCHORS)):
                    scores = _products(x[some], x).astype(float)
                    scores[ids[some][:, None] == ids] = -np.inf
                    ends = np.full((len(some), 1), -LEAST_SCORE)
                    row, _, column = first_in(scores, -ends, ends, k)
                    for i, at in enumerate(some):
                        best = column[row == i]
                        positives = [{"vec_id": int(ids[c]), "score": float(scores[i, c])} for c in best]
                        out.append({"anchor_id": int(ids[at]), "label": r["label"], "dimension": r["dimension"], "block": r["block"], "vector": x[at].tobytes(), "positives": positives})
            yield pa.RecordBatch.from_pylist(out, _ANCHOR_ROWS)

    return run


_POSITIVES = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
_ANCHOR_ROWS = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()), ("dimension", pa.int32()), ("block", pa.int64()), ("vector", pa.binary()), ("positives", _POSITIVES)])
_VISIT = pa.schema([("block", pa.int64()), ("anchors", pa.binary()), ("points", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])


def _choose(same: bool):
    """For each zone map of a pack and each pack of anchors, the anchors with a window that the block may meet: in blocks of their own label but the
    home block (same), or of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                anchors, zones = r["anchors"], r["zones"]
                points = np.stack([np.frombuffer(a["vector"], np.float64) for a in anchors])
                low, high = (np.array([a[c] for a in anchors], float).reshape(len(anchors), -1) for c in ("low", "high"))
                least, most = (np.array([z[c] for z in zones], float).reshape(len(zones), -1) for c in ("low", "high"))
                up, down = np.maximum(points, 0), np.minimum(points, 0)
                slack = 1e-9 * (np.abs(points) @ np.maximum(np.abs(least), np.abs(most)).T)
                top, bottom = up @ most.T + down @ least.T + slack, up @ least.T + down @ most.T - slack
                meets = ((top[:, :, None] >= low[:, None, :]) & (bottom[:, :, None] <= high[:, None, :])).any(axis=2)
                alike = np.array([a["label"] for a in anchors])[:, None] == np.array([z["label"] for z in zones])
                home = np.array([a["block"] for a in anchors])[:, None] == np.array([z["block"] for z in zones])
                meets &= alike & ~home if same else ~alike
                ids = np.array([a["anchor_id"] for a in anchors], np.int64)
                out = []
                for j, z in enumerate(zones):
                    some = np.flatnonzero(meets[:, j])
                    if len(some):
                        packed = [a[some].tobytes() for a in (ids, points, low, high)]
                        out.append(dict(zip(_VISIT.names, [z["block"], *packed], strict=True)))
                yield pa.RecordBatch.from_pylist(out, _VISIT)

    return run


def _search(k: int):
    """The first k of each window of the anchors that read a block. A window that a block has filled asks no later block of the task for less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x, ids = _vectors(r["kind"], r["vectors"], r["n"], r["dimension"]), np.frombuffer(r["ids"], "<i8")
                asked = np.frombuffer(r["anchors"], np.int64)
                points, low, high = (np.frombuffer(r[c], np.float64).reshape(len(asked), -1) for c in ("points", "least", "most"))
                low = np.maximum(low, np.stack([known.get(int(a), own) for a, own in zip(asked, low, strict=True)]))
                scores = _products(points, x).astype(float)
                scores[asked[:, None] == ids] = -np.inf
                row, window, column = first_in(scores, low, high, k)
                found = scores[row, column]
                filled = np.bincount(row * low.shape[1] + window, minlength=low.size).reshape(low.shape) == k
                last = np.full(low.shape, np.inf)
                np.minimum.at(last, (row, window), found)
                low = np.where(filled, np.maximum(low, last), low)
                if len(known) > CARRIED:
                    known.clear()
                known.update((int(asked[i]), low[i]) for i in np.flatnonzero(filled.any(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(window.astype(np.int32)), pa.array(ids[column]), pa.array(found)], ["anchor_id", "window", "vec_id", "score"])

    return run


def _read(blocks: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, window, vec_id, score (double): the first k of each window in each task's blocks. anchors: anchor_id, label, dimension, block,
    vector, low and high (arrays, one entry a window)."""
    packs = max(1, -(-anchors.count() // ANCHORS))
    own = anchors.withColumn("pack", F.pmod(F.xxhash64("anchor_id"), F.lit(packs)).cast("int"))
    own = own.groupBy("dimension", "pack").agg(F.collect_list(F.struct("anchor_id", "label", "block", "vector", "low", "high")).alias("anchors"))
    count = max(1, -(-blocks.select("block").count() // ZONES))
    maps = blocks.select("dimension", F.pmod(F.xxhash64("block"), F.lit(count)).alias("zone"), F.struct("block", "label", "low", "high").alias("z"))
    maps = maps.groupBy("dimension", "zone").agg(F.collect_list("z").alias("zones")).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    visits = own.join(maps, ["dimension", "pack"]).select("anchors", "zones").transform(in_batches, _choose(same), "block long, anchors binary, points binary, least binary, most binary")
    visits = checkpointed(visits)
    held = blocks.select("block", "dimension", "n", "kind", "ids", "vectors")
    return visits.join(held, "block").transform(in_batches, _search(k), "anchor_id long, window int, vec_id long, score double")


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def write_blocks(vectors: DataFrame, folder: str) -> DataFrame:
    """Writes the blocks of vec_id, label, embedding below a folder, and reads them."""
    schema = "vec_id long, label long, embedding array<double>, dimension int, place binary"
    placed = vectors.transform(in_batches, _placed(_cells(vectors)), schema)
    # The id comes last, so that equal vectors, however many, are cut apart.
    order = ["label", "dimension", "place", "vec_id"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).transform(in_batches, _packed, BLOCK).write.parquet(folder)
    return vectors.sparkSession.read.parquet(folder)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, with the label that every seventh changes."""
    good = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    return rows.withColumn("label", label)


def _whole(x: Column) -> Column:
    """The next whole number; doubles beyond EXACT are whole."""
    return F.when(F.abs(x) < EXACT, F.ceil(x).cast("double")).otherwise(x)


def _long(score: str) -> Column:
    return F.greatest(F.least(F.col(score), F.lit(FARTHEST)), F.lit(-FARTHEST)).cast("long")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, folder: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by `every`) and each of its first
    positives (same label) the first negatives (another label) with LEAST * positive <= MOST * negative <= MOST * positive.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors are compared with those of their own
    length; empty ones score 0. Ties go to the smaller vec_id. A row that repeats a vec_id is a candidate of its own; an anchor's own
    vec_id is none of its candidates, and of anchors that repeat a vec_id the first by label, length and vector asks. Scores are exact below 2**53 and
    rounded beyond; they are returned as FARTHEST at most. No rows give no rows; other columns are ignored. folder: where the blocks go, by default
    in the shared folder.
    """
    spark: SparkSession = vectors.sparkSession
    blocks = write_blocks(usable(vectors), folder or new_folder(spark, "negatives"))

    first = F.struct("label", "dimension", "vector", "block", "positives")
    anchors = blocks.transform(in_batches, _home(every, positives), _ANCHOR).groupBy("anchor_id").agg(F.min(first).alias("a"))
    anchors = checkpointed(anchors.select("anchor_id", "a.*"))
    floor = F.when(F.size("positives") == positives, F.array_min(F.transform("positives", lambda p: p["score"]))).otherwise(F.lit(LEAST_SCORE))
    asking = anchors.select("anchor_id", "label", "dimension", "block", "vector", F.array(floor).alias("low"), F.array(F.lit(float("inf"))).alias("high"))
    found = _read(blocks, asking, True, positives).drop("window")
    home = anchors.select("anchor_id", F.explode("positives").alias("p")).select("anchor_id", "p.*")
    best = checkpointed(_ranked(found.unionByName(home), positives, "anchor_id"))

    # A window's ends are whole numbers: scores are.
    low = F.transform("positives", lambda p: _whole(p["score"] * LEAST / MOST))
    listed = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score"), "vec_id"))).alias("positives"))
    windows = anchors.drop("positives").join(listed, "anchor_id")
    absent = F.array_repeat(F.lit(float("inf")), positives - F.size("positives"))
    asking = windows.select("anchor_id", "label", "dimension", "block", "vector", F.concat(low, absent).alias("low"), F.concat(F.transform("positives", lambda p: p["score"]), F.transform(absent, lambda x: -x)).alias("high"))
    ranked = _ranked(_read(blocks, asking, False, negatives), negatives, "anchor_id", "window")
    named = best.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = ranked.join(named, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), _long("positive_score").alias("positive_score"), _long("score").alias("negative_score"))
