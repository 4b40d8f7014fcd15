"""Mixing sources to target weights with hash-threshold histograms.

A document's hash decides on its place in its source's order, so no sort is needed: sizes are summed by source and hash
bucket, the bucket in which the running sum passes the source's budget is found, and that bucket alone is summed by
finer buckets, twice. What lies below the threshold is taken once more than the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import checkpointed, in_batches, small

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: A hash has LEVELS hexadecimal parts of DIGITS digits.
LEVELS, DIGITS = 3, 3
SEED = "mix"
#: The source in two columns without nulls; nulls come last.
KEY = ["no_source", "source_key"]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.zeros(0, np.int64)]
        for _, _, data, offsets in W.chunked(batch):
            sizes.append(np.diff(W.word_spans(data, offsets)[2]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(sizes))], ["doc_id", "source", "size"]
        )


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with `place`, their rank from 0, numbered by parts of the range so that no task holds all."""
    parts = sources.repartitionByRange("no_source", "source_key").withColumn("part", F.spark_partition_id())
    parts = checkpointed(parts)
    before, total = {}, 0
    for part, n in sorted(map(tuple, parts.groupBy("part").count().collect())):
        before[part], total = total, total + n
    within = F.row_number().over(Window.partitionBy("part").orderBy("no_source", "source_key"))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    return parts.withColumn("place", within - 1 + F.element_at(offset, F.col("part"))).drop("part")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """For each source: source_size and target, which is its weight's part of share * all sizes, but at most
    cap * source_size, the rest reshared by weight among the sources below theirs."""
    sources = _ranked(sized.groupBy(*KEY).agg(F.sum("size").alias("source_size")))
    each = F.array(*[F.lit(w) for w in weights])
    sources = checkpointed(sources.withColumn("weight", F.element_at(each, (F.col("place") % len(weights)).cast("int") + 1)))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        n, held, open_ = sources.agg(
            F.count_if(over), F.sum(F.when(over, cap * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == capped or not open_:
            break
        level, capped = (budget - (held or 0)) / open_, n
    goal = F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * F.lit(level or 0.0))
    return checkpointed(sources.select(*KEY, "source_size", goal.alias("target")))


def _digits(doc_id: Column, seed: str) -> list[Column]:
    """The hexadecimal parts of a document's hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return [F.substring(digest, 1 + k * DIGITS, DIGITS).alias(f"d{k}") for k in range(LEVELS)]


def _source_key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key")]


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.transform(in_batches, _sizes, "doc_id long, source string, size long")
    return checkpointed(rows.select("doc_id", "source", "size", *_source_key(F.col("source")), *_digits(F.col("doc_id"), seed)))


def thresholds(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """For each source: source_size, target, passes (times that all its documents are taken), and up to which hash (`cut`,
    with its own bucket if with_last) they are taken once more."""
    digits = [f"d{k}" for k in range(LEVELS)]
    goals = targets(sized, weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    edge = goals.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    edge = edge.withColumn("below", F.lit(0).cast("long"))
    for k, digit in enumerate(digits):
        known = digits[:k]
        inside = sized.join(edge.select(*KEY, *known), [*KEY, *known], "left_semi") if k else sized
        sums = inside.groupBy(*KEY, digit).agg(F.sum("size").alias("s"))
        run = F.sum("s").over(Window.partitionBy(*KEY).orderBy(digit))
        sums = sums.withColumn("upto", run).join(edge.select(*KEY, "rest", "below"), KEY)
        passed = sums.filter("below + upto > rest").groupBy(*KEY).agg(F.min_by(F.struct(digit, "s", "upto"), digit).alias("m"))
        edge = edge.join(passed, KEY, "left").withColumn("below", F.coalesce(F.expr("below + m.upto - m.s"), "below"))
        edge = checkpointed(edge.withColumn(digit, F.col(f"m.{digit}")).withColumn("last", F.col("m.s")).drop("m"))
    # The last bucket goes with those below it if that comes nearer to the budget.
    edge = edge.withColumn("with_last", F.expr("below + last - rest < rest - below"))
    return small(edge.select(*KEY, "source_size", "target", "passes", F.concat(*digits).alias("cut"), "with_last"))


def _copies(place: Column) -> Column:
    more = (place < F.col("cut")) | ((place == F.col("cut")) & F.col("with_last"))
    return F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source).

    Size: words of the text; null or empty: 0, and such a row takes 0. A null source is a source of its own. Order in
    a source: a hash of doc_id, so rows that repeat a doc_id (or have none) are taken or left together. Each source's
    sum of taken is as near to its target as whole documents in hash order allow. Other columns are ignored.
    """
    sized = _sized(docs, seed)
    rows = sized.join(thresholds(sized, weights, share, cap), KEY)
    taken = F.col("size") * _copies(F.concat(*[f"d{k}" for k in range(LEVELS)]))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with all columns, a row for each time that it takes them."""
    edge = thresholds(_sized(docs, seed), weights, share, cap).select(*KEY, "passes", "cut", "with_last")
    edge = edge.select(F.struct(*KEY).alias("mix_key"), F.struct("passes", "cut", "with_last").alias("mix_edge"))
    place = F.concat(*_digits(F.col("doc_id").cast("long"), seed))
    rows = docs.select(F.struct("*").alias("mix_row"), F.struct(*_source_key(F.col("source").cast("string"))).alias("mix_key"), place.alias("mix_place"))
    rows = rows.join(edge, "mix_key").select("mix_row", "mix_place", "mix_edge.*")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.when(_copies(F.col("mix_place")) > 0, _copies(F.col("mix_place")))))
    return rows.select("mix_row", times.alias("time")).select("mix_row.*")
