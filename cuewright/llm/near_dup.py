"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with one word sequence become a class first, so copies of any number cost one row each. Classes get
min-hash signatures; classes that share a band are candidates. In a band's bucket every class is compared with the
bucket's smallest one, its head, not with every other: where that settles that all that a head has met are one component, no further pair of
them can change anything. Elsewhere, for the heads of each component at once, the classes outside of the largest component are compared with all
others that these heads have met, packed in blocks, and a block tells of one link at most between a class and a component.
A candidate pair's signatures are compared batch by batch; the pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls under `miss`. Survivors are compared on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import checkpointed, in_batches, release, small

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BAND_ROWS, BANDS = 5, 50
#: Positions of the signature that the sequential test may look at.
COMPARED = 144
#: Chance that a pair at the threshold shares no band, and chance at which the sequential test gives a pair up.
MISS = 1e-6
BATCH = 16
#: Documents, and bytes of text, that are packed into one row.
PACK_ROWS, PACK_BYTES = 256, 1 << 20

_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(1 << 32, size=BAND_ROWS * BANDS, dtype=np.uint32)
_ODD = _RNG.integers(1 << 32, size=BAND_ROWS * BANDS, dtype=np.uint32) | np.uint32(1)

MEMBERS = "doc_id long, text_hash long, seq_a long, seq_b long, n_shingles long"
SIGNED = f"{MEMBERS}, signature array<int>, bands array<long>"


def _sets(data: np.ndarray, offsets: np.ndarray):
    """For each row: (hash of its word sequence, a second one, sorted distinct shingle hashes)."""
    data = W.lower_ascii(data)
    start, end, first = W.word_spans(data, offsets)
    hashes = W.word_hashes(data, start, end)
    row_a, row_b = (W.run_hashes(h, first[:-1], first[1:], seed) for seed, h in enumerate((hashes, W.word_hashes(data, start, end, 1))))
    at = W.gram_starts(first, SHINGLE_WORDS)
    grams = W.gram_hashes(hashes, at, SHINGLE_WORDS)
    cut = np.searchsorted(at, first)
    for i in range(len(first) - 1):
        count = first[i + 1] - first[i]
        if count == 0:
            yield 0, 0, np.zeros(0, np.uint64)
        elif count < SHINGLE_WORDS:
            yield row_a[i], row_b[i], row_a[i : i + 1]
        else:
            yield row_a[i], row_b[i], np.unique(grams[cut[i] : cut[i + 1]])


def signature(grams: np.ndarray) -> np.ndarray:
    """Least values of a set under BANDS * BAND_ROWS permutations of 32-bit numbers."""
    least = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(least, ((low[k : k + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return least


def _sign(with_signature: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.chunked(batch):
                rows = list(_sets(data, offsets))
                columns = [
                    batch.column("doc_id").slice(first, last - first),
                    batch.column("text_hash").slice(first, last - first),
                    W.as_long(np.array([a for a, _, _ in rows], np.uint64)),
                    W.as_long(np.array([b for _, b, _ in rows], np.uint64)),
                    pa.array(np.array([len(g) for _, _, g in rows], np.int64)),
                ]
                names = ["doc_id", "text_hash", "seq_a", "seq_b", "n_shingles"]
                if with_signature:
                    signs = np.stack([signature(g) for _, _, g in rows])
                    places = np.tile(np.arange(BANDS) * BAND_ROWS, len(rows)) + np.repeat(np.arange(len(rows)) * len(_XOR), BANDS)
                    flat = np.ascontiguousarray(signs).reshape(-1).astype(np.uint64)
                    bands = W.span_hashes(flat, places, places + BAND_ROWS, 5)
                    bands = W.mix(bands + np.tile(np.arange(BANDS, dtype=np.uint64), len(rows)))
                    kept = np.ascontiguousarray(signs[:, :COMPARED]).reshape(-1).view(np.int32)
                    for values, width in ((kept, COMPARED), (bands.view(np.int64), BANDS)):
                        columns.append(pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width, values))
                    names += ["signature", "bands"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return sign


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest matches among n signature positions at which similarity >= percent keeps a posterior chance of miss.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its tail over t is the
    chance of at most m successes in n + 1 trials of chance t.
    """
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _open(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers of the rows of two signature tables that the sequential test does not give up."""
    open_, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
    for n in range(BATCH, COMPARED + 1, BATCH):
        part = slice(n - BATCH, n)
        matches[open_] += (one[open_, part] == two[open_, part]).sum(axis=1)
        open_ = open_[matches[open_] >= _NEED[n]]
    return open_


_NEED = {n: least_matches(n) for n in range(BATCH, COMPARED + 1, BATCH)}


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        kept = pa.array(_open(one, two))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in ("a", "b")], ["a", "b"])


def is_link(both, size_a, size_b):
    return (both > 0) & (100 * both >= PERCENT * (size_a + size_b - both))


def _grams(column: pa.Array) -> list[np.ndarray]:
    """Shingle sets of a column of texts."""
    data, offsets = W.text_bytes(column)
    out = []
    for first, last in W.row_chunks(offsets):
        at = offsets[first : last + 1]
        out += [g for _, _, g in _sets(data[at[0] : at[-1]], at - at[0])]
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, _, _ in W.chunked(batch, "text_b"):
            part = batch.slice(first, last - first)
            # Rows of one a lie together, so its text is cut up once.
            a = part.column("a").to_numpy()
            opens = np.append(True, a[1:] != a[:-1])
            heads = _grams(part.column("text_a").take(pa.array(np.flatnonzero(opens))))
            which, others = np.cumsum(opens) - 1, _grams(part.column("text_b"))
            keep = []
            for i, own in enumerate(others):
                head = heads[which[i]]
                if is_link(len(np.intersect1d(head, own, assume_unique=True)), len(head), len(own)):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def block_links(one, two) -> list[tuple[int, int]]:
    """Links between the classes of two blocks (ids, roots, signatures, shingle sets): one for each class of the first and
    component of the second that has any."""
    ids, roots, signs, grams = two
    sizes = np.array([len(g) for g in grams])
    member = np.repeat(np.arange(len(grams)), sizes)
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    flat, member = flat[order], member[order]
    out = []
    for x, root, sign, own in zip(*one, strict=True):
        other = np.flatnonzero(roots != root)
        other = other[_open(np.broadcast_to(sign, (len(other), len(sign))), signs[other])]
        if not len(other):
            continue
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
        n = high - low
        at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
        both = np.bincount(member[at], minlength=len(ids))
        good = other[is_link(both[other], len(own), sizes[other])]
        for k in np.unique(roots[good], return_index=True)[1]:
            out.append((int(x), int(ids[good[k]])))
    return out


def _unpack(rows: pa.Array):
    values = rows.values
    signs = values.field("signature").flatten().to_numpy().reshape(len(values), -1)
    return values.field("class").to_numpy(), values.field("root").to_numpy(), signs, _grams(values.field("text"))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            found = block_links(_unpack(batch.column("one")[i]), _unpack(batch.column("two")[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """The rows (head, class, root, signature, text) of each head in blocks of PACK_ROWS and PACK_BYTES or so."""
    sizes = rows.groupBy("head").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = small(sizes.select("head", F.ceil(F.greatest(F.col("n") / PACK_ROWS, F.col("bytes") / PACK_BYTES)).alias("parts")))
    part = F.pmod(F.xxhash64("class"), F.greatest("parts", F.lit(1)))
    packs = rows.join(parts, "head").groupBy("head", part.alias("part"))
    return packs.agg(F.collect_list(F.struct("class", "root", "signature", "text")).alias(name)).drop("part")


def _side(df: DataFrame, one: str, value: str, name: str) -> DataFrame:
    return df.select(F.col("class").alias(one), F.col(value).alias(name))


def _texts_of(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and text of the wanted classes, each once: the text of the class's first document, which a hash tells from others of its doc_id."""
    ids = small(classes.select("class", "doc_id", "text_hash").join(wanted.select("class").distinct(), "class", "left_semi"))
    return texts.join(ids, ["doc_id", "text_hash"]).select("class", "text").dropDuplicates(["class"])


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that the sequential test keeps and the full sets confirm."""
    signs = classes.select("class", "signature")
    kept = pairs.join(_side(signs, "a", "signature", "sig_a"), "a").join(_side(signs, "b", "signature", "sig_b"), "b")
    kept = checkpointed(kept.select("a", "b", "sig_a", "sig_b").transform(in_batches, _prune, "a long, b long"))
    # Texts are stored before they are joined, so that the pairs of one head can be split at run time.
    wanted = checkpointed(_texts_of(texts, classes, kept.select(F.explode(F.array("a", "b")).alias("class"))))
    found = kept.join(_side(wanted, "b", "text", "text_b"), "b").join(_side(wanted, "a", "text", "text_a"), "a")
    return checkpointed(found.select("a", "b", "text_a", "text_b").transform(in_batches, _confirm, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) with the least reachable node, for every node of the links (a, b) that isn't the least itself, by large-star and small-star rounds."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        tied = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(tied.union(least.select("u", F.col("m").alias("v"))).distinct())
        release(edges.sparkSession)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _placed(docs: DataFrame) -> DataFrame:
    """near_duplicates(), with a hash of each row's text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    members = texts.transform(in_batches, _sign(False), MEMBERS)
    classes = (
        texts.transform(in_batches, _sign(True), SIGNED)
        .filter("n_shingles > 0 and doc_id is not null")
        .groupBy("seq_a", "seq_b")
        .agg(F.min(F.struct("doc_id", "text_hash", "signature", "bands")).alias("least"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("class"), "seq_a", "seq_b", "copies", "least.*")
    )
    # Numbers of classes are fixed once they are stored. A doc_id would not do: rows may repeat it with other texts.
    classes = checkpointed(classes)
    release(docs.sparkSession)
    bands = classes.select("class", F.explode("bands").alias("band"))
    # Heads are stored before the join, so that its side with many rows of a band can be split at run time.
    heads = checkpointed(bands.groupBy("band").agg(F.min("class").alias("head"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    met = checkpointed(bands.join(heads, "band").filter("class > head").select("head", "class").distinct())
    del bands, heads
    release(docs.sparkSession)

    links = _links(met.select(F.col("head").alias("a"), F.col("class").alias("b")), classes, texts)
    release(docs.sparkSession)
    roots = checkpointed(components(links))

    # Heads of one component, with what any of them has met, which often is much the same, so that a class comes up once for all of them.
    own = roots.select(F.col("node").alias("head"), F.col("root").alias("of_head"))
    placed = met.join(own, "head", "left").select(F.coalesce("of_head", "head").alias("head"), "class").distinct()
    placed = checkpointed(placed.join(roots, placed["class"] == roots.node, "left").select("head", "class", F.coalesce("root", "class").alias("root")))
    shares = placed.groupBy("head", "root").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("head").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = checkpointed(placed.join(small(mixed.select("head", "main")), "head"))
    if not mixed.isEmpty():
        full = mixed.join(classes.select("class", "signature"), "class").join(_texts_of(texts, classes, mixed), "class")
        packs = _packed(full.filter("root <> main"), "one").join(_packed(full, "two"), "head").select("one", "two")
        roots = checkpointed(components(links.union(packs.transform(in_batches, _meet, "a long, b long"))))

    # Each class that has copies or links, with the smallest doc_id of its component.
    nodes = roots.union(roots.select("root", "root").distinct()).withColumnRenamed("node", "class")
    found = checkpointed(classes.select("class", "seq_a", "seq_b", "copies", "doc_id").join(nodes, "class", "left"))
    least = checkpointed(found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least_id")))
    found = found.join(least, "root", "left").filter("root is not null or copies > 1")
    found = checkpointed(found.select("seq_a", "seq_b", F.coalesce("least_id", "doc_id").alias("least_id")))
    rows = members.join(found, ["seq_a", "seq_b"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(own, F.coalesce("least_id", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Text is lower-cased for A-Z; a set holds the distinct runs of five words, or the whole sequence where there are
    fewer. No text or no words: an empty set, linked with nothing, its component_id its own doc_id. Equal sets by equal word sequences are
    one class. Repeated rows each get their row, with one result; rows that repeat a doc_id with another text are documents of their own,
    each with its own component. A null doc_id stays null, is linked with nothing and kept. Other columns are ignored.
    """
    return _placed(docs).drop("text_hash")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose document stands for its component; repeated rows of it stay too.

    Rows with a null doc_id stay.
    """
    gone = small(_placed(docs).filter("not kept").select(F.struct("doc_id", "text_hash").alias("gone")).distinct())
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    return docs.join(gone, own == gone.gone, "left_anti")
