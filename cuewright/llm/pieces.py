"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice holds every way to write it in pieces of a vocabulary. No piece reaches across the end of a word, so the
lattice is a row of small ones, which are built once for each distinct word and kept. Sampling is a search of the tree of
all segmentations by perturbed scores: each node's score is its log-probability plus Gumbel noise, drawn from the top so
that a parent has the greatest score of its children. The search takes the best open node and walks down to a
segmentation; what it leaves at each step is one open node, drawn as a truncated Gumbel with the mass that is left. The k
segmentations found first are a sample without replacement. With the best score still open, kappa, a segmentation of
log-probability l gets the inclusion score 1 - exp(-exp(l - kappa)). Noise is a hash of the row's key, so it does not
depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, expm1, inf, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import in_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: From the third sample on, the search chooses among open nodes that several walks have left.
SAMPLES = 4
SPACE = "▁"
#: A piece weighs its rank to this power; a byte of a character without a piece counts as the last rank.
SHARPNESS = 1.0
CHUNK = 1 << 17
#: The number that a text's own sign for a space has among its characters; no piece holds it.
MARK = 0x110000
ALONE, BLANK, INSIDE = range(3)
#: Longer units have their lattices built one by one: the products of their chances may leave the range of numbers.
LONGEST = 48
#: Bits behind the point of chances that are summed.
UPTO_BITS = 36
#: Edges of kept lattices; the store starts anew beyond that.
MOST_EDGES = 3_000_000
#: Edges that a column has room for at first; one chunk may go beyond the bound.
ROOM = MOST_EDGES + (1 << 21)


class Vocabulary:
    """Pieces of a model with their log-weights, and how a text falls into units that no piece crosses."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id: dict[int, int] = {}
        names = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                if SPACE not in piece.lstrip(SPACE):
                    names[piece] = i
        ranks = {p: r for r, p in enumerate(sorted(names, key=names.get))}
        self.pieces = {p: (i, -SHARPNESS * log(2 + ranks[p])) for p, i in names.items()}
        self.levels = _levels(self.pieces)
        self.fallback = -SHARPNESS * log(2 + len(names))
        self.longest = max(map(len, names))
        #: What a character is to units: in pieces of several characters, a space, or a unit of its own; and whether it is a piece itself.
        self.kind, self.single = np.full(MARK + 1, ALONE, np.uint8), np.zeros(MARK + 1, bool)
        self.kind[[ord(c) for c in {c for p in names if len(p) > 1 for c in p}]] = INSIDE
        self.kind[ord(SPACE)] = BLANK
        self.single[[ord(p) for p in names if len(p) == 1]] = True


def _grown(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Hashes of texts that are one character longer."""
    return W.mix(h * np.uint64(0x9E3779B97F4A7C15) + point)


#: Bits of a hash by which a level is entered.
ENTRY = 15


@dataclass
class Level:
    """Hashes of the first n characters of all pieces, sorted, with the greatest number last; where the hashes with each first ENTRY bits begin;
    the piece that ends there, or -1, and its weight (not the logarithm)."""

    prefix: np.ndarray
    begin: np.ndarray
    piece: np.ndarray
    weight: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, or would be."""
        at = self.begin[h >> np.uint64(64 - ENTRY)]
        on = np.flatnonzero(self.prefix[at] < h)
        while len(on):
            at[on] += 1
            on = on[self.prefix[at[on]] < h[on]]
        return at


def _levels(pieces: dict[str, tuple[int, float]]) -> list[Level]:
    out = []
    for n in range(1, max(map(len, pieces)) + 1):
        starts = sorted({p[:n] for p in pieces if len(p) >= n})
        points = np.frombuffer("".join(starts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
        h = np.zeros(len(starts), np.uint64)
        for k in range(n):
            h = _grown(h, points[:, k])
        own = [pieces.get(p, (-1, 0.0)) for p in starts]
        order = np.argsort(h)
        prefix = np.append(h[order], np.uint64(2**64 - 1))
        begin = np.searchsorted(h[order], np.arange(1 << ENTRY, dtype=np.uint64) << np.uint64(64 - ENTRY))
        out.append(Level(prefix, begin, np.array([i for i, _ in own] + [-1], np.int32)[np.append(order, len(own))], np.exp([w for _, w in own] + [-inf])[np.append(order, len(own))]))
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Column:
    """A numpy array that grows at its end. Its room takes memory only where it was written to."""

    def __init__(self, kind):
        self.held, self.size = np.empty(ROOM, kind), 0

    def extend(self, values) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            self.held = np.append(self.values, np.empty(need, self.held.dtype))
        self.held[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


class Lattices:
    """Lattices of units, as growing arrays of edges; a node is known by its first edge, and a target is a node or -1. An edge's chance is that of
    all segmentations behind it; `upto` is the chance of its node's edges up to it, and infinite for the last."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.target, self.piece = _Column(np.int32), _Column(np.int32)
        self.logq, self.upto = _Column(np.float64), _Column(np.float32)
        self.clear()

    def clear(self) -> None:
        #: Hashes of the units that are kept, sorted, and their first nodes.
        self.known, self.root = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for column in (self.target, self.piece, self.logq, self.upto):
            column.size = 0

    def roots(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The first node of each unit of a text, given where units begin; units that are not kept yet are built once."""
        if self.piece.size > MOST_EDGES:
            self.clear()
        sizes = np.diff(begins, append=len(points))
        place = np.arange(len(points), dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes)
        h = W.mix(np.add.reduceat(W.mix((place.astype(np.uint64) << np.uint64(32)) + points), begins) + sizes.astype(np.uint64)) if len(begins) else np.zeros(0, np.uint64)
        distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(np.append(self.known, np.uint64(0))[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            root = self._build_all(points, begins[one[new]], sizes[one[new]])
            self.known, self.root = np.insert(self.known, at[new], distinct[new]), np.insert(self.root, at[new], root)
            at = np.searchsorted(self.known, distinct)
        return self.root[at][which]

    def _build_all(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        text = points[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])]
        plain = np.logical_and.reduceat(self.vocab.single[text], ends - sizes) & (sizes <= LONGEST)
        root = np.zeros(len(sizes), np.int64)
        if plain.any():
            root[plain] = self._build(text[np.repeat(plain, sizes)].astype(np.uint64), sizes[plain])
        for u in np.flatnonzero(~plain):
            root[u] = self._build_one(text[ends[u] - sizes[u] : ends[u]].tolist())
        return root

    def arrays(self):
        return [c.values for c in (self.target, self.piece, self.logq, self.upto)]

    def _build(self, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lattices of units of at most LONGEST characters, each of which is a piece."""
        n = len(text)
        ends = np.cumsum(lengths)
        far = (np.repeat(ends, lengths) - np.arange(n)).astype(np.uint8)
        start, h, found = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64), []
        for size, level in enumerate(self.vocab.levels, 1):
            if size > 1:
                inside = np.flatnonzero(far[start] >= size)
                start, h = start[inside], h[inside]
            h = _grown(h, text[start + (size - 1)])
            at = level.find(h)
            known = np.flatnonzero(level.prefix[at] == h)
            start, h, at = start[known], h[known], at[known]
            piece = level.piece[at]
            own = np.flatnonzero(piece >= 0)
            found.append((size, start[own], piece[own], level.weight[at[own]]))
            if not len(start):
                break
        # The edges of a node lie together, its longest pieces first.
        count = np.zeros(n, np.int32)
        for _, own, _, _ in found:
            count[own] += 1
        last = np.cumsum(count)
        first = last - count
        place, edges = first.copy(), int(last[-1])
        weight, pieces, target = np.zeros(edges), np.zeros(edges, np.int32), np.zeros(edges, np.int32)
        for size, own, piece, chance in reversed(found):
            to = place[own]
            place[own] += 1
            weight[to], pieces[to], target[to] = chance, piece, np.where(far[own] == size, n, own + size)
        # Totals from the last character of each unit to its first, the same place from the end in all units at once.
        nodes = np.argsort(far, kind="stable")
        own = count[nodes]
        after = np.cumsum(own)
        order = np.repeat(first[nodes] - (after - own), own) + np.arange(edges)
        value, behind = weight[order], target[order]
        total = np.append(np.zeros(n), 1.0)
        cuts = np.append(0, np.cumsum(np.bincount(far)[1:])).tolist()
        heads = np.append(0, np.append(0, after)[cuts[1:]]).tolist()
        marks = after - own
        for a, b, low, high in zip(cuts[:-1], cuts[1:], heads[:-1], heads[1:], strict=True):
            value[low:high] *= total[behind[low:high]]
            total[nodes[a:b]] = np.add.reduceat(value[low:high], marks[a:b] - low)
        weight[order] = value
        chance = weight / np.repeat(total[:n], count)
        # As whole numbers, so that they don't depend on what lies before.
        whole = (chance * 2.0**UPTO_BITS).astype(np.int64)
        run = np.cumsum(whole)
        upto = (run - np.repeat((run - whole)[first], count)) / 2.0**UPTO_BITS
        upto[last - 1] = inf
        base = self.piece.size
        self.target.extend(np.append(base + first, -1)[target])
        self.piece.extend(pieces)
        self.logq.extend(np.log(chance))
        self.upto.extend(upto)
        return base + first[ends - lengths]

    def _node(self, edges: list[tuple[int, int, float]]) -> int:
        """Adds a node with edges (target, piece, log-chance)."""
        node = self.piece.size
        self.target.extend([e[0] for e in edges])
        self.piece.extend([e[1] for e in edges])
        self.logq.extend([e[2] for e in edges])
        self.upto.extend(np.append(np.cumsum(np.exp([e[2] for e in edges]))[:-1], inf))
        return node

    def _build_one(self, points: list[int]) -> int:
        """The lattice of a long unit, or one with characters that are only written in bytes; each byte is a node."""
        vocab, n = self.vocab, len(points)
        raw_only = points == [MARK]
        unit = SPACE if raw_only else "".join(map(chr, points))
        plain = bool(vocab.single[points].all())
        node, after = [-1] * (n + 1), [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            edges = []
            sizes = range(i + 1, min(n, i + vocab.longest) + 1)
            for j in () if raw_only else reversed(sizes) if plain else sizes:
                if found := vocab.pieces.get(unit[i:j]):
                    edges.append((node[j], found[0], found[1] + after[j]))
            if raw_only or unit[i] not in vocab.pieces:
                raw = unit[i].encode("utf-8", "surrogatepass")
                target = node[i + 1]
                for b in reversed(raw[1:]):
                    target = self._node([(target, vocab.byte_id[b], 0.0)])
                edges.append((target, vocab.byte_id[raw[0]], vocab.fallback * len(raw) + after[i + 1]))
            top = max(e[2] for e in edges)
            total = top + log(sum(exp(e[2] - top) for e in edges))
            after[i] = total
            node[i] = self._node([(t, p, w - total) for t, p, w in edges])
        return node[0]


_lattices: dict[str, Lattices] = {}


_GOLDEN = 0x9E3779B97F4A7C15


def _uniform(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from the upper half of each hash."""
    return ((h >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32


def _step_hash(seed: np.ndarray, step) -> np.ndarray:
    """What chance has in store at a step (from 0) of the walks with these seeds: the upper half chooses the edge, the lower half is the wait."""
    return W.mix(seed + (step.astype(np.uint64) + np.uint64(1)) * np.array([_GOLDEN], np.uint64))


def _walk(store, start: np.ndarray, seeds: np.ndarray):
    """Walks down from each start node: (steps of each walk; edges of all steps, walk by walk)."""
    target, _, _, upto = store
    live, node, steps = np.flatnonzero(start >= 0), start[start >= 0], []
    taken = np.zeros(len(start), np.int64)
    while len(live):
        u = _uniform(_step_hash(seeds[live], np.array([len(steps)])))
        edge = node.astype(np.int64)
        # The first edges of a node are its longest pieces, which are chosen most often.
        on = np.flatnonzero(u >= upto[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= upto[edge[on]]]
        steps.append((live, edge))
        taken[live] += 1
        node = target[edge]
        on = np.flatnonzero(node >= 0)
        live, node = live[on], node[on]
    at = np.append(0, np.cumsum(taken))
    edges = np.zeros(at[-1], np.int32)
    for k, (which, e) in enumerate(steps):
        edges[at[which] + k] = e
    return taken, edges


#: Steps of a walk whose leavings are looked at first; the logarithm of no wait lies further below 0 than LEAST_WAIT.
EARLY, LEAST_WAIT = 512, 23.0


def _leavings(store, walked, a: np.ndarray, b: np.ndarray, phi: np.ndarray, most: int):
    """The nodes that walks leave, for walks over the steps a to b of `walked` (_walk()'s start, seeds, ends, edges, their log-chances and running
    sums) after log-probabilities phi: a row for each walk of (order, unit, node, log-probability before it, minus logarithm of its Gumbel).

    The log-probability only falls along a walk, so what lies behind its first EARLY steps can't be among the `most` best once it fell enough;
    where it did not, the whole walk is looked at.
    """
    start, seeds, ends, edges, logs, total = walked
    target, _, _, upto = store
    unit_of = np.repeat(np.arange(len(start)), np.diff(ends))

    def look(a, b, phi, size):
        at = a[:, None] + np.arange(size)
        inside = at < b[:, None]
        at = np.minimum(at, b[:, None] - 1)
        unit = unit_of[at]
        step = at - ends[unit]
        node = np.where(step == 0, start[unit], target[edges[at - (step > 0)]])
        before = phi[:, None] + total[at] - total[a][:, None]
        wait = -np.log(((_step_hash(seeds[unit], step) & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32)
        rest = np.log(wait / -np.expm1(np.minimum(logs[at], -1e-15))) - before
        rest = np.where(inside & (upto[node] < inf), rest, inf)
        order = np.argpartition(rest, most - 1, axis=1)[:, :most] if size > most else np.broadcast_to(np.arange(size), rest.shape)
        own = np.arange(len(a))[:, None]
        return order, unit[own, order], node[own, order], before[own, order], rest[own, order]

    found = look(a, b, phi, min(EARLY, int((b - a).max())))
    last = np.minimum(a + EARLY, b)
    sure = (last == b) | (-(phi + total[last] - total[a]) - LEAST_WAIT > found[4].max(axis=1))
    rows = [tuple(c[i] for c in found) for i in range(len(a))]
    for i in np.flatnonzero(~sure):
        rows[i] = tuple(c[0] for c in look(a[i : i + 1], b[i : i + 1], phi[i : i + 1], int(b[i] - a[i])))
    return rows


def sample_texts(texts: list[str], keys: np.ndarray, path: str = MODEL, k: int = SAMPLES):
    """For each text a list of at most k (piece ids, log-probability, inclusion score), the first found first."""
    vocab = vocabulary(path)
    lattices = _lattices.setdefault(path, Lattices(vocab))
    points, begins, sizes = _units(vocab, texts)
    roots = lattices.roots(points, begins)
    store = lattices.arrays()
    piece, logq = store[1:3]
    edge_of = np.append(0, np.cumsum(sizes))
    row = np.repeat(np.arange(len(texts)), sizes)
    number = np.arange(len(begins)) - edge_of[row]
    key = keys.astype(np.uint64)[row] + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    found: list[list] = [[] for _ in texts]
    open_: list[list] = [[] for _ in texts]
    # A walk: text, its score, log-probability and pieces so far, first unit, the node that it starts at.
    walks = [(i, _root_score(int(keys[i])), 0.0, np.zeros(0, np.int32), 0, -2) for i in range(len(texts)) if sizes[i]]
    for i in range(len(texts)):
        if not sizes[i]:
            found[i].append((np.zeros(0, np.int32), 0.0, inf))
    for turn in range(k):
        if not walks:
            break
        which = [np.arange(edge_of[i] + unit, edge_of[i + 1]) for i, _, _, _, unit, _ in walks]
        heads = np.append(0, np.cumsum([len(w) for w in which]))
        which = np.concatenate(which)
        start = roots[which]
        for (_, _, _, _, _, node), head in zip(walks, heads[:-1], strict=True):
            if node != -2:
                start[head] = node
        seeds = W.mix(key[which] + np.uint64(0x165667B19E3779F9 * (turn + 1) & (2**64 - 1)))
        taken, edges = _walk(store, start, seeds)
        ends = np.append(0, np.cumsum(taken))
        logs = logq[edges]
        total = np.zeros(len(logs) + 1)
        np.cumsum(logs, out=total[1:])
        ids = piece[edges]
        cuts = ends[heads]
        leavings = _leavings(store, (start, seeds, ends, edges, logs, total), cuts[:-1], cuts[1:], np.array([w[2] for w in walks]), k + 1 - turn)
        again = []
        for w, (i, score, phi, prefix, _, _) in enumerate(walks):
            a, b = int(cuts[w]), int(cuts[w + 1])
            path = np.concatenate([prefix, ids[a:b]])
            # What is left at a node has the score of a Gumbel of its mass, cut off at the score of the node.
            for s, unit, node, before, rest in zip(*(c.tolist() for c in leavings[w]), strict=True):
                if rest < inf:
                    minus = _log_add(-score, rest)
                    heapq.heappush(open_[i], (minus, len(open_[i]) + 1000 * turn, before, len(prefix) + s, int(which[unit]), node, (int(edges[a + s]),), path))
            found[i].append((path, phi + float(total[b] - total[a]), 0.0))
            if turn + 1 < k and open_[i]:
                again.append(_branch(open_[i], i, int(edge_of[i]), store, int(keys[i]), turn))
        walks = again
    out = []
    for i, samples in enumerate(found):
        kappa = -open_[i][0][0] if open_[i] else -inf
        out.append([(e, p, 1.0 if kappa == -inf else -expm1(-exp(min(p - kappa, 700.0)))) for e, p, _ in samples])
    return out


def _units(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts, with a sign for a space before each that has any; where units begin; and how many of them each text has.

    A unit is a run of characters of pieces with the spaces before it, a run of spaces, or another character. A text's own sign for a space is one.
    """
    marked = [" " + t if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points == ord(SPACE), np.uint32(MARK), points)
    points[points == 32] = ord(SPACE)
    heads = np.append(0, np.cumsum([len(t) for t in marked]))
    kind = vocab.kind[points]
    opens = kind == ALONE
    opens[1:] |= (kind[:-1] == ALONE) | ((kind[1:] == BLANK) & (kind[:-1] == INSIDE))
    opens[heads[:-1][np.diff(heads) > 0]] = True
    begins = np.flatnonzero(opens)
    return points, begins, np.diff(np.searchsorted(begins, heads))


def _chances(seed: int) -> tuple[float, float]:
    """Two numbers in (0, 1) from one seed: W.mix() of a single number, in halves."""
    h = seed & (2**64 - 1)
    h ^= h >> 31
    h = h * 0x9E3779B97F4A7C15 & (2**64 - 1)
    h ^= h >> 29
    h = h * 0xD6E8FEB86659FD93 & (2**64 - 1)
    h ^= h >> 32
    return ((h >> 32) + 0.5) / 2**32, ((h & 0xFFFFFFFF) + 0.5) / 2**32


def _log_add(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b)))


def _root_score(key: int) -> float:
    return -log(-log(_chances(key)[0]))


def _branch(heap: list, i: int, first_unit: int, store, key: int, turn: int):
    """Takes the best open node: one of its children that are left, by their chances, and what then is left is open again."""
    minus, _, before, place, unit, node, gone, path = heapq.heappop(heap)
    target, piece, logq, upto = store
    low = last = node
    while upto[last] < inf:
        last += 1
    logs = logq[low : last + 1].tolist()
    own = [(low + n, exp(x)) for n, x in enumerate(logs) if low + n not in gone]
    u, v = _chances(key + (turn + 1) * 0x27D4EB2F165667C5 + place * 0x9E3779B97F4A7C15)
    rest = sum(x for _, x in own)
    aim, child, chance = u * rest, *own[-1]
    for e, x in own:
        aim -= x
        if aim < 0:
            child, chance = e, x
            break
    rest -= chance
    if len(own) > 1 and rest > 0:
        heapq.heappush(heap, (_log_add(minus, log(-log(v)) - before - log(rest)), len(heap) + 1000 * (turn + 1), before, place, unit, node, (*gone, child), path))
    prefix = np.append(path[:place], piece[child])
    return i, -minus, before + logs[child - low], prefix, unit - first_unit, int(target[child])


def decode_pieces(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text that piece numbers stand for; the first sign for a space is not part of it."""
    table = vocab.bytes
    raw = b"".join(map(table.__getitem__, ids))
    return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


SAMPLED = "doc_id long, sample int, n_pieces int, log_prob double, inclusion double, ids_sha256 string, round_trip boolean"


def _encode(path: str, k: int, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(vocabulary(path).bytes, pa.large_binary())
        for batch in batches:
            for first, last, _, _ in W.chunked(batch, limit=CHUNK):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column("text").to_pylist()]
                marked = pa.array([b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], pa.large_binary())
                found = sample_texts(texts, part.column("row_key").to_numpy().view(np.uint64), path, k)
                rows = [(i, n + 1, *s) for i, own in enumerate(found) for n, s in enumerate(own)]
                ids = [s[2].astype(np.int32) for s in rows]
                row, ends = pa.array([s[0] for s in rows], pa.int64()), np.append(0, np.cumsum([len(x) for x in ids]))
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                decoded = pc.binary_join(pa.LargeListArray.from_arrays(ends, table.take(pa.array(flat))), pa.scalar(b"", pa.large_binary()))
                columns = [
                    part.column("doc_id").take(row), pa.array([s[1] for s in rows], pa.int32()), pa.array([len(x) for x in ids], pa.int32()),
                    pa.array([s[3] for s in rows], pa.float64()), pa.array([s[4] for s in rows], pa.float64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pc.equal(decoded, marked.take(row)),
                ]
                names = [x.split()[0] for x in SAMPLED.split(", ")]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        _lattices.clear()

    return encode


def sample_encodings(docs: DataFrame, path: str = MODEL, k: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, log_prob, inclusion, ids_sha256 (of the ids as 32-bit numbers), round_trip (the ids decode to the
    text) and ids: at most k distinct segmentations of each row of docs (doc_id, text).

    A row's key is its doc_id (a null has a key of its own), so rows that repeat it get the same segmentations of the same
    text. A text with fewer segmentations has all of them, each with inclusion 1. Null or empty text: one without pieces.
    Other columns are ignored.
    """
    key = F.xxhash64(F.col("doc_id").cast("long")).alias("row_key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key)
    return rows.transform(in_batches, _encode(path, k, with_ids), SAMPLED + ", ids array<int>" * with_ids)


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids, at = batch.column("ids").flatten().to_numpy(), np.append(0, np.cumsum(batch.column("ids").value_lengths().to_numpy()))
            texts = pa.array([decode_pieces(ids[a:b].tolist(), vocab) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
            yield batch.append_column("decoded", texts)

    return decode


def decode_encodings(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows with the text that their ids stand for, as `decoded`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.transform(in_batches, _decode(path), f"{schema}, decoded string")
