"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels tokens by their shapes, their lengths, the marks before them, and the words around them, as far as its labelled table has those.
It is trained by gradient ascent of the log-likelihood on a small labelled table (pii_lines), and decoded by Viterbi in numpy. A batch of
texts is cut up, measured and scored as arrays; tokens with the same features are scored once. Tokens that no best path can have in a span are
found by bounds first (possible()), so that paths fall into short chains between such tokens; the labels are those of Viterbi over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_lines
from . import words as W
from .tables import in_batches

#: Kinds of the fixed patterns, and those that only the field finds.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret", "id", "iban", "name", "address", "birth"]
LABELLED_KINDS = [k for k in ALL_KINDS if k not in ("ip", "card")]
LABELS = ["O", *[f"{p}-{k}" for k in LABELLED_KINDS for p in "BI"]]
EPOCHS, RATE, PENALTY = 80, 0.3, 1e-2
#: Lines that a word must be in to count as known.
LEAST_LINES = 3
#: One line in so many, of those whose spans are of these kinds alone, is learned from with all its words unknown, so that shapes count without them too.
WORDLESS, SHAPED = 3, ("phone", "secret", "id", "iban", "birth")
#: Kinds whose tokens all hold a digit.
WITH_DIGITS = ("phone", "id", "iban")

_EMAIL_LEFT = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at-signs so that long words cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern with parts of 255 at most; a run of digits is only tried from its first one."""
    out, at = [], 0
    while m := _DIGITS.search(text, at):
        if found := _IP.match(text, m.start()):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in found[0].split(".")):
                out.append(found.span())
            at = found.end()
        else:
            at = m.end()
    return out


_DIGITS = re.compile(r"[0-9]+")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the fixed patterns; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGITS.search(text):
        return out
    if "." in text:
        out["ip"] = ips(text)
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


# Tokens: runs of bytes that are neither white space nor one of these marks, without points and colons at their ends.
_APART = np.isin(np.arange(256), list(W.SEPARATORS + b"=\"'`;,<>[]{}|!?()*~\\"))
_TRIM = np.isin(np.arange(256), list(b".:"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[128:], _CLASS[_DIGIT] = ord("A"), ord("a"), ord("a"), ord("0")
_LETTER = np.isin(_CLASS, list(b"Aa"))
_NO_TAIL = (np.arange(256) & 0xC0) != 0x80
#: Marks before a token that tell something, as numbers that add up in fields of 16 bits.
_GAP = np.zeros(256, np.int64)
for _i, _marks in enumerate((b"=", b":", b"\n", b"(,;.|!?")):
    _GAP[list(_marks)] = 1 << 16 * _i

#: Bytes of text that are cut up at once, and tokens that are scored or decoded at once: a worker's memory goes by both, its results by neither.
CHUNK, BLOCK = 1 << 18, 1 << 12
#: Tokens before and after a token that its features look at, and numbers of features of a token.
AROUND = (-3, -2, -1, 1, 2)
_SELF, _WIDTH = 6, 6 + 1 + 2 * len(AROUND) + 2


@dataclass
class Tokens:
    """Tokens of a chunk of texts: bytes from start to end, row by row from first; `own` has six numbers of each: word, shape, short shape, digits, size, gap."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    own: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    start, end, first = W.word_spans(data, offsets, _APART)
    # Trim the ends, unless nothing would be left.
    solid = np.flatnonzero(~_TRIM[data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = high > low
    start[some], end[some] = solid[low[some]], solid[high[some] - 1] + 1
    kind = _CLASS[data]
    letter, digit = _LETTER[data], _DIGIT[data]
    repeated = np.zeros(len(data), bool)
    repeated[1:] = kind[1:] == kind[:-1]
    shapes = []
    for keep in (~(repeated & letter), ~(repeated & (letter | digit))):
        at = np.append(0, np.cumsum(keep))
        shapes.append(W.feature_hashes(kind[keep], at[start], np.maximum(at[end], at[start])))
    digits = np.append(0, np.cumsum(digit))
    turns = np.append(0, np.cumsum((digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])))
    n_digits, n_turns = digits[end] - digits[start], turns[np.maximum(end - 1, start)] - turns[start]
    size = np.frexp(np.maximum(end - start, 1).astype(float))[1]
    marks = np.append(0, np.cumsum(_GAP[data]))
    before = np.append(0, end)[:-1]
    row_start = np.repeat(offsets[:-1], np.diff(first))
    gap = marks[start] - marks[np.maximum(before, row_start)]
    flags = sum(((gap >> 16 * i & 0xFFFF) > 0).astype(np.int64) << i for i in range(4))
    word = W.feature_hashes(W.lower_ascii(data), start, end)
    own = [word, shapes[0], shapes[1], np.where(n_digits > 12, 12 + np.minimum(n_digits - 12, 36) // 6, n_digits), np.where(n_turns > 4, 5 + (np.minimum(n_turns, 16) - 4) // 6, n_turns) * 16 + np.minimum(size, 9), flags]
    return Tokens(start, end, first, np.stack([c.astype(np.uint64) for c in own], axis=1).reshape(-1, _SELF))


def _around(first: np.ndarray, k: int) -> np.ndarray:
    """Number of the token k places on in the same row, or -1."""
    n = int(first[-1])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n) + k
    return np.where((at >= first[row]) & (at < first[row + 1]), at, -1)


def _features(own: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Feature hashes, tokens x _WIDTH, from the numbers of tokens and of those around them (0 where there is none)."""
    word, short = 0, 2
    columns = [np.zeros(len(own), np.uint64), *own.T]
    columns += [x[:, c] for x in near for c in (word, short)]
    left = near[AROUND.index(-1)][:, word]
    columns += [W.mix(left + own[:, 5] + np.uint64(1)), W.mix(left ^ W.mix(own[:, short]))]
    return np.stack([W.mix(c * np.uint64(64) + np.uint64(i)) for i, c in enumerate(columns)], axis=1)


@dataclass
class Field:
    """Weights of features by label, in the order of the features' hashes with one of none behind; and of label pairs. Paths begin and end with O."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    emit: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LABELS))))
    step: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    #: Words and shapes of the labelled table; all others count as one.
    seen: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64)] * 3)

    def transitions(self) -> np.ndarray:
        return np.where(_BARRED, -1e9, self.step)

    def number(self, features: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, features), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == features, at, len(self.known)) if len(self.known) else np.zeros(features.shape, np.int64)

    def fold(self, own: np.ndarray) -> np.ndarray:
        """The numbers of tokens, with words and shapes that the table has not as 1."""
        out = own.copy()
        for c, seen in enumerate(self.seen):
            at = np.minimum(np.searchsorted(seen, own[:, c]), max(len(seen) - 1, 0))
            out[:, c] = np.where(seen[at] == own[:, c], own[:, c], np.uint64(1)) if len(seen) else np.uint64(1)
        return out

    def scores(self, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(label scores of the distinct kinds of tokens, the kind of each token)."""
        own = self.fold(found.own)
        key = W.mix(W.span_hashes(own.reshape(-1), np.arange(len(own)) * _SELF, np.arange(1, len(own) + 1) * _SELF, 6)) if len(own) else np.zeros(0, np.uint64)
        places = [_around(found.first, k) for k in AROUND]
        # Of those around it, a token's features only know the word and the short shape.
        whole, near_key = key, W.mix(own[:, 0] + W.mix(own[:, 2]))
        for i, at in enumerate(places):
            whole = W.mix(whole + np.where(at >= 0, near_key[at], np.uint64(0)) * np.uint64(2 * i + 3))
        _, one, kind = np.unique(whole, return_index=True, return_inverse=True)
        near = [np.where(at[one][:, None] >= 0, own[at[one]], np.uint64(0)) for at in places]
        # A token has _WIDTH x labels weights, so that only some are looked up at a time.
        scores = np.concatenate([self.emit[self.number(_features(own[one[a : a + BLOCK]], [x[a : a + BLOCK] for x in near]))].sum(axis=1) for a in range(0, len(one), BLOCK)] or [self.emit[:0]])
        return np.where(_NEEDS_DIGIT & (own[one, 3] == 0)[:, None], -1e9, scores), kind.reshape(-1)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best label paths of chains x tokens x labels, each between two O."""
        t = self.transitions()
        best, back = scores[:, 0] + t[0], []
        for k in range(1, scores.shape[1]):
            both = best[:, :, None] + t
            back.append(both.argmax(axis=1))
            best = both.max(axis=1) + scores[:, k]
        path = [(best + t[:, 0]).argmax(axis=1)]
        for b in reversed(back):
            path.append(b[np.arange(len(b)), path[-1]])
        return np.stack(path[::-1], axis=1)


_NEEDS_DIGIT = np.array([x[2:] in WITH_DIGITS for x in LABELS])
_BARRED = np.array([[b[0] == "I" and (a == "O" or a[2:] != b[2:]) for b in LABELS] for a in LABELS])


def parse_line(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a labelled line, and its spans in bytes."""
    text, spans = "", []
    for i, part in enumerate(re.split(rf"\[((?:{'|'.join(LABELLED_KINDS)}) [^\]]*)\]", line)):
        if i % 2:
            kind, _, part = part.partition(" ")
            spans.append((kind, len(text.encode()), len((text + part).encode())))
        text += part
    return text, spans


def as_chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def fit(lines: list[str]) -> Field:
    """Trains a field on labelled lines, all at once, by gradient ascent with per-weight step sizes."""
    parsed = [parse_line(x) for x in lines]
    # Longest lines first, so that those that have a k-th token are the first ones.
    order = np.argsort(-np.diff(tokens(*as_chunk([t for t, _ in parsed])).first), kind="stable")
    parsed = [parsed[i] for i in order]
    data, offsets = as_chunk([t for t, _ in parsed])
    found = tokens(data, offsets)
    sizes = np.diff(found.first)
    if not len(lines) or not sizes.max():
        return Field()
    gold = np.zeros((len(lines), int(sizes.max())), np.int64)
    inside = np.arange(gold.shape[1]) < sizes[:, None]
    for i, (_, spans) in enumerate(parsed):
        start, end = (c[found.first[i] : found.first[i + 1]] - offsets[i] for c in (found.start, found.end))
        for kind, a, b in spans:
            own = np.flatnonzero((start < b) & (end > a))
            gold[i, own] = LABELS.index(f"I-{kind}")
            gold[i, own[:1]] = LABELS.index(f"B-{kind}")
    # A word or shape that few lines have is taken as one that is not known, so that the field learns of those too.
    line = np.repeat(np.arange(len(lines)), sizes)
    seen = []
    for c, least in enumerate((LEAST_LINES, LEAST_LINES, 1)):
        pairs = np.unique(np.stack([found.own[:, c], line.astype(np.uint64)], axis=1), axis=0)
        values, count = np.unique(pairs[:, 0], return_counts=True)
        seen.append(values[count >= least])
    own = Field(seen=seen).fold(found.own)
    shaped = np.array([all(k in SHAPED for k, _, _ in spans) for _, spans in parsed])
    own[(order[line] % WORDLESS == 0) & shaped[line], 0] = 1
    near = [np.where(at[:, None] >= 0, own[at], np.uint64(0)) for at in (_around(found.first, k) for k in AROUND)]
    features = _features(own, near)
    known = np.unique(features)
    out = Field(known, np.zeros((len(known) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS))), seen)
    rows = np.full((*gold.shape, _WIDTH), len(known))
    rows[inside] = out.number(features)
    n, steps = gold.shape
    last, full, token = sizes - 1, np.flatnonzero(sizes > 0), rows[inside]
    # Tokens with the same features are one kind. Tokens in the order of their kinds, and kinds in that of their features, so that sums are of neighbours.
    kinds, kind = np.unique(token, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    mine, parts = np.argsort(kind, kind="stable"), np.append(0, np.cumsum(np.bincount(kind)))[:-1]
    by = np.argsort(kinds.reshape(-1), kind="stable")
    of, cuts = np.repeat(np.arange(len(kinds)), _WIDTH)[by], np.searchsorted(kinds.reshape(-1)[by], np.arange(len(known)))
    by_feature = lambda x: np.add.reduceat(np.add.reduceat(x[mine], parts)[of], cuts)
    target_e = by_feature(np.eye(len(LABELS))[gold[inside]])
    ends = np.concatenate([np.zeros((n, 1), np.int64), gold, np.zeros((n, 1), np.int64)], axis=1)
    target_s = np.zeros_like(out.step)
    for k in range(steps + 1):
        there = full[k <= sizes[full]]
        np.add.at(target_s, (ends[there, k], ends[there, k + 1]), 1)
    blocked = _NEEDS_DIGIT & (own[:, 3] == 0)[:, None]
    have = [int(x) for x in inside.sum(axis=0)]
    sum_e, sum_s = np.full_like(target_e, 1e-8), np.full_like(out.step, 1e-8)
    e = np.ones((n, steps, len(LABELS)))
    for _ in range(EPOCHS):
        t = np.exp(out.transitions())
        s = out.emit[kinds].sum(axis=1)[kind]
        e[inside] = np.where(blocked, 0.0, np.exp(s - s.max(axis=1, keepdims=True)))
        # Forward and backward values, each up to a factor: what is made of them is divided by its sum.
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        for k, m in enumerate(have):
            value = e[:m, k] * (alpha[:m, k - 1] @ t if k else t[0])
            alpha[:m, k] = value / value.sum(axis=1, keepdims=True)
        for k in range(steps - 1, -1, -1):
            m = have[k]
            after = (e[:m, k + 1] * beta[:m, k + 1]) @ t.T if k + 1 < steps else beta[:m, k]
            beta[:m, k] = np.where((k >= last[:m])[:, None], t[:, 0], after / np.maximum(after.sum(axis=1, keepdims=True), 1e-300))
        p = (alpha * beta)[inside]
        p /= p.sum(axis=1, keepdims=True)
        whole = np.zeros_like(e)
        whole[inside] = p
        g_e = target_e - by_feature(p) - PENALTY * out.emit[:-1]
        g_s = target_s - PENALTY * out.step
        g_s[0] -= whole[full, 0].sum(axis=0)
        g_s[:, 0] -= whole[full, last[full]].sum(axis=0)
        for k in range(1, steps):
            there = full[k < sizes[full]]
            pair = alpha[there, k - 1, :, None] * t * (e[there, k] * beta[there, k])[:, None, :]
            g_s -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        sum_e += g_e**2
        sum_s += g_s**2
        out.emit[:-1] += RATE * g_e / np.sqrt(sum_e)
        out.step += np.where(_BARRED, 0, RATE * g_s / np.sqrt(sum_s))
    return out


#: A sum of scores this far below 0 is below 0 whatever the rounding; and what parts the texts of a chunk, or stands for labels that a token can't have.
ROUNDING, FAR = 1e-3, -1e4


def possible(model: Field, scores: np.ndarray, kind: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which tokens a best path can have in a span.

    A span of a best path is worth no less than O in its place: the sum of what its tokens and steps gain over O, with the steps to it and from it
    that gain most, is not below 0. So a token is out if, for each kind, the best such sum of all runs of tokens around it is below 0. The sums
    come from running sums and their extremes, without a loop over tokens.
    """
    t, n = model.transitions(), len(kind)
    out = np.zeros(n, bool)
    parts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    starts = [0, *range(1, len(LABELS), 2)]
    for b in range(1, len(LABELS), 2):
        i = b + 1
        enter = (t[:, b] - t[:, 0]).max()
        leave = max((t[end, starts] - t[0, starts]).max() for end in (b, i))
        first = np.maximum(scores[:, b] - scores[:, 0], FAR)[kind] + enter
        inner = np.maximum(scores[:, i] - scores[:, 0] + max(t[b, i], t[i, i]) - t[0, 0], FAR)[kind]
        if first.max() + leave + np.maximum(inner, 0).sum() < -ROUNDING:
            continue
        inner[parts] = FAR
        run = np.cumsum(inner)
        upto = run + np.maximum.accumulate(first - run)
        beyond = np.maximum.accumulate(run[::-1])[::-1] - run
        out |= upto + beyond + leave >= -ROUNDING
    return out


def field_spans(model: Field, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Spans, in code points, that the field finds in each text of a chunk; chains of one length are decoded together."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    found = tokens(data, offsets)
    if not len(found.start):
        return out
    scores, kind = model.scores(found)
    row = np.repeat(np.arange(len(out)), np.diff(found.first))
    at = np.flatnonzero(possible(model, scores, kind, row))
    if not len(at):
        return out
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    size = np.diff(np.append(head, len(at)))
    label = np.zeros(len(row), np.int64)
    # Chains are filled up with tokens that can only be O to few lengths, which changes no path. Those with the same scores have the same path.
    scores = np.append(scores, [[0.0] + [-1e9] * (len(LABELS) - 1)], axis=0)
    lengths = np.where(size <= 4, size, 2 ** np.ceil(2 * np.log2(size)).astype(int) // 2 ** np.floor(np.log2(size)).astype(int))
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        which = np.minimum(head[own][:, None] + np.arange(n), len(at) - 1)
        there = np.arange(n) < size[own][:, None]
        kinds, back = np.unique(np.where(there, kind[at[which]], len(scores) - 1), axis=0, return_inverse=True)
        some = max(1, BLOCK // int(n))
        paths = np.concatenate([model.decode(scores[kinds[k : k + some]]) for k in range(0, len(kinds), some)])[back.reshape(-1)]
        label[at[which[there]]] = paths[there]
    points = np.append(0, np.cumsum(_NO_TAIL[data]))
    begins = np.flatnonzero(label % 2 == 1)
    inner = np.append((label > 0) & (label % 2 == 0), False)
    # The first token from each one on that is not the inside of a span.
    stops = np.flatnonzero(~inner)
    last = stops[np.searchsorted(stops, begins + 1)] - 1
    base = points[offsets[row[begins]]]
    for r, k, a, b in zip(row[begins], label[begins], points[found.start[begins]] - base, points[found.end[last]] - base, strict=True):
        out[r].append((LABELS[k][2:], int(a), int(b)))
    return out


#: What the text of a span must be like by its kind, at any length (a telephone number has 7 to 15 digits, as in the fixed pattern, and an IBAN 15 to 34
#: letters and digits, as in ISO 13616); a span that is not is dropped. No span goes over the end of a line.
CHECKS = {
    "email": re.compile(r".*@.*|.+\bat\b.+\bdot\b.+", re.I), "name": re.compile(r"[^\W\d_a-z][^\d\n]*"), "address": re.compile(r"(?=.*\d).*[^\W\d].*"), "birth": re.compile(r".*\d.*"),
    "secret": re.compile(r"\S{4,}"), "phone": re.compile(r"(?:[^\d\n]*\d){7,15}[^\d\n]*"), "id": re.compile(r".{6,}"), "iban": re.compile(r"(?=(?:[^\d\n]*\d){6})[^A-Za-z0-9\n]*(?:[A-Za-z0-9][^A-Za-z0-9\n]*){15,34}"),
}


def added(base: dict[str, list[tuple[int, int]]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of the spans that overlap no base span."""
    held = sorted(s for spans in base.values() for s in spans)
    if not held or not more:
        return more
    starts, far = np.array([a for a, _ in held]), np.maximum.accumulate([b for _, b in held])
    at = np.searchsorted(starts, [b for _, _, b in more])
    return [s for s, i in zip(more, at, strict=True) if i == 0 or far[i - 1] <= s[1]]


def all_spans(texts: list[str], model: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text: the base spans by kind, and all spans by kind and start. What the field adds overlaps no base span."""
    out = []
    for text, more in zip(texts, field_spans(model, data, offsets), strict=True):
        base = base_spans(text)
        more = [s for s in more if CHECKS[s[0]].fullmatch(text[s[1] : s[2]])]
        held = [(k, a, b) for k in KINDS for a, b in base[k]]
        out.append((base, sorted(held + added(base, more), key=lambda s: (ALL_KINDS.index(s[0]), s[1]))))
    return out


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def _find(model: Field):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.chunked(batch, limit=CHUNK):
                part = batch.slice(first, last - first)
                found = all_spans(_strings(part.column("text")), model, data, offsets)
                counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]
                held = [_text([(k, a, b) for k in KINDS for a, b in base[k]]) for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in held]), pa.array([_text(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"],
                )

    return find


def personal_data(docs: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of docs (doc_id, text).

    The counts and base_sha256 are of the fixed patterns; spans adds those of the field trained on `lines`, of the same and of further kinds, and
    n_spans counts them all. Null or empty text: counts of 0, the hash of nothing, no spans. Repeated rows each get their row. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(pii_lines.lines() if lines is None else lines)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return rows.transform(in_batches, _find(model), schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """The rows of docs, all of them with all columns, with personal data in text masked and n_chars, if there, set anew."""
    model = fit(pii_lines.lines() if lines is None else lines)
    names = docs.columns

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.chunked(batch, limit=CHUNK):
                part = batch.slice(first, last - first)
                texts = part.column("text").to_pylist()
                found = all_spans([t or "" for t in texts], model, data, offsets)
                done = [None if t is None else mask(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
                columns = {n: part.column(i) for i, n in enumerate(names)}
                columns["text"] = pa.array(done, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    out = docs.transform(in_batches, masked, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        same = F.col("text").isNull()
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out
