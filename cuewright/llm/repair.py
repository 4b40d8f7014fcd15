"""Repair of the structure of conversations at the least cost of edits.

A conversation should be empty, or an optional system turn and then pairs of a user's and an assistant's turn. Edits keep, rerole or
delete a turn, or insert one; a lattice has a layer for each place between turns and in it a node for each state of the form
(nothing yet, after the system, after the user, after the assistant). Two Dijkstra searches, one from either end, meet on it;
all crossings of the least cost are finished, and of their audits (the initials of the edits) the first in order is taken.

Rows are sorted by conversation over the whole table, so that a conversation of any length is cut into segments that many tasks reduce, each to the
least costs between the states at its ends; a search over these reductions then repairs the conversation as a whole. Two audits of
equal cost between the same nodes are never one the beginning of the other, as both pass the same turns and have as
many insertions; so the first of several audits stays the first whatever comes before and behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import in_batches, new_folder, small

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States of the form, and those in which it may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (NOTHING, ASSISTANT)
#: What a turn of each initial does to the state.
FORM = {"s": [(NOTHING, SYSTEM)], "u": [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
TURNS = FORM["u"] + FORM["a"]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A segment has at most so many turns or characters; so many reductions at most are left to the last search.
SEGMENT, SEGMENT_CHARS, LAYERS = 512, 1 << 20, 16
SPACES = " \t\n\v\f\r"

Edge = tuple[int, int, int, str]


@lru_cache(maxsize=None)
def edges(code: str) -> tuple[Edge, ...]:
    """(from state, to state, cost, initial) for a turn: x must go; s, u, a or o (another initial) is sound, in capitals unfinished."""
    out = [(g, g, DELETE, "D") for g in STATES]
    if code != "x":
        more = UNFINISHED * code.isupper()
        out += [(g, h, KEEP + more, "K") for g, h in FORM.get(code.lower(), [])]
        out += [(g, h, REROLE + more, "R") for g, h in TURNS]
    return tuple(out)


INSERTIONS: tuple[Edge, ...] = tuple((g, h, INSERT, "I") for g, h in TURNS)


class _Side:
    """A Dijkstra search from one end: nodes are (layer, state), settled by cost, then layer, then audit."""

    def __init__(self, layers: list[tuple[Edge, ...]], within: tuple[Edge, ...], begin: list[int], back: bool):
        self.layers, self.within, self.back, self.n = layers, within, back, len(layers)
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}
        self.heap = [(0, 0, "", g) for g in begin]

    def top(self) -> float:
        while self.heap and (self.heap[0][1], self.heap[0][3]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        """Settles the next node; its layers are counted from this side's end."""
        cost, layer, audit, state = heappop(self.heap)
        self.settled[layer, state] = cost, audit
        for h, more, name in self.ways(layer, state, 0):
            if (layer, h) not in self.settled:
                heappush(self.heap, (cost + more, layer, name + audit if self.back else audit + name, h))
        for h, more, name in self.ways(layer, state, 1):
            if (layer + 1, h) not in self.settled:
                heappush(self.heap, (cost + more, layer + 1, name + audit if self.back else audit + name, h))
        return layer, state

    def ways(self, layer: int, state: int, ahead: int) -> Iterator[tuple[int, int, str]]:
        """(state, cost, audit) of the edges to the next layer (ahead 1), or of those that stay (0)."""
        if not ahead:
            here = self.within
        elif layer == self.n:
            return
        else:
            here = self.layers[self.n - 1 - layer] if self.back else self.layers[layer]
        for g, h, cost, name in here:
            if (h if self.back else g) == state:
                yield (g if self.back else h), cost, name


def meet(layers: list[tuple[Edge, ...]], within: tuple[Edge, ...] = INSERTIONS) -> tuple[int, str]:
    """(cost, audit) of the cheapest way from NOTHING to one of ENDS through all layers; of several the first audit."""
    n = len(layers)
    ahead, behind = _Side(layers, within, [NOTHING], False), _Side(layers, within, list(ENDS), True)
    least, crossings = float("inf"), []
    # A way of the least cost has an edge from a settled node of one side to one of the other as soon as the tops add up to more.
    while ahead.top() + behind.top() <= least:
        side, other = (ahead, behind) if ahead.top() <= behind.top() else (behind, ahead)
        layer, state = side.settle()
        cost, audit = side.settled[layer, state]
        meets = [((n - layer, state), 0, "")]
        meets += [((n - layer - step, h), more, name) for step in (0, 1) for h, more, name in side.ways(layer, state, step)]
        for node, more, name in meets:
            if node in other.settled:
                rest, end = other.settled[node]
                total = cost + more + rest
                if total <= least:
                    crossings = crossings if total == least else []
                    least = total
                    crossings.append(end + name + audit if side.back else audit + name + end)
    return int(least), min(crossings)


@lru_cache(maxsize=100_000)
def solve(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, which goes by the codes of its turns alone."""
    return meet([edges(c) for c in codes])


def reduction(codes: str) -> tuple[Edge, ...]:
    """The least cost and first audit of a segment between each two states."""
    layers, out = [edges(c) for c in codes], []
    for g in STATES:
        side = _Side(layers, INSERTIONS, [g], False)
        while side.top() < float("inf"):
            side.settle()
        out += [(g, h, *side.settled[len(layers), h]) for h in STATES if (len(layers), h) in side.settled]
    return tuple(out)


def joined(a: tuple[Edge, ...], b: tuple[Edge, ...]) -> tuple[Edge, ...]:
    """Reductions of neighbours as one."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for g, m, cost, audit in a:
        for m2, h, more, rest in b:
            if m == m2:
                way = cost + more, audit + rest
                if (g, h) not in best or way < best[g, h]:
                    best[g, h] = way
    return tuple((g, h, *way) for (g, h), way in best.items())


def solve_segments(parts: list[tuple[Edge, ...]]) -> tuple[int, str]:
    """solve() for a conversation as the reductions of its segments."""
    while len(parts) > LAYERS:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return meet(parts, ())


def applied(audit: str, codes: str, lines: list[dict], state: int = NOTHING) -> tuple[list[dict], int]:
    """The turns that an audit leaves, and the state behind them. lines: role and text of the turns whose code is not x."""
    out, at, line = [], 0, 0
    for edit in audit:
        turn = None
        if edit != "I":
            if codes[at] != "x":
                turn, line = lines[line], line + 1
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[codes[at - 1].lower()]
            out.append(turn)
        else:
            state = ASSISTANT if state == USER else USER
            out.append({"role": ROLES[state], "text": turn["text"] if turn else ""})
    return out, state


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_REPORT = pa.struct([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
REPORT = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"
TURN_LIST = "array<struct<role:string,text:string>>"
EDGES = "array<struct<g:int,h:int,cost:int,audit:string>>"
_EDGES = pa.list_(pa.struct([("g", pa.int32()), ("h", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())]))
_COUNTED = [*COUNTS, "first_turn", "last_turn"]


class _Segment:
    """What is known of consecutive turns of one conversation."""

    def __init__(self):
        self.codes, self.lines, self.chars = [], [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.opens = self.closes = None

    def add(self, turn, role: str, text: str, initial: str, blank: bool, repeats: bool, cut_off: bool) -> None:
        fault = "blank" if blank else "duplicate" if repeats else "truncated" if cut_off else None
        if fault:
            self.counts[fault] += 1
        if fault in ("blank", "duplicate"):
            self.codes.append("x")
        else:
            code = initial if initial in ("s", "u", "a") else "o"
            self.codes.append(code.upper() if fault else code)
            self.lines.append({"role": role, "text": text})
            self.chars += len(text)
        if self.opens is None:
            self.opens = initial
        else:
            self.counts["illegal"] += self.closes + initial not in ("su", "ua", "au")
        self.closes = initial
        if turn is not None:
            self.counts["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self) -> dict:
        return {"codes": "".join(self.codes), "opens": self.opens, "closes": self.closes, "first_turn": self.first_turn, "last_turn": self.last_turn, **self.counts}


def _report(rows: list[dict], cost: int, audit: str) -> dict:
    """The counts of a conversation from those of its segments, in order."""
    total = {c: sum(r[c] for r in rows) for c in COUNTS}
    turned, spoken = [r for r in rows if r["first_turn"] is not None], [r for r in rows if r["opens"] is not None]
    total["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
    total["illegal"] += sum(a["closes"] + b["opens"] not in ("su", "ua", "au") for a, b in zip(spoken, spoken[1:], strict=False))
    gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - total.pop("turns") if turned else 0
    total.pop("turns", None)
    return total | {"gaps": gaps, "cost": cost, "audit": audit}


def _schema(key: pa.DataType) -> pa.Schema:
    texts = [("codes", pa.string()), ("opens", pa.string()), ("closes", pa.string())]
    return pa.schema([("conv_id", key), ("part", pa.int64()), ("no", pa.int64()), ("whole", pa.bool_()), *texts, *[(c, pa.int64()) for c in _COUNTED], ("edges", _EDGES), ("report", _REPORT), ("lines", _TURNS)])


def _edge_rows(parts: tuple[Edge, ...]) -> list[dict]:
    return [dict(zip("g h cost audit".split(), e, strict=True)) for e in parts]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as segments. A conversation that begins and ends within the task, in one segment, is repaired at once; what may reach into
    another task, or is longer, comes with its reduction."""
    part, no, out, size = TaskContext.get().partitionId(), 0, [], 0
    now, first, split, held, last = None, True, False, None, None
    schema = None

    def close(whole: bool) -> None:
        nonlocal no, size
        row = held.row()
        if whole:
            cost, audit = solve(row["codes"])
            row |= {"report": _report([row], cost, audit), "lines": applied(audit, row["codes"], held.lines)[0]}
        else:
            row |= {"edges": _edge_rows(reduction(row["codes"])), "lines": held.lines}
        out.append({"conv_id": now[0], "part": part, "no": no, "whole": whole, **row})
        no, size = no + 1, size + held.chars

    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv_id").type)
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "absent", "turn", "role", "text", "initial", "is_blank", "later", "cut_off")]
        for conv, absent, turn, role, text, initial, blank, later, cut_off in zip(*columns, strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    close(not first and not split)
                    first = False
                now, split, held, last = (conv,), False, _Segment(), None
            if absent:
                continue
            if len(held.codes) == SEGMENT or held.chars > SEGMENT_CHARS:
                close(False)
                split, held = True, _Segment()
            own = turn, role, text
            held.add(turn, role, text, initial, blank, later or own == last, cut_off)
            last = own
            if len(out) >= 500 or size > SEGMENT_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if now is not None:
        close(False)
        yield pa.RecordBatch.from_pylist(out, schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each segment, with the state before it, and the conversation's report beside its last one, from sorted segments without texts."""
    schema = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("slice", pa.string()), ("state", pa.int32()), ("report", _REPORT)])
    now, rows = None, []

    def close() -> pa.RecordBatch:
        cost, audit = solve_segments([tuple((e["g"], e["h"], e["cost"], e["audit"]) for e in r["edges"]) for r in rows])
        made, at, state = [], 0, NOTHING
        for i, r in enumerate(rows):
            end, left = at, len(r["codes"])
            while left:
                left -= audit[end] != "I"
                end += 1
            end = len(audit) if i + 1 == len(rows) else end
            made.append({"part": r["part"], "no": r["no"], "slice": audit[at:end], "state": state, "report": _report(rows, cost, audit) if i + 1 == len(rows) else None})
            blanks = [{"role": "", "text": ""}] * len(r["codes"])
            at, state = end, applied(audit[at:end], r["codes"], blanks, state)[1]
        return pa.RecordBatch.from_pylist(made, schema)

    for batch in batches:
        for r in batch.to_pylist():
            if now is not None and now[0] != r["conv_id"]:
                yield close()
                rows = []
            now = (r["conv_id"],)
            rows.append(r)
    if rows:
        yield close()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = [applied(a, c, own, s)[0] for a, c, own, s in zip(*(batch.column(n).to_pylist() for n in ("slice", "codes", "lines", "state")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "no", "report")), pa.array(turns, _TURNS)], ["conv_id", "part", "no", "report", "lines"])


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def turns_with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent with initial, is_blank, cut_off, and later: whether the conversation has the same role and text at an earlier turn."""
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "is_blank": _trimmed(F.col("text")) == "", "cut_off": ~F.right(_trimmed(F.col("text")), F.lit(1)).isin(".", "!", "?")})
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    rows = rows.withColumn("same", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    firsts = rows.filter("not absent and not is_blank").groupBy("conv_id", "same").agg(F.min(place).alias("begins"), F.max(place).alias("ends")).filter("begins < ends")
    firsts = small(firsts.select(F.col("conv_id").alias("of_conv"), F.col("same").alias("of_same"), "begins"), 200_000)
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("same") == F.col("of_same")), "left")
    return rows.withColumn("later", F.coalesce(F.col("begins") < place, F.lit(False))).drop("of_conv", "of_same", "begins", "same")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, part, no, report, lines: the repaired turns (role, text) of each conversation in chunks, in the order of part and no, and beside its last
    chunk its report: gaps, blank, duplicate, truncated, illegal (of the turns as they came), cost, audit.

    rows: conv_id, turn, role, text, and absent, which marks rows that only name a conversation. Turns go by `turn` (nulls first), then role and
    text; a null role or text is one space, and rows with a null conv_id are a conversation. Equal rows are duplicates of one another. A
    conversation without turns has one chunk without lines and a report of zeros. No rows give no rows; other columns are ignored.
    """
    spark, key = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns_with_faults(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), "absent"))
    # The beginning of a text is enough to deal rows out, and keeps long texts out of the samples for it.
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    counted = ", ".join(f"{c} long" for c in _COUNTED)
    schema = f"conv_id {key}, part long, no long, whole boolean, codes string, opens string, closes string, {counted}, edges {EDGES}, report {REPORT}, lines {TURN_LIST}"
    folder = new_folder(spark, "segments")
    dealt.transform(in_batches, _cut, schema).write.parquet(folder)
    segments = spark.read.schema(schema).parquet(folder)
    done, open_ = segments.filter("whole"), segments.filter("not whole")

    narrow = open_.select("conv_id", "part", "no", "codes", "opens", "closes", *_COUNTED, "edges").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    slices = narrow.transform(in_batches, _solved, f"part long, no long, slice string, state int, report {REPORT}")
    parts = open_.select("conv_id", "part", "no", "codes", "lines").join(slices, ["part", "no"])
    names = ["conv_id", "part", "no", "report", "lines"]
    mended = parts.transform(in_batches, _applied, f"conv_id {key}, part long, no long, report {REPORT}, lines {TURN_LIST}")
    return done.select(*names, "whole").unionByName(mended.withColumn("whole", F.lit(False)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's digest from its sorted chunks, one after another."""
    schema = None
    now, state, begun = None, None, False
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv_id"), ("report", _REPORT), ("repaired_sha256", pa.string())])
        out = []
        for conv, report, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "report", "lines")), strict=True):
            if now is None or now[0] != conv:
                now, state, begun = (conv,), hashlib.sha256(), False
            for turn in lines:
                state.update(("\n" * begun + f"{turn['role']}:{turn['text']}").encode())
                begun = True
            if report is not None:
                out.append({"conv_id": conv, "report": report, "repaired_sha256": state.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def audited(chunks: DataFrame) -> DataFrame:
    """A row for each conversation of repair_conversations(): its report, and the SHA-256 of its repaired turns (`role:text`, a line feed between)."""
    key = chunks.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("lines", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = chunks.filter("whole").select("conv_id", "report", F.sha2(lines, 256).alias("repaired_sha256"))
    long = chunks.filter("not whole").select("conv_id", "part", "no", "report", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    long = long.transform(in_batches, _digests, f"conv_id {key}, report {REPORT}, repaired_sha256 string")
    return one.unionByName(long).select("conv_id", "report.*", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one row in twenty each dropped (absent), emptied, without its sentence ends, repeated, or given to the user, by a checksum of
    conversation and turn; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), "kind")
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("absent"), times.alias("copy")).drop("copy")
