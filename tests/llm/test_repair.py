"""Conversation repair against a table over all layers, and whole tables against plain Python."""

import hashlib
import random
from itertools import product

import pytest

from cuewright.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, absent boolean, part string, report int"
SPACES = " \t\n\v\f\r"


def layered(codes):
    """(cost, audit) by least ways to each state of each layer."""

    def opened(best):
        for _ in range(4):
            for g, h, cost, name in repair.INSERTIONS:
                if g in best:
                    way = best[g][0] + cost, best[g][1] + name
                    best[h] = min(best.get(h, way), way)
        return best

    best = opened({0: (0, "")})
    for code in codes:
        new = {}
        for g, h, cost, name in repair.edges(code):
            if g in best:
                way = best[g][0] + cost, best[g][1] + name
                new[h] = min(new.get(h, way), way)
        best = opened(new)
    return min(best[g] for g in (0, 3) if g in best)


def plain(rows):
    """What the query returns for rows of (conv_id, turn, role, text, absent)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, gone in rows if c == conv and not gone]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen, count = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            said = text.strip(SPACES)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = layered(codes)
        lines, at, state = [], 0, "a"
        for edit in audit:
            role, text = own[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = role[0]
            elif edit != "D":
                state = "a" if state == "u" else "u"
                lines.append(("user:" if state == "u" else "assistant:") + text)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = repair.audited(repair.repair_conversations(table)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


def test_every_short_conversation_and_many_longer_ones():
    for n in range(4):
        for codes in product("xsuaoSUAO", repeat=n):
            assert repair.solve("".join(codes)) == layered(codes)
    rng = random.Random(12)
    for _ in range(1500):
        codes = "".join(rng.choice("xsuaoSUAO" if rng.random() < 0.5 else "ua") for _ in range(rng.randint(4, 40)))
        assert repair.solve(codes) == layered(codes)


def test_segments_are_the_whole():
    rng = random.Random(13)
    for _ in range(200):
        codes = "".join(rng.choice("xsuaoUAua") for _ in range(rng.randint(1, 60)))
        ends = [0, *sorted(rng.sample(range(len(codes) + 1), min(len(codes), rng.choice((1, 20))))), len(codes)]
        parts = [repair.reduction(codes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        assert repair.solve_segments(parts) == layered(codes)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi.", False), (1, 1, "assistant", "Hello", False), (1, 1, "assistant", "Hello", False), (1, 4, "user", "Hi.", False),
        (2, None, None, None, False), (2, None, "system", "Be kind.", False), (2, 3, "tool", "x!\t\n", False), (2, 3, "", "y?", False),
        (None, 0, "assistant", "Yes.", False), (None, 7, "user", "é" * 10 + "…", False), (3, 0, "user", "gone", True), (3, 1, "user", "gone", True),
        (4, 5, "user", "\v\f", False), (5, None, "user", "a.", False), (5, None, "assistant", "b.", False), (6, 1, "system", "s.", False), (7, 1, "user", "word " * 400_000 + ".", False), (7, 2, "assistant", "ok.", False),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[::-1]) == plain(rows)
    assert found(spark, []) == {}


@pytest.mark.parametrize("hot", [700, 3000])
def test_a_conversation_over_many_segments(spark, hot):
    rng = random.Random(hot)
    rows = [(9, t // 2 * 2 if t % 50 == 0 else t, rng.choice(("user", "assistant", "user", "assistant", "system", "tool")), rng.choice(("a.", f"b{t}.", f"c{t}!", f"d{t}", " ")), False) for t in range(hot)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"t{c}.{t}.", False) for c in range(8, 60) if c != 9 for t in range(4)]
    assert found(spark, rows) == plain(rows)


def test_chunks_hold_the_repaired_turns(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "B.", False, "x", 1), (1, 1, "user", "A", False, "x", 1), (1, 2, "assistant", " ", False, "x", 1)], SCHEMA)
    rows = repair.repair_conversations(table).collect()
    turns = [(t["role"], t["text"]) for r in sorted(rows, key=lambda r: (r["part"], r["no"])) for t in r["lines"]]
    cost, audit = layered("aUx")
    assert [r["report"]["audit"] for r in rows if r["report"]] == [audit] and cost == rows[-1]["report"]["cost"]
    assert [role for role, _ in turns] == ["user", "assistant"] * (len(turns) // 2)
