"""Hard negatives against plain Python, with ties, copies, odd vectors and blocks that fall away."""

from itertools import product

import numpy as np
import pytest

from cuewright.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, block string, rank string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out, asked = [], {}
    for i, v, label in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, (label, len(v), v)), (label, len(v), v))
    for i, (label, n, v) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in good if j != i and len(w) == n)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(q, k) for q, k, other in scored if other != label and 80 * -p <= 100 * -q <= 100 * -p][:5]
            out += [(i, j, rank, k, -p, -q) for rank, (q, k) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, every=100):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.hard_negatives(table, every).collect())


@pytest.mark.parametrize("bits", [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_goes_from_neighbour_to_neighbour(bits):
    cells = np.array(list(product(range(1 << bits[1]), repeat=bits[0])))
    keys = [k.tobytes() for k in negatives.hilbert(cells, bits[1])]
    order = np.argsort(np.array(keys, dtype=object))
    assert len(set(keys)) == len(cells) and set(np.abs(np.diff(cells[order], axis=0)).sum(axis=1)) == {1}


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], int(i % 4)) for i in range(600)]
    rows += [(1000 + i, [0.25] * 6, int(i % 3)) for i in range(1500)]
    rows += [(3000, None, 1), (3001, [0.5] * 6, None), (3002, [0.5, None] * 3, 1), (3003, [float("nan")] * 6, 1), (3004, [float("inf")] * 6, 1), (None, [0.5] * 6, 1), (3100, [], 2), (3101, [], 2), (3102, [], 1), (3200, [1.0, 2.0], 9), (3201, [1.0, 2.0], 9), (3203, [1.0, 1.75], 8), (-100, [0.5] * 6, 3), (3300, [3e38, 0.0], 9)]
    got = found(spark, rows)
    assert [r for r in got if r[0] != 3300 and 3300 not in (r[1], r[3])] == plain([r for r in rows if r[0] != 3300])
    assert found(spark, []) == []


def test_windows_and_repeated_rows(spark):
    rng = np.random.default_rng(14)
    rows = [(i, [float(x) for x in rng.normal(size=5)], int(rng.integers(3))) for i in range(400)]
    rows += [rows[1], rows[2]] + [(0, rows[0][1], rows[0][2])]
    assert found(spark, rows, 10) == plain(rows, 10)


def test_zone_maps_leave_blocks_out(spark, tmp_path):
    """Two far clusters: an anchor reads none of the blocks whose scores cannot reach its windows, and loses nothing."""
    rng = np.random.default_rng(15)
    rows = [(i, [float(x) for x in rng.normal(10.0 * (i % 2), 0.1, 4) * ((-1) ** (i % 3 == 0))], int(i % 5)) for i in range(6000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    blocks = negatives.write_blocks(negatives.usable(table), str(tmp_path / "blocks"))
    anchors = blocks.transform(negatives.in_batches, negatives._home(100, 5), negatives._ANCHOR)
    read = []
    for r in blocks.collect():
        low, high = np.array(r["low"]), np.array(r["high"])
        x = negatives._vectors(r["kind"], r["vectors"], r["n"], r["dimension"])
        assert (x.min(axis=0) == low).all() and (x.max(axis=0) == high).all() and r["n"] <= negatives.BLOCK_ROWS
        for a in anchors.collect():
            v = np.frombuffer(a["vector"])
            top, bottom = (np.maximum(v, 0) @ p + np.minimum(v, 0) @ q for p, q in ((high, low), (low, high)))
            assert bottom - 1e-6 <= (x @ v).min() and (x @ v).max() <= top + 1e-6
            floor = min((p["score"] for p in a["positives"]), default=0)
            read.append(top >= 0.8 * floor)
    assert 0 < np.mean(read) < 0.8
    assert found(spark, rows) == plain(rows)
