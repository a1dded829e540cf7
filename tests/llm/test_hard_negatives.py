"""Hard negatives against scoring everything; the tree's bounds against all distances."""

import math

import numpy as np
import pytest

from tutorlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def usable(rows):
    out = []
    for at, (vec_id, vec, label, *_) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        out.append((at, vec_id, label, [max(-hn.LIMIT, min(hn.LIMIT, math.floor(256 * float(np.float32(x))))) for x in vec]))
    return out


def brute(rows):
    rows, out = usable(rows), []
    for at, anchor, label, q in rows:
        if anchor is None or anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0, own, i) for k, i, own, v in rows if k != at)
        for p, _, _, _, positive in [s for s in scored if s[3] == label][:5]:
            fit = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(anchor, positive, r, s[4], -p, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, hn.mine(df, **sizes).collect()), key=str)


def clusters(seed, count, dim=6, centres=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dim))
    at = rng.integers(0, centres, count)
    x = centre[at] + rng.normal(scale=0.1, size=(count, dim))
    return [(i, x[i].tolist(), int(at[i]), 0.5, i) for i in range(count)]


SMALL = {"sample_rows": 200, "fanout": 3, "leaf_rows": 20, "piece_rows": 7}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scoring_everything(spark, seed):
    rows = clusters(seed, 520)
    got = mined(spark, rows, **SMALL)
    assert got == brute(rows) and got


def test_broken_rows_ties_repeats_and_short_vectors(spark):
    rows = clusters(3, 260)
    rows += [(700, None, 1, 0.0, 0), (800, [1.0, None], 1, 0.0, 0), (900, [math.nan] * 6, 2, 0.0, 0), (1000, [math.inf] * 6, 3, 0.0, 0),
             (1100, [1.0] * 6, None, 0.0, 0), (None, [0.5] * 6, 4, 0.0, 0), (None, [0.5] * 6, 5, 0.0, 0), (1200, [], 5, 0.0, 0),
             (1300, [2.0, -1.0], 5, 0.0, 0), (1400, [0.0] * 6, 6, 0.0, 0), (1500, [1e30, -1e30, 1.0], 6, 0.0, 0)]
    rows += [(100, rows[100][1], rows[100][2], 0.0, 0)] * 2 + [(3000 + i, rows[5][1], i % 3, 0.0, 0) for i in range(40)]
    assert mined(spark, rows, **SMALL) == brute(rows)


def test_a_third_of_the_rows_alike(spark):
    """Equal vectors share a leaf; its pieces stay small."""
    rows = clusters(4, 240) + [(1000 + i, [0.3] * 6, i % 4, 0.0, 0) for i in range(120)]
    assert mined(spark, rows, **SMALL) == brute(rows)
    index = hn.fit_index(hn.scaled_rows(spark.createDataFrame(rows, SCHEMA), hn.F.col("label")), **SMALL)
    sizes = [r["count"] for r in index.rows.groupBy("leaf", "piece").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 4 * SMALL["piece_rows"]


def test_subtrees_are_dropped_and_none_too_many(spark):
    rows = clusters(5, 600)
    table = hn.scaled_rows(spark.createDataFrame(rows, SCHEMA), hn.F.col("label"))
    index = hn.fit_index(table, **SMALL)
    data = index.rows.collect()
    q = np.array([r["vec"] for r in data[:40]])
    scores = q @ np.array([r["vec"] for r in data]).T
    best = np.sort(scores, axis=1)[:, -6]
    windows = [[(int(b), hn.LAST), (int(b) // 2, int(b) // 2 + 500)] for b in best]
    looked = {(leaf, i) for leaf, own in hn.reachable(index.nodes, q, windows) for i in own.tolist()}
    assert len(looked) < 0.7 * len(index.pieces) * len(q)
    for i, s in enumerate(scores):
        for r, score in zip(data, s.tolist()):
            if any(a <= score <= b for a, b in windows[i]):
                assert (r["leaf"], i) in looked


def test_large_components_stay_exact():
    a = np.array([[hn.LIMIT, -hn.LIMIT, 3], [1, 2, hn.LIMIT]])
    assert hn.products(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in a] for p in a]


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 2, 0.0, 0)]) == []
