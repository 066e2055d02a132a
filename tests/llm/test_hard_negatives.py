"""Hard negatives against brute force and SQL; the tree against a full scan."""

import math

import numpy as np
from pyspark.sql import functions as F

from sessionlens.llm import hard_negatives as op
from sessionlens.llm.hard_negatives import OP13_SQL, Tree, hard_negatives, op13_hard_negatives, str_order

from ..helpers import duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<double>, label int, shard long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v") for i, v, label in rows], SCHEMA)


def brute(rows, positives=5, negatives=3):
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) <= 2**18 for x in v)]
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, other) for b, (j, w, other) in enumerate(ok) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def mined(spark, rows, **more):
    return found(hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, **more))


def test_query_equals_sql(spark, small):
    assert spark_rows(op13_hard_negatives(spark, small)) == duck_rows(OP13_SQL, small)


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    """Small shards, blocks and leaves; clusters, ties, repeated rows and a label of half of the rows."""
    for name, n in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 3), ("LEAF", 4), ("FANOUT", 3)):
        monkeypatch.setattr(op, name, n)
    rng = np.random.default_rng(3)
    rows = [(k, (np.round(rng.normal(size=4) * 4 + 3 * (k % 5)) / 256).tolist(), int(rng.choice([0, 0, 0, 1, 2]))) for k in range(700)]
    rows += [rows[50], rows[50], rows[100], rows[7]] + [(2000 + k, rows[3][1], 1) for k in range(80)]
    rows += [(50, rows[9][1], 1), (-100, rows[11][1], 0)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 150


def test_rows_without_part_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25]
    rows = [(0, v, 1), (1, v, 1), (2, [0.4, 0.2], 2), (3, None, 1), (4, [0.4, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (None, [0.4, 0.2], 2), (8, [0.4, 0.2], None), (9, [0.4, 0.2, 0.1], 2), (50, [], 1), (51, [], 1), (52, [], 2), (100, [0.5], 3), (150, [-1.0, 0.0], 4), (151, [1.0, 0.0], 4), (10, [1e30, 0.0], 2)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert (0, 1, 1, 2, 128 * 128 + 64 * 64, 128 * 102 + 64 * 51) in got
    assert (50, 51, 1, 52, 0, 0) in got  # all products are 0, so is the window


def test_no_anchors_and_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert mined(spark, [(0, [1.0], 0)]) == []


def test_large_components_stay_exact(spark):
    big = 2.0**17
    rows = [(0, [big, 1.0], 0), (1, [big, 1 / 256], 0), (2, [big - 1 / 256, 0.0], 0), (3, [0.9 * big, 0.0], 1), (4, [0.9 * big, 1 / 256], 1), (5, [0.9 * big, -1 / 256], 1), (6, [big, 0.5], 1)]
    rows = [(i, v * 8, label) for i, v, label in rows]
    got = mined(spark, rows)
    assert got == brute(rows) and max(r[4] for r in got) > 2**53


def test_tree_bounds_and_pruning(monkeypatch):
    monkeypatch.setattr(op, "LEAF", 8)
    monkeypatch.setattr(op, "FANOUT", 4)
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 3))
    v = (centres[rng.integers(0, 20, 900)] + rng.integers(-3, 4, (900, 3))).astype(np.int64)
    ids = rng.permutation(900).astype(np.int64)
    order, starts = str_order(v, ids)
    assert sorted(order.tolist()) == list(range(900)) and max(np.diff([*starts, 900])) <= 8
    tree = Tree(ids[order], v[order], np.array(starts))
    visits = []
    monkeypatch.setattr(Tree, "inside", staticmethod(lambda s, a, b, own=Tree.inside: visits.append(len(s)) or own(s, a, b)))
    for a in v[:30]:
        least, most = tree.bounds(a[None])
        scores = tree.v @ a
        for leaf, (s, e) in enumerate(zip(tree.starts, tree.ends, strict=True)):
            at = tree.base[-2] + leaf
            assert least[0, at] <= scores[s:e].min() and scores[s:e].max() <= most[0, at]
        windows = [(-op.FAR, op.FAR), (100, 5000), (7000, 7100)]
        for (low, high), got in zip(windows, tree.search(a, least[0].tolist(), most[0].tolist(), windows, 3), strict=True):
            assert [x[:2] for x in got] == sorted((-int(s), int(i)) for s, i in zip(scores, tree.ids, strict=True) if low <= s <= high)[:3]
    assert sum(visits) < 30 * 900 / 2  # most leaves are never scored
