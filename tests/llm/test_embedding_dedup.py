"""Embedding near-dedup against brute force: cells, parts, edges."""

import numpy as np
import pytest

from sessionlens.llm import embedding_dedup as op
from sessionlens.llm.embedding_dedup import OP12_SQL, near_groups, op12_embedding_dedup

from ..helpers import duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "k", 3, "v") for i, v, label in rows], SCHEMA)


def brute(rows, threshold=0.98):
    """By all pairs, in float64 from float32 components."""
    unit, where = [], []
    for k, (_, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        unit.append(x / np.linalg.norm(x))
        where.append(k)
    links = {k: set() for k in range(len(rows))}
    for p, a in enumerate(where):
        for q, b in enumerate(where):
            if p != q and rows[a][2] == rows[b][2] and len(unit[p]) == len(unit[q]) and unit[p] @ unit[q] >= threshold:
                links[a].add(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[k][0], len(links[k]), low, rows[k][0] == low))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, small):
    assert spark_rows(op12_embedding_dedup(spark, small)) == duck_rows(OP12_SQL, small)


def test_many_cells_and_parts_lose_no_link(spark, monkeypatch):
    """Near copies on the borders of many small cells, dealt into parts of eight rows."""
    monkeypatch.setattr(op, "CELL_ROWS", 12)
    monkeypatch.setattr(op, "PART_ROWS", 8)
    monkeypatch.setattr(op, "BLOCK", 3)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6))
    rows = []
    for k in range(400):
        v = base[k % 60] / np.linalg.norm(base[k % 60]) + rng.normal(size=6) * rng.choice([0.02, 0.05, 0.09])
        rows.append((int(k), (v * rng.uniform(0.1, 9)).tolist(), int(k % 3 == 0)))
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(30)] + [(7, rows[7][1], rows[7][2])]  # copies, one with the same id
    got = found(near_groups(frame(spark, rows)))
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 1000 and len({r[2] for r in got}) > 40


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(op, "CELL_ROWS", 10)
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-2, 3, 3).tolist(), 0) for k in range(150)]
    rows = [r for r in rows if any(r[1])]
    if threshold == 1.0:  # rounding decides which parallel vectors reach exactly 1
        rows = [(k, [1.0, 0.0, 0.0] if k % 2 else [0.0, 1.0, 0.0], 0) for k in range(20)]
    margin = lambda t: brute(rows, t)
    got = found(near_groups(frame(spark, rows), threshold))
    assert got in (margin(threshold), margin(threshold - 1e-9), margin(threshold + 1e-9))


def test_rows_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0]
    rows = [(1, v, 0), (2, v, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, v, 1), (10, [1.0, 2.0, 0.0], 0), (11, [2.0, 4.0], 0), (None, v, 0), (None, [5.0, -1.0], 0)]
    got = found(near_groups(frame(spark, rows)))
    assert got == brute(rows)
    assert (1, 2, 1, True) in got and (11, 2, 1, False) in got and (None, 2, 1, False) in got and (None, 0, None, True) in got
    assert all(r[1] == 0 and r[3] for r in got if r[0] in range(2, 11))


def test_empty_table(spark):
    df = near_groups(frame(spark, []))
    assert df.collect() == [] and df.columns == ["vec_id", "n_links", "component_id", "kept", "copies"]
