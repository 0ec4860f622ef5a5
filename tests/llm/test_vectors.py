"""op11 and op12 against brute force over all pairs, with the edge cases that their docstrings state."""

import math

import numpy as np
import pytest

from quarry.llm import crosspoly, hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, page int, rank string"


def table(spark, rows):
    """Extra columns have the names that the operators use inside."""
    return spark.createDataFrame([(i, v, c, 7, "x") for i, v, c in rows], SCHEMA)


def some_rows(n, dims=16, seed=0, start=0):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(start + i, [float(v) for v in x[i]], int(i * 7919 % 10)) for i in range(n)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    kept = [(i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows if i is not None and c is not None and fine(v)]
    out = []
    for a, y, c in sorted(kept):
        if a % 100:
            continue
        scores = [(-sum(p * q for p, q in zip(y, z)), i, d == c) for i, z, d in kept if i != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:5]:
            near = sorted(x for x in scores if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(near[:10], 1)]
    return sorted(out)


def brute_nearest(rows, k=5, every=50):
    kept = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and fine(v) and any(v)]
    out = {}
    for a, x in kept:
        if a % every == 0:
            cos = sorted((-(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)), i) for i, y in kept if i != a and len(x) == len(y))
            out[a] = [(i, -c) for c, i in cos[:k]]
    return out


ODD = [
    (None, [0.5] * 16, 1),
    (9001, None, 1),
    (9002, [0.5] * 15 + [None], 2),
    (9003, [0.5] * 15 + [float("nan")], 2),
    (9004, [0.5] * 15 + [float("inf")], 2),
    (9005, [0.25] * 16, None),
    (9006, [0.0] * 16, 3),
    (9007, [], 4),
]


@pytest.mark.parametrize("copies", [0, 400])
def test_hard_negatives_equal_brute_force(spark, copies):
    """With copies, one vector is held by a third of the rows, and ties go to the smaller id."""
    rows = some_rows(900) + [(2000 + i, some_rows(3)[2][1], i % 4) for i in range(copies)] + ODD
    got = sorted(map(tuple, hardneg.mine_negatives(table(spark, rows).repartition(5)).collect()))
    assert got == brute_negatives(rows) and got


def test_hard_negatives_by_many_cells_of_the_grid(spark, monkeypatch):
    for name, value in (("SLICE_PAGES", 2), ("ANCHOR_GROUP", 3)):
        monkeypatch.setattr(hardneg, name, value)
    rows = some_rows(1200, 7, 3)
    assert sorted(map(tuple, hardneg.mine_negatives(table(spark, rows).repartition(20)).collect())) == brute_negatives(rows)


def test_hard_negatives_of_repeated_rows_and_unequal_lengths(spark):
    rows = some_rows(300, 8, 5)
    short = [(500 + i, v[:5], c) for i, v, c in some_rows(60, 8, 6)]
    want = brute_negatives(rows + [(i, v + [0.0] * 3, c) for i, v, c in short])
    assert sorted(map(tuple, hardneg.mine_negatives(table(spark, rows + rows[:50] + short)).collect())) == want


def test_hard_negatives_of_nothing(spark):
    assert hardneg.mine_negatives(table(spark, [])).collect() == []
    assert hardneg.mine_negatives(table(spark, [(0, [1.0, 0.0], 1)])).collect() == []
    assert hardneg.mine_negatives(table(spark, [(0, [1.0], 1), (1, [1.0], 1)])).collect() == []


def test_bounds_hold_and_large_components_saturate(spark):
    x = hardneg.quantised(np.random.default_rng(2).normal(size=(200, 6)) * np.array([1, 10, 1e3, 1e9, 1e30, 0]))
    codes, cells = hardneg.cells_of(x)
    packed = (codes[:, 0::2] * hardneg.CELLS + codes[:, 1::2]).T
    kept = {"ids": np.arange(200), "labels": np.zeros(200, np.int64), "codes": np.ascontiguousarray(packed), "cells": cells.astype(np.int32), "vectors": x.astype(np.int32)}
    page = hardneg.Page({"n": 200, "wide": 6} | {k: v.tobytes() for k, v in kept.items()})
    low, high = page.bounds(x[:20])
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= high).all() and abs(x).max() == hardneg.LIMIT
    assert (page.scores(x[3], np.arange(200)) == exact[3]).all()


def recall(found, want):
    have = {(r.query_id, r.vec_id) for r in found}
    pairs = {(q, i) for q, near in want.items() for i, _ in near}
    return len(have & pairs) / len(pairs)


@pytest.mark.parametrize("n,dims", [(400, 64), (1500, 24)])
def test_nearest_recall_and_exact_scores(spark, n, dims):
    rows = some_rows(n, dims, 11)
    found = crosspoly.nearest(table(spark, rows)).collect()
    want, vector = brute_nearest(rows), {i: np.array(v, np.float64) for i, v, _ in rows}
    assert recall(found, want) >= 0.9
    assert len(found) == 5 * len(want) and {r["rank"] for r in found} == {1, 2, 3, 4, 5}
    for r in found:
        x, y = vector[r.query_id], vector[r.vec_id]
        assert abs(r.score - x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) < 1e-12
    by_rank = sorted((r.query_id, r["rank"], r.score) for r in found)
    assert all(a[0] != b[0] or a[2] >= b[2] for a, b in zip(by_rank, by_rank[1:]))


def test_nearest_is_exact_when_all_buckets_are_probed(spark, monkeypatch):
    """Small slices, ties of a third of all rows, and rows that take no part; nothing may be lost or found twice."""
    monkeypatch.setattr(crosspoly, "SLICE", 16)
    monkeypatch.setattr(crosspoly, "QUERY_SLICE", 3)
    monkeypatch.setattr(crosspoly, "PROBES", 32)
    rows = some_rows(300, 16, 4) + [(1000 + i, some_rows(5, 16, 4)[4][1], 0) for i in range(150)] + [(2000 + i, [2 * x for x in some_rows(5, 16, 4)[4][1]], 0) for i in range(50)] + ODD
    found = crosspoly.nearest(table(spark, rows + rows[:40])).collect()
    want = brute_nearest(rows)
    got = {q: sorted((r["rank"], r.vec_id) for r in found if r.query_id == q) for q in want}
    assert {r.query_id for r in found} == set(want)
    for q, near in want.items():
        scores = [round(c, 9) for _, c in near]
        ids = [i for _, i in sorted(zip(scores, [i for i, _ in near]), key=lambda x: (-x[0], x[1]))]
        if q in (1000, 1050, 1100, 2000):  # a copy's nearest: other copies, and their doubles, of equal cosine but for rounding
            assert all(r.score > 1 - 1e-12 for r in found if r.query_id == q) and len(got[q]) == 5
        else:
            assert [i for _, i in got[q]] == ids


def test_nearest_with_few_candidates_and_lengths_apart(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0), (50, [1.0, 2.0, 3.0], 0), (51, [1.0, 2.0, 2.0], 0)]
    found = {q: [i for _, i in sorted((r["rank"], r.vec_id) for r in crosspoly.nearest(table(spark, rows)).collect() if r.query_id == q)] for q in (0, 50)}
    assert found == {0: [1, 2], 50: [51]}
    assert crosspoly.nearest(table(spark, rows[:1])).collect() == [] and crosspoly.nearest(table(spark, [])).collect() == []


def test_nearest_of_very_large_and_small_components(spark):
    rows = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [3.0, 3.0])], "vec_id long, embedding array<double>")
    found = [(r.vec_id, round(r.score, 9)) for r in crosspoly.nearest(rows).orderBy("rank").collect()]
    assert found == [(2, 1.0), (1, round(3 / math.sqrt(10), 9))]


def test_two_polytopes_rank_buckets_by_both():
    unit = crosspoly.unit_rows(np.random.default_rng(0).normal(size=(30, 8)))
    first, second = crosspoly.turned(unit, 0, 0), crosspoly.turned(unit, 0, 1)
    found = crosspoly.nearest_axes(unit, 0, 5, polytopes=2)
    both = np.concatenate([first, -first], 1)[:, :, None] + np.concatenate([second, -second], 1)[:, None, :]
    best = -np.sort(-both.reshape(30, -1), axis=1)[:, :5]
    assert np.allclose(np.take_along_axis(both.reshape(30, -1), found, 1), best)
    assert all(len(set(row)) == 5 for row in found.tolist())


def test_pseudo_rotations_keep_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(10, 13))
    y = crosspoly.turned(x, 3, 0)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(y[:, :13], x)
    for n in (1, 2, 8):
        h = crosspoly.hadamard(np.eye(n))
        assert (h == [[(-1) ** bin(i & j).count("1") for j in range(n)] for i in range(n)]).all()
