import math
import random

import numpy as np
import pytest

from chronoloom.llm import topk

VECTOR = "vec_id long, embedding array<float>, label int"


def slow(rows, every=50, k=5):
    """All pairs; rows: (vec_id, list)."""
    taken = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in taken:
        if i is not None and i % every == 0:
            scores = sorted(((sum(a * b for a, b in zip(q, v)), j) for m, j, v in taken if m != n and len(v) == len(q)), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def vectors(seed, n, dims, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR)
    return sorted((tuple(r) for r in topk.search(df.repartition(3), **more).collect()), key=repr)


@pytest.mark.parametrize("dims, block, group", [(16, 3072, 1024), (7, 50, 2), (1, 64, 3)])
def test_equals_brute_force(spark, monkeypatch, dims, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", group)
    rows = vectors(dims, 400, dims)
    assert result(spark, rows) == slow(rows)


def test_a_third_are_one_vector(spark, monkeypatch):
    """Boundaries of equal scores go by id, over blocks as well."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    rows = vectors(2, 200, 5)
    rows[50:150] = [(i, rows[50][1]) for i, _ in rows[50:150]]
    assert result(spark, rows, every=10) == slow(rows, every=10)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = vectors(4, 60, 3) + [(None, [0.9, 0.9, 0.9]), (50, [0.1, 0.2, 0.3]), (50, [0.1, 0.2, 0.3]), (100, None), (150, [1.0, None, 0.0]), (200, [nan, 0.0, 0.0])]
    rows += [(250, [inf, 0.0, 0.0]), (300, []), (350, []), (400, [1.0, 2.0]), (450, [3e6, -3e6, 0.5]), (7, [1e6, -1e6, 1.0])]
    assert result(spark, rows) == slow(rows)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR).selectExpr("*", "1 AS row", "2 AS block", "3 AS values", "4 AS score", "5 AS dims", "6 AS part")
    assert sorted((tuple(r) for r in topk.search(df).collect()), key=repr) == slow(rows)
    assert topk.search(df.limit(0)).count() == 0
    assert result(spark, [(50, [1.0, 2.0])]) == []


def test_slices_of_sums():
    rng = np.random.default_rng(0)
    values, queries = rng.integers(-300, 300, (130, 9)), rng.integers(-200, 200, (5, 9))
    low, digits, slices = topk.sliced(values)
    table = np.concatenate([slices.reshape(-1, slices.shape[-1]), ~slices.reshape(-1, slices.shape[-1]), np.zeros((1, slices.shape[-1]), np.uint64)])
    sums = topk.added(table, topk.weighted(queries, digits))
    got = sum(np.unpackbits(d.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64) << w for w, d in enumerate(sums) if d is not None)
    assert (got == np.abs(queries) @ (values - low).T + np.where(queries < 0, queries, 0) @ (2 * (values - low) - (1 << digits) + 1).T).all()
    q, row, score = topk.best_of_block(queries, np.array([3, -1, 129, 0, -1]), 130, low, digits, slices, 4)
    assert (score == (queries @ values.T)[q, row]).all() and len(q) == 20
