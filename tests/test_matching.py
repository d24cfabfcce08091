"""Matching by maps that compose, against the plain walk over both lists; blocks change nothing."""

import random

import numpy as np
import pytest

from chronoloom.operators import matching, validate

KEY = ["k"]


def walked(refs, ests, tolerance):
    """Every reference in turn takes the first free estimate in reach."""
    refs, ests, j, hits = sorted(refs), sorted(ests), 0, 0
    for r in refs:
        while j < len(ests) and ests[j] < r - tolerance:
            j += 1
        if j < len(ests) and ests[j] <= r + tolerance:
            j, hits = j + 1, hits + 1
    return hits


def tracks(seed, tolerance):
    rng = random.Random(seed)
    found = {f"t{i}": ([rng.randrange(10 * (i + 1)) for _ in range(rng.randrange(40))], [rng.randrange(10 * (i + 1)) for _ in range(rng.randrange(40))]) for i in range(12)}
    found["island"] = ([rng.randrange(4000) for _ in range(3000)], [rng.randrange(1000, 5000) for _ in range(2500)])  # one island
    found["steps"] = ([tolerance * i for i in range(200)], [tolerance * i + tolerance for i in range(200)])  # every match at the limit
    found[None] = ([1, 1, 1, 2], [1, 3, -5])
    return found


@pytest.mark.parametrize("tolerance, block", [(3, None), (3, 3), (3, 1000), (0, 1), (0, None), (7, 20), (50, 50), (50, None)])
def test_equals_the_walk(spark, tolerance, block):
    found = tracks(tolerance, tolerance)
    side = lambda s: spark.createDataFrame([(k, t) for k, v in found.items() for t in v[s]] + [("t1", None)], "k string, t long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # stretches go on from batch to batch
    try:
        got = {r["k"]: (r["hits"], r["n_ref"], r["n_est"]) for r in validate.beat_agreement(side(0), side(1), KEY, tolerance, -100, block).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (walked(*v, tolerance), len(v[0]), len(v[1])) for k, v in found.items() if v[0] or v[1]}


def test_an_island_is_spread(spark):
    """One track without any gap: its rows stand in many blocks, few of them twice."""
    side = lambda s: spark.range(20_000).selectExpr("'k' AS k", f"id * 2 + {s} AS t", f"{s} AS side")
    both = side(0).union(side(1))
    sizes = [r["count"] for r in matching._cut(both, KEY, 3, 100).groupBy("k", "block").count().collect()]
    assert len(sizes) == 401 and max(sizes) <= 103 and sum(sizes) <= 1.03 * 40_000
    r = matching.matched(both, KEY, 3, 100).first()
    assert (r["hits"], r["n_ref"], r["n_est"]) == (20_000, 20_000, 20_000)


def test_maps_compose_in_any_grouping():
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(0, 300, 400))
    side = rng.integers(0, 2, 400)
    order = np.lexsort((side, t))
    steps = matching._steps(t[order], side[order], np.arange(400) == 0, 5)
    whole = matching._folded(steps, np.zeros(400, int))[0]
    for cut in (1, 7, 200, 399):
        parts = [matching._folded(tuple(s[a:b] for s in steps), np.zeros(b - a, int))[0] for a, b in ((0, cut), (cut, 400))]
        joined = matching._then(*parts)
        for x in range(-6, 7):
            end = lambda m: (int(np.clip(x + m[0], m[1], m[2])[0]), int((m[3] + np.maximum(0, m[4] - x))[0]))  # noqa: E731, B023
            assert end(joined) == end(whole)


def test_empty(spark):
    none = spark.createDataFrame([], "k string, t long")
    assert validate.beat_agreement(none, none, KEY, block=5).count() == 0
