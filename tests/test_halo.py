"""Windows with context: stitched frames equal those of the whole sequence."""

import numpy as np
import pytest

from chronoloom.operators import halo


def smoother(radius=4, stride=1):
    """A filter of so many samples to either side, zeros beyond the ends, one frame a stride."""

    def smooth(table):
        padded = np.pad(table, ((0, 0), (radius, radius)))
        return sum((k + 1) * padded[:, k : k + table.shape[1]] for k in range(2 * radius + 1))[:, ::stride]

    return smooth


@pytest.mark.parametrize("window, context, stride", [(10, 4, 1), (10, 6, 2), (64, 4, 4), (4, 8, 2)])
def test_equals_the_whole_sequence(spark, window, context, stride):
    rng = np.random.default_rng(window)
    series = {"a": rng.integers(0, 9, 103), "b": rng.integers(0, 9, 10), "c": rng.integers(0, 9, 1)}
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v) if x]  # zeros are absent
    lengths = spark.createDataFrame([(k, len(v)) for k, v in series.items()] + [("empty", 0), ("silent", 7)], "k string, n long")
    samples = spark.createDataFrame(rows, "k string, i long, x double").repartition(3)
    got = halo.stitched(samples, ["k"], smoother(4, stride), window, context, stride, lengths, batch=2).collect()
    want = {(k, f): x for k, v in (series | {"silent": np.zeros(7)}).items() for f, x in enumerate(smoother(4, stride)(v[None].astype(float))[0])}
    assert {(r["k"], r["frame"]): r["value"] for r in got} == want and len(got) == len(want)


def test_too_little_context_shows_at_seams(spark):
    samples = spark.createDataFrame([("a", i, 1.0) for i in range(40)], "k string, i long, x double")
    got = {r["frame"]: r["value"] for r in halo.stitched(samples, ["k"], smoother(), 10, 2).collect()}
    whole = smoother()(np.ones((1, 40)))[0]
    assert got.keys() == set(range(40)) and [f for f in range(10, 30) if got[f] != whole[f]] == [10, 11, 18, 19, 20, 21, 28, 29]


def test_wrong_use(spark):
    samples = spark.createDataFrame([("a", 0, 1.0)], "k string, i long, x double")
    with pytest.raises(ValueError, match="multiples"):
        halo.stitched(samples, ["k"], smoother(), 10, 3, 2)
    with pytest.raises(Exception, match="frames for"):
        halo.stitched(samples, ["k"], lambda t: t[:, 1:], 10, 3).collect()
    assert halo.stitched(samples.limit(0), ["k"], smoother(), 10, 4).count() == 0
