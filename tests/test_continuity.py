import numpy as np

from chronoloom.operators import continuity


def test_levels(spark):
    beats = np.arange(0, 20, 0.5)
    assert continuity.correct_share(beats, beats) == 1.0
    rows = []
    cases = {"same": beats, "double": np.arange(0, 19.6, 0.25), "half": beats[::2], "off": beats[:-1] + 0.25, "other": np.arange(0, 20, 0.37), "one": beats[:1]}
    rows = [(name, float(t)) for name, times in cases.items() for t in times]
    ref = spark.createDataFrame([(name, float(t)) for name in cases for t in beats], "track_id string, t double")
    got = {r["track_id"]: r["amlt"] for r in continuity.continuity(ref, spark.createDataFrame(rows, "track_id string, t double"), ["track_id"]).collect()}
    assert {got[k] for k in ("same", "double", "half", "off")} == {1.0}
    assert got["other"] < 0.5 and got["one"] == 0.0


def test_windows_equal_whole_tracks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sides = {0: [], 1: []}
    for track in range(30):
        beats = np.round(np.cumsum(rng.uniform(0.4, 0.6, rng.integers(0, 25))), 1)
        other = np.round(np.sort(np.concatenate([beats[rng.random(len(beats)) < 0.9] + rng.normal(0, 0.03), rng.uniform(0, 12, rng.integers(0, 3))])), 1)
        if track % 3 == 0:
            beats = np.sort(np.concatenate([beats, beats[:3]]))
        sides[0] += [(track, float(t)) for t in beats]
        sides[1] += [(track, float(t)) for t in other]
    ref, est = (spark.createDataFrame(sides[s], "track_id int, t double") for s in (0, 1))
    # No track may go to a Python group.
    monkeypatch.setattr(type(ref.groupBy("track_id")), "applyInPandas", None)
    got = {r["track_id"]: r["amlt"] for r in continuity.continuity(ref, est, ["track_id"]).collect()}
    times = lambda s, k: np.array(sorted(t for i, t in sides[s] if i == k))
    want = {k: max(continuity.correct_share(x, times(1, k)) for x in continuity.levels(times(0, k))) for k in {i for s in (0, 1) for i, _ in sides[s]}}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert len(set(want.values())) > 5
