"""Beat continuity at any metrical level (A9): the share of beats in phase and at the period of the reference, of its off-beats, its double or its half tempo."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

TOLERANCE = 0.175


def levels(reference: np.ndarray) -> list[np.ndarray]:
    """The reference's beats, its off-beats, double tempo, and half tempo from the first and from the second beat."""
    if len(reference) < 2:
        return [reference]
    between = (reference[:-1] + reference[1:]) / 2
    return [reference, between, np.sort(np.concatenate([reference, between])), reference[::2], reference[1::2]]


def correct_share(reference: np.ndarray, estimate: np.ndarray, tolerance: float = TOLERANCE) -> float:
    """Estimated beats near an unused reference beat and as far from their neighbour as it is from its own, over the longer side's number."""
    if len(reference) < 2 or len(estimate) < 2:
        return 0.0
    right = np.clip(np.searchsorted(reference, estimate), 1, len(reference) - 1)
    nearest = np.where(estimate - reference[right - 1] <= reference[right] - estimate, right - 1, right)
    steps = np.diff(reference)
    step = np.where(nearest > 0, steps[np.maximum(nearest - 1, 0)], steps[0])
    own = np.diff(estimate)
    own = np.concatenate([own[:1], own])
    good = (np.abs(estimate - reference[nearest]) < tolerance * step) & (np.abs(1 - own / step) < tolerance)
    return len(np.unique(nearest[good])) / max(len(reference), len(estimate))


def _levelled(reference: DataFrame, key: list[str], block: int | None) -> DataFrame:
    """key, level, t, n (place), step (to the beat before, of the first to the next) of all levels' beats, as in ``levels``."""
    beats = blocks.numbered(blocks.with_block(reference, "t", block), key, ["t"], "n")
    for before, of in (("b1", "t"), ("b2", "b1")):
        beats = blocks.lagged(beats, key, ["t", "n"], {before: of})
    for after, of in (("a1", "t"), ("a2", "a1")):
        beats = blocks.led(beats, key, ["t", "n"], {after: of})
    t, n, b1, b2, a1, a2 = (F.col(c) for c in ("t", "n", "b1", "b2", "a1", "a2"))
    between = (t + a1) / 2

    def beat(level, time, place, before, after):
        step = F.coalesce(time - before, after - time)
        return F.struct(F.when(time.isNotNull(), level).alias("level"), time.alias("t"), place.cast("long").alias("n"), step.alias("step"))

    found = F.array(
        beat(F.lit(0), t, n, b1, a1),
        beat(F.lit(1), between, n, (b1 + t) / 2, (a1 + a2) / 2),
        beat(F.lit(2), t, 2 * n, (b1 + t) / 2, between),
        beat(F.lit(2), between, 2 * n + 1, t, a1),
        beat(F.when(n % 2 == 1, 3).otherwise(4), t, n, b2, a2),
    )
    return beats.select(*key, F.inline(found)).where("level IS NOT NULL")


def continuity(reference: DataFrame, estimate: DataFrame, key: list[str], tolerance: float = TOLERANCE, block: int | None = None) -> DataFrame:
    """key, amlt: the best share over the metrical levels (``correct_share`` of each of ``levels``), by windows that hold no track in memory. block: see blocks."""
    timed = lambda df: df.select(*key, F.col("t").cast("double").alias("t"))
    own = blocks.led(blocks.lagged(blocks.with_block(timed(estimate), "t", block), key, ["t"], {"before": "t"}), key, ["t"], {"after": "t"})
    own = own.select(*key, F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("level"), "t", F.coalesce(F.col("t") - F.col("before"), F.col("after") - F.col("t")).alias("own"))
    levelled = _levelled(timed(reference), key, block)
    # An estimate goes before beats at its time, which are then its next ones.
    points = levelled.select(*key, "level", "t", F.lit(1).alias("side"), F.lit(None).cast("double").alias("own"), F.struct("t", "n", "step").alias("point"))
    both = own.select(*key, "level", "t", F.lit(0).alias("side"), "own", F.lit(None).cast(points.schema["point"].dataType).alias("point")).unionByName(points)
    found = blocks.carried(blocks.with_block(both, "t", block), [*key, "level"], ["t", "side"], ["point"])
    before, after, t = F.col("prev_point"), F.col("next_point"), F.col("t")
    near = F.when(after.isNull() | (t - before["t"] <= after["t"] - t), before).otherwise(after)
    found = found.select(*key, "level", "side", "t", "own", near.alias("near"))
    step = F.nullif(F.col("near")["step"], F.lit(0.0))
    good = (F.col("side") == 0) & (F.abs(t - F.col("near")["t"]) < tolerance * step) & (F.abs(1 - F.col("own") / step) < tolerance)
    hits = found.groupBy(*key, "level").agg(F.count_distinct(F.when(good, F.col("near")["n"])).alias("hits"), F.sum("side").alias("n_ref"), F.sum(1 - F.col("side")).alias("n_est"))
    return hits.groupBy(*key).agg(F.max(F.col("hits") / F.greatest("n_ref", "n_est")).alias("amlt"))
