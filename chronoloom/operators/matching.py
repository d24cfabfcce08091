"""One-to-one matching of two sorted sides within a tolerance, as maps that compose.

In order of time every element takes the longest-waiting one of the other side, or waits for the tolerance itself. What waits is always the
latest elements of one side, so a state is one number: waiting estimates, or minus the waiting references. An element first lets the old ones
go, which clamps the number to those within the tolerance, then adds or takes one. Such steps compose to a clamp of a shift,
x -> min(max(x + a, lo), hi), and the references that went unmatched to c + max(0, p - x). A stretch of any length is these five numbers,
whatever waited before it; so stretches are folded by any task, at the same time, and put together in order of time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beyond any number of elements.
FAR = 1 << 60
#: Stretches that are put together at once.
FAN = 1024
_MAP = ("a", "lo", "hi", "c", "p")
_SUMS = ("n_ref", "n_est")


def _then(f: tuple, g: tuple) -> tuple:
    """The map of f's stretch followed by g's, for arrays of maps."""
    a1, lo1, hi1, c1, p1 = f
    a2, lo2, hi2, c2, p2 = g
    reach = np.clip(p2, lo1, hi1)
    lo, hi = np.clip(lo1 + a2, lo2, hi2), np.clip(hi1 + a2, lo2, hi2)
    return a1 + a2, lo, hi, c1 + c2 + np.maximum(0, p2 - hi1), np.where(reach > lo1, reach - a1, p1)


def _then_column(f: Column, g: Column) -> Column:
    """The same for columns."""
    clip = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    reach = clip(g["p"], f["lo"], f["hi"])
    return F.struct(
        (f["a"] + g["a"]).alias("a"),
        clip(f["lo"] + g["a"], g["lo"], g["hi"]).alias("lo"),
        clip(f["hi"] + g["a"], g["lo"], g["hi"]).alias("hi"),
        (f["c"] + g["c"] + F.greatest(F.lit(0).cast("long"), g["p"] - f["hi"])).alias("c"),
        F.when(reach > f["lo"], reach - f["a"]).otherwise(f["p"]).alias("p"),
    )


def _steps(t: np.ndarray, side: np.ndarray, fresh: np.ndarray, tolerance: int) -> tuple:
    """Every element's map. fresh marks the first of a stretch; times are sorted within one."""
    near = np.minimum(np.diff(t, prepend=t[:1]), tolerance + 1)
    near[fresh] = tolerance + 1
    place = np.cumsum(near)  # stretches lie further apart than the tolerance
    at = np.arange(len(t))
    first = np.searchsorted(place, place - tolerance, "left")
    upto = np.concatenate([[0], np.cumsum(side == 0)])
    refs = upto[at] - upto[first]
    shift = np.where(side == 0, -1, 1)
    return shift, shift - refs, shift + (at - first - refs), np.zeros_like(shift), -refs


def _folded(maps: tuple, stretch: np.ndarray) -> tuple[tuple, np.ndarray]:
    """One map for each stretch: neighbours are put together in rounds, half as many in each."""
    while True:
        starts = np.flatnonzero(np.diff(stretch, prepend=-1))
        place = np.arange(len(stretch)) - np.repeat(starts, np.diff(np.append(starts, len(stretch))))
        left = np.flatnonzero(place % 2 == 0)
        if len(left) == len(stretch):
            return maps, stretch
        paired = np.isin(left + 1, np.flatnonzero(place % 2 == 1))
        both = _then(tuple(m[left[paired]] for m in maps), tuple(m[left[paired] + 1] for m in maps))
        kept = tuple(m[left] for m in maps)
        for out, new in zip(kept, both):
            out[paired] = new
        maps, stretch = kept, stretch[left]


def _stretches(key: list[str], tolerance: int):
    """Sorted rows (key, block, t, side, own) to one map per stretch and batch; from batch to batch only what is within the tolerance is kept."""
    names = [*key, "block"]

    def run(batches):
        kept = None  # key, times and sides at the end of the batch before
        for piece, batch in enumerate(b for b in batches if b.num_rows):
            columns = [batch.column(c) for c in names]
            codes = [c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in columns]
            t, side, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "side", "own"))
            changes = np.zeros(len(t), bool)
            for code in codes:
                changes[1:] |= code[1:] != code[:-1]
            stretch = np.cumsum(changes)
            firsts = np.concatenate([[0], np.flatnonzero(changes)])
            here = lambda row: tuple(c[row].as_py() for c in columns)  # noqa: E731, B023
            if kept and kept[0] == here(0):
                t, side = np.concatenate([kept[1], t]), np.concatenate([kept[2], side])
                own, stretch = np.concatenate([np.zeros(len(kept[1]), bool), own]), np.concatenate([np.zeros(len(kept[1]), int), stretch])
            maps = _steps(t, side, np.diff(stretch, prepend=-1) != 0, tolerance)
            last = (stretch == stretch[-1]) & (t >= t[-1] - tolerance)
            kept = here(batch.num_rows - 1), t[last], side[last]
            refs, ests = (np.bincount(stretch[own & (side == s)], minlength=len(firsts)) for s in (0, 1))
            found, of = _folded(tuple(m[own] for m in maps), stretch[own])
            at = pa.array(firsts[of])
            numbers = [np.full(len(of), piece), *found, refs[of], ests[of]]
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in columns], *[pa.array(x, pa.int64()) for x in numbers]], [*names, "piece", *_MAP, *_SUMS])

    return run


def _together(maps: DataFrame, by: list[str]) -> DataFrame:
    """Maps put together in order of block and piece."""
    start = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(_MAP, (0, -FAR, FAR, 0, -FAR))])
    sorted_ = F.array_sort(F.collect_list(F.struct("block", "piece", *_MAP)))
    grouped = maps.groupBy(*by).agg(sorted_.alias("__maps"), *[F.sum(c).alias(c) for c in _SUMS])
    return grouped.select(*by, F.aggregate("__maps", start, _then_column).alias("__map"), *_SUMS).select(*by, "__map.*", *_SUMS)


def _cut(both: DataFrame, key: list[str], tolerance: int, block: int | None) -> DataFrame:
    """Rows with their block; those within the tolerance before a cut once more in the block behind it, not as its own."""
    if block is None:
        return both.select(*key, F.lit(0).cast("long").alias("block"), "t", "side", F.lit(True).alias("own"))
    width = max(1, tolerance, min(block, 256 * tolerance))
    own = F.floor(F.col("t") / F.lit(width)).cast("long")
    told = lambda b, mine: F.struct(b.alias("block"), F.lit(mine).alias("own"))
    ahead = F.when((own + 1) * width - F.col("t") <= tolerance, told(own + 1, False))
    return both.select(*key, "t", "side", F.inline(F.array_compact(F.array(told(own, True), ahead)))).select(*key, "block", "t", "side", "own")


def matched(both: DataFrame, key: list[str], tolerance: int, block: int | None = None) -> DataFrame:
    """key, hits, n_ref, n_est of rows (key, t, side): side 0 are references, 1 estimates, t is not null.

    block: a width in time by which large keys are cut, at most 256 tolerances. Rows within the tolerance before a cut go to both sides
    of it, once as what may still wait. Without blocks a key streams through one task. Rows are shuffled once, then one map for each
    stretch; at most FAN blocks meet in a group, then one map for as many.
    """
    rows = _cut(both, key, tolerance, block).repartition(*key, "block").sortWithinPartitions(*key, "block", "t", "side")
    numbers = [T.StructField(n, T.LongType()) for n in ("piece", *_MAP, *_SUMS)]
    maps = rows.mapInArrow(_stretches(key, tolerance), T.StructType([*[rows.schema[c] for c in (*key, "block")], *numbers]))
    if block is not None:
        maps = _together(maps.withColumn("__upper", F.floor(F.col("block") / FAN)), [*key, "__upper"]).withColumnsRenamed({"__upper": "block"}).withColumn("piece", F.lit(0))
    found = _together(maps, key)
    zero = F.lit(0).cast("long")
    waiting = F.greatest(zero, -F.least(F.greatest("a", "lo"), F.col("hi")))  # references that wait at the end
    return found.select(*key, (F.col("n_ref") - F.col("c") - F.greatest(zero, F.col("p")) - waiting).alias("hits"), *_SUMS)
