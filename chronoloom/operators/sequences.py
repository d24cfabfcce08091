"""Run lengths, positions in a measure, pairing, zipping, windows with context, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def runs(frames: DataFrame, key: list[str], order: str, token: str, blank: Column | None = None, block: int | None = None) -> DataFrame:
    """Maximal runs of one token in order: key, run, token, first, last (inclusive), n. Blank runs break others and are dropped."""
    marked = blocks.lagged(blocks.with_block(frames, order, block), key, [order], {"__last": token, "__at": order})
    new = F.when(F.col("__at").isNotNull() & F.col("__last").eqNullSafe(F.col(token)), 0).otherwise(1).cast("long")
    numbered = blocks.running_sum(marked, key, [order], new, "run")
    found = numbered.groupBy(*key, "run", token).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return found.where(~blank) if blank is not None else found


def spans_to_words(spans: DataFrame, key: list[str], word: str, frame_us: int = 20_000) -> DataFrame:
    """Word spans from token runs: from the first frame's start to the last frame's end."""
    return spans.groupBy(*key, word).agg((F.min("first") * frame_us).alias("t0"), ((F.max("last") + 1) * frame_us).alias("t1"))


def measure_positions(beats: DataFrame, key: list[str], downbeat: Column, block: int | None = None) -> DataFrame:
    """Position of every beat in its measure, from 1; a measure begins at a downbeat or with the track."""
    counted = blocks.running_sum(blocks.with_block(beats, "t", block), key, ["t", "idx"], F.when(downbeat, 1).otherwise(0).cast("long"), "measure")
    inside = Window.partitionBy(*key, "measure").orderBy("t", "idx")
    return counted.withColumn("position", F.row_number().over(inside)).drop(blocks.BLOCK)


def not_increasing(beats: DataFrame, key: list[str], block: int | None = None) -> DataFrame:
    """Elements (in order of idx) that are not later than the one before."""
    kept = blocks.lagged(blocks.with_block(beats, "idx", block), key, ["idx"], {"previous": "t"})
    return kept.where("previous >= t").drop(blocks.BLOCK)


def pairs(items: DataFrame, key: list[str], idx: str, label: str) -> DataFrame:
    """Items two by two, (0, 1), (2, 3), ...; an odd last one pairs with itself."""
    even = (F.col(idx) % 2) == 0
    found = items.groupBy(*key, F.floor(F.col(idx) / 2).alias("pair")).agg(F.max(F.when(even, F.col(label))).alias("first"), F.max(F.when(~even, F.col(label))).alias("second"))
    return found.withColumn("second", F.coalesce("second", "first"))


def positional_zip(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str], block: int | None = None) -> DataFrame:
    """Left and right rows of a key by position; the longer side's rest is left out."""
    a = blocks.numbered(blocks.with_block(left, left_order[0], block), key, left_order, "position").drop(blocks.BLOCK)
    b = blocks.numbered(blocks.with_block(right, right_order[0], block), key, right_order, "position").drop(blocks.BLOCK)
    return a.join(b, [*key, "position"])


def capped(items: DataFrame, key: list[str], order: list[str], cap: Column) -> DataFrame:
    """Adds kept: whether the item is among its key's first ``cap``."""
    return items.withColumn("kept", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) <= cap)


def context_windows(tracks: DataFrame, duration: str, window: int, context: int) -> DataFrame:
    """Windows over a duration with context on both sides: window, t0, t1 (own span), c0, c1 (with context, clipped)."""
    last = F.greatest(F.lit(0), F.ceil(F.col(duration) / window) - 1)
    out = tracks.where(F.col(duration) > 0).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    out = out.withColumn("t0", F.col("window") * window).withColumn("t1", F.least(F.col(duration), F.col("t0") + window))
    return out.withColumn("c0", F.greatest(F.lit(0), F.col("t0") - context)).withColumn("c1", F.least(F.col(duration), F.col("t1") + context))


def cropped(frames: DataFrame, frame_us: int) -> DataFrame:
    """Frames of windows with context whose start lies in the window's own span: of (c0, t0, t1, frame), adds t."""
    return frames.withColumn("t", F.col("c0") + F.col("frame") * frame_us).where("t >= t0 AND t < t1")
