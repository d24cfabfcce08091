"""Interval operators: onsets to intervals, range joins, common refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .nearest import _CELL, asking, cell_of, indexed, level_of


def onset_intervals(onsets: DataFrame, key: list[str], label: str, end_of_track: Column | None = None, none_label: str | None = "N", tail: int = 1_000_000, block: int | None = None) -> DataFrame:
    """Half-open intervals between onsets (t, idx); boundaries labelled none end the one before and are dropped afterwards.

    The last interval ends with the track, or ``tail`` after its start; empty ones are dropped. Without a label for none, all labels stay.
    """
    last = F.col("t") + F.lit(tail)
    last = F.coalesce(end_of_track, last) if end_of_track is not None else last
    ahead = blocks.led(blocks.with_block(onsets, "t", block), key, ["t", "idx"], {"__after": "t"})
    out = ahead.withColumn("t0", F.col("t")).withColumn("t1", F.greatest(F.col("t"), F.coalesce("__after", last)))
    keep = F.col("t1") > F.col("t0")
    return out.where(keep if none_label is None else keep & (F.col(label) != none_label) & (F.col(label) != "")).drop("t", "__after", blocks.BLOCK)


def points_in(points: DataFrame, intervals: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of points (t) and closed intervals (t0, t1) that hold them, each pair once.

    By equality of cells: an interval stands in one or two, on the level of its own length, and a point asks one cell on each level in use. So
    long intervals make no more rows than short ones, and there is no width to choose.
    """
    index = indexed(intervals, F.col("t0"), F.col("t1"))
    return asking(points, F.col("t"), key, index).join(index, [*key, *_CELL]).where("t BETWEEN t0 AND t1").drop(*_CELL)


def first_interval_at(points: DataFrame, intervals: DataFrame, key: list[str], point_id: list[str]) -> DataFrame:
    """For each point, the interval of lowest ordinal that holds it."""
    pairs = points_in(points, intervals.select(*key, "t0", "t1", F.col("idx").alias("__idx")), key)
    return pairs.groupBy(*key, *point_id).agg(F.min("__idx").alias("idx"))


def points_per_interval(intervals: DataFrame, points: DataFrame, key: list[str], interval_id: list[str]) -> DataFrame:
    """Intervals with the number of points inside, both ends included; none counts as 0."""
    named = intervals.select(*key, *interval_id, "t0", "t1")
    counts = points_in(points.select(*key, "t"), named, key).groupBy(*key, *interval_id).agg(F.count("*").alias("n"))
    return named.join(counts, [*key, *interval_id], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def overlaps(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of intervals (t0, t1) and (u0, u1) that overlap strictly: t0 < u1 and t1 > u0.

    The longer one of a pair stands in its cells, the other asks on all levels from its own up, where it touches two cells at most; a pair counts in
    the first cell that they share.
    """
    names = [*key, *[c for c in left.columns if c not in key], *[c for c in right.columns if c not in key]]
    a, b = indexed(left, F.col("t0"), F.col("t1")), indexed(right, F.col("u0"), F.col("u1"))

    def met(index: DataFrame, others: DataFrame, start: str, end: str, or_equal: bool) -> DataFrame:
        own = level_of(F.col(start), F.col(end))
        asked = others.where(F.col(end) >= F.col(start)).join(index.select(*key, "__level").distinct(), key).where(F.col("__level") >= own if or_equal else F.col("__level") > own)
        asked = asked.withColumn("__cell", F.explode(F.sequence(cell_of(F.col(start), F.col("__level")), cell_of(F.col(end), F.col("__level")))))
        pairs = index.join(asked, [*key, *_CELL]).where((F.col("t0") < F.col("u1")) & (F.col("t1") > F.col("u0")))
        return pairs.where(F.col("__cell") == F.greatest(cell_of(F.col("t0"), F.col("__level")), cell_of(F.col("u0"), F.col("__level")))).select(*names)

    return met(a, right, "u0", "u1", True).unionByName(met(b, left, "t0", "t1", False))


def starts_in(points: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of points (t) and half-open ranges (t0, t1) with t0 <= t < t1."""
    return points_in(points, ranges, key).where("t < t1")


def equal_intervals(items: DataFrame, key: list[str], order: list[str], duration: Column) -> DataFrame:
    """n items of a key share its duration equally: adds t0, t1."""
    n = F.count("*").over(Window.partitionBy(*key))
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return items.withColumn("t0", at * duration / n).withColumn("t1", (at + 1) * duration / n)


def swept(left: DataFrame, right: DataFrame, key: list[str], block: int | None = None, gaps: tuple | None = None) -> DataFrame:
    """Every boundary t of either side's intervals (t0, t1, label) with the next one, t1 (null at the last), and what each side began last, left and right: (t, begun, label).

    One stream of events, sorted once: both sides' starts and ends, of which one a time is left. gaps: labels that ends begin, where nothing starts with them.
    """
    kind = f"struct<t:bigint,begun:int,label:{left.schema['label'].dataType.simpleString()}>"

    def events(df: DataFrame, side: int) -> DataFrame:
        start = F.struct(F.col("t0").cast("long").alias("t"), F.lit(1).alias("begun"), F.col("label")).cast(kind)
        end = F.lit(None).cast(kind) if gaps is None else F.struct(F.col("t1").cast("long").alias("t"), F.lit(0).alias("begun"), F.lit(gaps[side]).alias("label")).cast(kind)
        both = F.array(F.struct(F.col("t0").alias("t"), start.alias("mark")), F.struct(F.col("t1").alias("t"), end.alias("mark")))
        columns = {name: F.col("__e.mark") if side == k else F.lit(None).cast(kind) for k, name in enumerate(("left", "right"))}
        return df.select(*key, F.explode(both).alias("__e")).select(*key, "__e.t", *[c.alias(n) for n, c in columns.items()])

    every = events(left, 0).unionByName(events(right, 1))
    # Dealt by the key once: counting times, ordering them and whatever is summed up by key afterwards need no other shuffle.
    every = every.repartition(*key) if block is None else every
    marks = blocks.with_block(every.groupBy(*key, "t").agg(F.max("left").alias("left"), F.max("right").alias("right")), "t", block)
    held = blocks.carried(blocks.led(marks, key, ["t"], {"t1": "t"}), key, ["t"], ["left", "right"])
    return held.select(*key, "t", "t1", F.col("prev_left").alias("left"), F.col("prev_right").alias("right"))


def refinement(left: DataFrame, right: DataFrame, key: list[str], block: int | None = None) -> DataFrame:
    """Common refinement of two labelled interval sets (t0, t1, label): key, t0, t1, left_label, right_label.

    Every boundary of either side cuts; a stretch carries the label of the interval begun last on each side.
    """
    cut = swept(left, right, key, block).where("t1 IS NOT NULL")
    return cut.select(*key, F.col("t").alias("t0"), "t1", F.col("left.label").alias("left_label"), F.col("right.label").alias("right_label"))
