"""Nearest-neighbour joins on time: both directions, tolerance ladders, intervals.

Times are integers (microseconds). Ties go to the earlier element, at equal times to the lower ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

HOUR = 3_600_000_000


def nearest(left: DataFrame, rights: dict[str, DataFrame], key: list[str], time: str, block: int | None = None) -> DataFrame:
    """Adds, per named right side (key, t, idx), a struct (t, idx) of its element nearest to the left row's time.

    Right sides are united with the left rows and carried along: no pair of rows is ever built. block: see blocks.
    """
    fields = left.columns
    united = left.select(*key, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*fields).alias("__row"), *[F.lit(None).cast("struct<t:bigint,idx:bigint>").alias(f"__{n}") for n in rights])
    for name, right in rights.items():
        unique = right.groupBy(*key, "t").agg(F.min("idx").cast("long").alias("idx"))
        point = F.struct(F.col("t").cast("long").alias("t"), "idx")
        columns = [point.alias(f"__{n}") if n == name else F.lit(None).cast("struct<t:bigint,idx:bigint>").alias(f"__{n}") for n in rights]
        united = united.unionByName(unique.select(*key, F.col("t").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(united.schema["__row"].dataType).alias("__row"), *columns))
    names = [f"__{n}" for n in rights]
    found = blocks.carried(blocks.with_block(united, "__t", block), key, ["__t", "__side"], names).where("__side = 1")

    def nearer(c: str) -> Column:
        before, after, t = F.col(f"prev_{c}"), F.col(f"next_{c}"), F.col("__t")
        return F.when(after.isNull() | (t - before["t"] <= after["t"] - t), before).otherwise(after)

    return found.select("__row.*", *[nearer(c).alias(c[2:]) for c in names])


def midpoints(beats: DataFrame, key: list[str], block: int | None = None) -> DataFrame:
    """Half-way points between successive beats: key, t, idx (of the earlier beat)."""
    ahead = blocks.led(blocks.with_block(beats, "t", block), key, ["t", "idx"], {"after": "t"})
    return ahead.where("after IS NOT NULL").select(*key, F.expr("(t + after) div 2").alias("t"), "idx")


def snap(events: DataFrame, beats: DataFrame, key: list[str], time: str, beat_tolerance: int = 70_000, half_tolerance: int = 150_000, block: int | None = None) -> DataFrame:
    """Tolerance ladder: the nearest beat, else the nearest half-beat, else the event's own time. Adds level and snapped."""
    found = nearest(events, {"beat": beats.select(*key, "t", "idx"), "half": midpoints(beats, key, block)}, key, time, block)
    near = lambda c, tolerance: F.abs(F.col(time) - F.col(c)["t"]) <= tolerance
    level = F.when(near("beat", beat_tolerance), "beat").when(near("half", half_tolerance), "8th").otherwise("unsnapped")
    snapped = F.when(near("beat", beat_tolerance), F.col("beat")["t"]).when(near("half", half_tolerance), F.col("half")["t"]).otherwise(F.col(time))
    return found.withColumns({"level": level, "snapped": snapped}).drop("beat", "half")


def nearest_index(points: DataFrame, grid: DataFrame, key: list[str], block: int | None = None) -> DataFrame:
    """Distinct grid indices nearest to any point."""
    return nearest(points, {"found": grid}, key, "t", block).where("found IS NOT NULL").select(*key, F.col("found.idx").alias("idx")).distinct()


def nearest_within(left: DataFrame, right: DataFrame, key: list[str], left_id: list[str], tolerance: int, strict: bool = True, block: int | None = None) -> DataFrame:
    """Left rows (with a time t) whose nearest right row (t, idx) is within the tolerance: key, left_id, nearest (distance, idx, t)."""
    found = nearest(left.select(*key, *left_id, "t"), {"__near": right.select(*key, "t", "idx")}, key, "t", block)
    distance = F.abs(F.col("t") - F.col("__near.t"))
    close = found.where(distance < tolerance if strict else distance <= tolerance)
    return close.select(*key, *left_id, F.struct(distance.alias("distance"), F.col("__near.idx").alias("idx"), F.col("__near.t").alias("t")).alias("nearest"))


#: Levels of cells (2**level long): from a second to all that 63 bits hold, a factor of 16 apart.
LEVELS = tuple(range(20, 63, 4))
_CELL = ("__level", "__cell")


def level_of(start: Column, end: Column) -> Column:
    """The least level whose cells are as long as the closed interval, so that it touches two at most."""
    step = F.ceil((F.log2(end - start + 1) - LEVELS[0]) / (LEVELS[1] - LEVELS[0])).cast("int")
    return LEVELS[0] + (LEVELS[1] - LEVELS[0]) * F.greatest(F.lit(0), F.least(F.lit(len(LEVELS) - 1), step))


def cell_of(time: Column, level: Column) -> Column:
    return F.call_function("shiftright", time.cast("long"), level)


def indexed(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals in the cells of their own level (__level, __cell)."""
    marked = intervals.withColumns({"__from": F.floor(start), "__to": F.ceil(end)}).where("__to >= __from").withColumn("__level", level_of(F.col("__from"), F.col("__to")))
    return marked.withColumn("__cell", F.explode(F.sequence(cell_of(F.col("__from"), F.col("__level")), cell_of(F.col("__to"), F.col("__level"))))).drop("__from", "__to")


def asking(points: DataFrame, time: Column, key: list[str], index: DataFrame) -> DataFrame:
    """Points with their cell on every level that the index has for their key (a row for each level at most, a few as a rule)."""
    return points.join(index.select(*key, "__level").distinct(), key).withColumn("__cell", cell_of(time, F.col("__level")))


def nearest_interval(points: DataFrame, intervals: DataFrame, key: list[str], point_id: list[str], tolerance: Column) -> DataFrame:
    """Points with the closed interval (t0, t1, idx) at least distance (0 inside), if within the tolerance.

    tolerance: a column of the intervals, which are looked up as if they were longer by it at both ends. Adds nearest: (distance, idx, t0, t1).
    """
    wide = intervals.select(*key, "t0", "t1", F.col("idx").alias("__idx"), tolerance.cast("double").alias("__tolerance"))
    index = indexed(wide, F.col("t0") - F.col("__tolerance"), F.col("t1") + F.col("__tolerance"))
    distance = F.greatest(F.lit(0).cast("long"), F.col("t0") - F.col("t"), F.col("t") - F.col("t1"))
    pairs = asking(points, F.col("t"), key, index).join(index, [*key, *_CELL]).where(distance <= F.col("__tolerance"))
    best = F.min(F.struct(distance.alias("distance"), F.col("__idx").alias("idx"), "t0", "t1"))
    return pairs.groupBy(*key, *point_id, "t").agg(best.alias("nearest"))
