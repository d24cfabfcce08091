"""Ordered operators, with a way to split hot keys.

Without blocks (the default), these are windows over the key: one shuffle, one sort, streamed through a task. Where single keys
hold very many rows (``width_for`` measures it), ``with_block`` splits them into time blocks: what a row needs from its own block comes from a
window over (key, block), what it needs from earlier or later blocks from a summary with one row per block. That
spreads a hot key over its blocks at the price of computing the input twice, so materialise an expensive one before. Results do
not depend on blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def with_block(df: DataFrame, time: str, width: int | None) -> DataFrame:
    """Adds the number of the row's time block, if there is to be one."""
    return df if width is None else df.withColumn(BLOCK, F.floor(F.col(time) / F.lit(width)))


#: Rows of one key from which on it is split.
HOT = 1_000_000


def width_for(df: DataFrame, key: list[str], time: str, rows: int = HOT) -> int | None:
    """A block width for the time column by the largest key's size: None while no key has more than so many rows. One narrow aggregation."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span"))
    most = sizes.agg(F.max(F.struct("n", "span")).alias("top")).first()["top"]
    return None if most is None or most["n"] <= rows else max(1, int(most["span"] or 0) * rows // most["n"])


def _inside(key: list[str], order: list) -> Window:
    return Window.partitionBy(*key, BLOCK).orderBy(*order)


def _up_and_down(part: Window, order: list[str]) -> tuple[Window, Window]:
    """Frames up to a row from either end; a frame that shrinks from the front would be computed anew for every row."""
    frame = (Window.unboundedPreceding, 0)
    return part.orderBy(*order).rowsBetween(*frame), part.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*frame)


def _across(key: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy(BLOCK)


def _summary(df: DataFrame, key: list[str], aggregates: list[Column], derived: list[Column]) -> DataFrame:
    return df.groupBy(*key, BLOCK).agg(*aggregates).select(*key, BLOCK, *derived)


def lagged(df: DataFrame, key: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """The previous row's columns: ``values`` maps new names to existing columns. Blocks, if any, are those of order[0]."""
    if BLOCK not in df.columns:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumns({n: F.lag(c).over(w) for n, c in values.items()})
    w = _inside(key, order)
    last = F.max(F.struct(*order, *[F.col(c).alias(f"__v_{n}") for n, c in values.items()]))
    before = F.last("__blk_last", True).over(_across(key).rowsBetween(Window.unboundedPreceding, -1))
    summary = _summary(df, key, [last.alias("__blk_last")], [before.alias("__blk_before")])
    at = F.row_number().over(w)
    out = df.withColumn("__blk_at", at).withColumns({f"__in_{n}": F.lag(c).over(w) for n, c in values.items()}).join(summary, [*key, BLOCK])
    picked = {n: F.when(F.col("__blk_at") > 1, F.col(f"__in_{n}")).otherwise(F.col("__blk_before")[f"__v_{n}"]) for n in values}
    return out.withColumns(picked).drop("__blk_at", "__blk_before", *[f"__in_{n}" for n in values])


def led(df: DataFrame, key: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """The next row's columns."""
    if BLOCK not in df.columns:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumns({n: F.lead(c).over(w) for n, c in values.items()})
    w = _inside(key, order)
    first = F.min(F.struct(*order, *[F.col(c).alias(f"__v_{n}") for n, c in values.items()]))
    after = F.first("__blk_first", True).over(_across(key).rowsBetween(1, Window.unboundedFollowing))
    summary = _summary(df, key, [first.alias("__blk_first")], [after.alias("__blk_after")])
    last = F.lead(F.lit(True), 1, False).over(w)
    out = df.withColumn("__blk_more", last).withColumns({f"__in_{n}": F.lead(c).over(w) for n, c in values.items()}).join(summary, [*key, BLOCK])
    picked = {n: F.when(F.col("__blk_more"), F.col(f"__in_{n}")).otherwise(F.col("__blk_after")[f"__v_{n}"]) for n in values}
    return out.withColumns(picked).drop("__blk_more", "__blk_after", *[f"__in_{n}" for n in values])


def running_sum(df: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of value up to and with the row."""
    if BLOCK not in df.columns:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    marked = df.withColumn("__blk_value", value)
    before = F.coalesce(F.sum("__blk_total").over(_across(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summary = _summary(marked, key, [F.sum("__blk_value").alias("__blk_total")], [before.alias("__blk_before")])
    inside = F.sum("__blk_value").over(_inside(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__blk_inside", inside).join(summary, [*key, BLOCK]).withColumn(name, F.col("__blk_inside") + F.col("__blk_before")).drop("__blk_value", "__blk_inside", "__blk_before")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Position of the row in its key, from 1."""
    return running_sum(df, key, order, F.lit(1).cast("long"), name)


def carried(df: DataFrame, key: list[str], order: list[str], points: list[str]) -> DataFrame:
    """For every struct column of points: the greatest value up to the row (prev_<name>) and the least from it on (next_<name>)."""
    if BLOCK not in df.columns:
        up, down = _up_and_down(Window.partitionBy(*key), order)
        return df.withColumns({f"prev_{c}": F.max(c).over(up) for c in points} | {f"next_{c}": F.min(c).over(down) for c in points})
    up, down = _up_and_down(Window.partitionBy(*key, BLOCK), order)
    aggregates = [f(c).alias(f"__{n}_{c}") for c in points for n, f in (("max", F.max), ("min", F.min))]
    earlier, later = _across(key).rowsBetween(Window.unboundedPreceding, -1), _across(key).rowsBetween(1, Window.unboundedFollowing)
    derived = [F.max(f"__max_{c}").over(earlier).alias(f"__earlier_{c}") for c in points] + [F.min(f"__min_{c}").over(later).alias(f"__later_{c}") for c in points]
    summary = _summary(df, key, aggregates, derived)
    inside = {f"__up_{c}": F.max(c).over(up) for c in points} | {f"__down_{c}": F.min(c).over(down) for c in points}
    out = df.withColumns(inside).join(summary, [*key, BLOCK])
    picked = {f"prev_{c}": F.coalesce(f"__up_{c}", f"__earlier_{c}") for c in points} | {f"next_{c}": F.coalesce(f"__down_{c}", f"__later_{c}") for c in points}
    return out.withColumns(picked).drop(*[f"__{n}_{c}" for c in points for n in ("up", "down", "earlier", "later")])
