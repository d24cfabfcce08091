"""Gap sessions with adaptive thresholds, nested lines, and section assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .stats import medians


def gap_thresholds(words: DataFrame, key: list[str], rules: dict[str, tuple[float, int]], fallback: Column | None = None, block: int | None = None) -> DataFrame:
    """Per key and rule (multiplier, floor): max(multiplier * median positive gap, floor); the floor where there is no positive gap.

    fallback: optional column of the words' key (a beat period) used for keys with fewer than two words: the rule's
    floor is then raised to it. Gaps are between a word's end and the next one's start.
    """
    ahead = blocks.led(blocks.with_block(words, "t0", block), key, ["t0", "idx"], {"__next": "t0"})
    gap = F.col("__next") - F.col("t1")
    rows = ahead.select(*key, F.when(gap > 0, gap).alias("gap"), (F.lit(None) if fallback is None else fallback).cast("double").alias("__raised"))
    found = medians(rows, key, "gap", "median", block is not None, {"__n": (F.count("*"), F.sum), "__fallback": (F.max("__raised"), F.max)})
    return found.select(*key, *[_threshold(times, floor, fallback is not None).alias(name) for name, (times, floor) in rules.items()])


def _threshold(times: float, floor: int, raised: bool = False) -> Column:
    value = F.greatest(F.lit(float(floor)), F.coalesce(F.col("median") * times, F.lit(float(floor))))
    return F.when(F.col("__n") < 2, F.greatest(F.lit(float(floor)), F.coalesce("__fallback", F.lit(0.0)))).otherwise(value) if raised else value


def thresholded(words: DataFrame, key: list[str], rules: dict[str, tuple[float, int]], block: int | None = None) -> DataFrame:
    """Words with their key's thresholds. Without blocks, these come from windows over the key, in the words' own shuffle; with them, by a join."""
    if block is not None:
        return words.join(gap_thresholds(words, key, rules, block=block), key)
    gap = F.col("__next") - F.col("t1")
    ahead = blocks.led(words, key, ["t0", "idx"], {"__next": "t0"})
    marked = ahead.withColumn("median", F.median(F.when(gap > 0, gap)).over(Window.partitionBy(*key)))
    return marked.withColumns({name: _threshold(*rule) for name, rule in rules.items()}).drop("__next", "median")


def gap_sessions(words: DataFrame, key: list[str], threshold: Column, name: str = "block", block: int | None = None) -> DataFrame:
    """Numbers sessions from 0: a new one where the start is more than the threshold after the previous word's end."""
    kept = blocks.lagged(blocks.with_block(words, "t0", block), key, ["t0", "idx"], {"__last_end": "t1"})
    cut = F.when(F.col("t0") - F.col("__last_end") > threshold, 1).otherwise(0).cast("long")
    return blocks.running_sum(kept, key, ["t0", "idx"], cut, name).drop("__last_end", blocks.BLOCK)


def summarised(words: DataFrame, key: list[str], session: list[str], *more: Column) -> DataFrame:
    """One row per session: first start, the last word's end, number of words, and further aggregates."""
    return words.groupBy(*key, *session).agg(F.min("t0").alias("t0"), F.max(F.struct("t0", "idx", "t1"))["t1"].alias("t1"), F.count("*").alias("n_words"), *more)


def sections(blocks_: DataFrame, durations: DataFrame, key: list[str]) -> DataFrame:
    """Intro, verses and choruses in turn, breaks and outro over a track's blocks (block, t0, t1, threshold).

    durations: key, duration. Rows: key, kind, label, t0, t1, seq (order in the track). A track without
    blocks is one instrumental; a duration of 0 or less gives nothing.
    """
    w = Window.partitionBy(*key).orderBy("block")
    placed = durations.where("duration > 0").select(*key, "duration").join(blocks_.select(*key, "block", "t0", "t1", "threshold"), key, "left")
    placed = placed.withColumns({"last_end": F.lag("t1").over(w), "n": F.row_number().over(w) - 1, "next": F.lead("block").over(w)})
    far = F.col("t0") - F.col("last_end") > F.col("threshold")
    placed = placed.withColumn("breaks", F.sum(F.when((F.col("n") > 0) & far, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def row(when, kind, nth, t0, t1):
        return F.when(when, F.struct(kind.alias("kind"), nth.cast("long").alias("nth"), t0.alias("t0"), t1.alias("t1")))

    some, start, end = F.col("block").isNotNull(), F.col("t0"), F.col("t1")
    # What a block brings along: itself, the break before it, the track's beginning before the first and end after the last one.
    rows = F.array(
        row(some, F.when(F.col("n") % 2 == 1, "chorus").otherwise("verse"), F.floor(F.col("n") / 2) + 1, start, end),
        row(some & (F.col("n") > 0) & far, F.lit("instrumental"), F.col("breaks"), F.col("last_end"), start),
        row(some & (F.col("n") == 0) & (start > F.col("threshold")), F.lit("intro"), one, zero, start),
        row(some & F.col("next").isNull() & (F.col("duration") - end > F.col("threshold")), F.lit("outro"), one, end, F.col("duration")),
        row(~some, F.lit("instrumental"), one, zero, F.col("duration")),
    )
    every = placed.select(*key, F.explode(F.array_compact(rows)).alias("s")).select(*key, "s.*")
    numbered = every.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy("t0", "t1", "kind")))
    return numbered.select(*key, "kind", section_label(F.col("kind"), F.col("nth")).alias("label"), "t0", "t1", "seq")


def section_label(kind: Column, nth: Column) -> Column:
    """Verse n; Chorus, Chorus 2, ...; Instrumental, Instrumental 2, ...; Intro; Outro."""
    plain = F.initcap(kind)
    return F.when(kind == "verse", F.concat(plain, F.lit(" "), nth.cast("string"))).when(nth > 1, F.concat(plain, F.lit(" "), nth.cast("string"))).otherwise(plain)
