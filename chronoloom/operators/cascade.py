"""Priority-cascade placement and worst-first ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import first_interval_at
from .nearest import nearest, snap

STRATEGIES = ("melisma_start", "stressed_syllable", "any_syllable", "before_word", "orphan")


def place(
    chords: DataFrame,
    beats: DataFrame,
    syllables: DataFrame,
    words: DataFrame,
    key: list[str],
    long_syllable: int = 600_000,
    stressed: int = 150_000,
    any_: int = 300_000,
    word: int = 500_000,
    beat_tolerance: int = 70_000,
    half_tolerance: int = 150_000,
    block: int | None = None,
) -> DataFrame:
    """Where each chord (t, idx) goes: key, idx, anchor, strategy, target (ordinal of syllable or word), distance.

    The anchor is the chord's time snapped to beats. In order: the first long syllable that holds the anchor; the closest stressed
    syllable within (strictly) ``stressed``; the closest syllable within ``any_``; the closest word within ``word``; else an orphan.
    syllables: t0, t1, idx, stressed; words: t0, idx. block: see blocks.
    """
    anchored = snap(chords.select(*key, "t", "idx"), beats, key, "t", beat_tolerance, half_tolerance, block).select(*key, F.col("idx").alias("chord"), F.col("snapped").alias("t"))
    id_ = ["chord"]
    long_ones = syllables.where(F.col("t1") - F.col("t0") > long_syllable).select(*key, "t0", "t1", "idx")
    held = first_interval_at(anchored, long_ones, key, [*id_]).select(*key, *id_, F.struct(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("distance"), F.col("idx").cast("long").alias("idx")).alias("c"))
    starts = syllables.select(*key, F.col("t0").alias("t"), "idx", "stressed")
    sides = {"stressed": starts.where("stressed").drop("stressed"), "any": starts.drop("stressed"), "word": words.select(*key, F.col("t0").alias("t"), "idx")}
    near = nearest(anchored, sides, key, "t", block).join(held, [*key, *id_], "left")

    def within(side: str, rank: int, tolerance: int) -> Column:
        distance = F.abs(F.col("t") - F.col(f"{side}.t"))
        return F.when(distance < tolerance, F.struct(F.lit(rank).alias("rank"), distance.alias("distance"), F.col(f"{side}.idx").alias("idx")))

    out = near.withColumn("c", F.coalesce("c", within("stressed", 1, stressed), within("any", 2, any_), within("word", 3, word)))
    names = F.array(*[F.lit(s) for s in STRATEGIES])
    return out.select(*key, F.col("chord").alias("idx"), F.col("t").alias("anchor"), F.element_at(names, F.coalesce(F.col("c.rank"), F.lit(4)) + 1).alias("strategy"), F.col("c.idx").alias("target"), F.col("c.distance").alias("distance"))


def severity(score: Column) -> Column:
    """Grade of a score, worst first."""
    return F.when(score < 0.5, "CRITICAL").when(score < 0.7, "HIGH").when(score < 0.85, "MEDIUM").when(score < 0.95, "LOW").otherwise("NEGLIGIBLE")


def worst(scores: DataFrame, score: str, order: str, n: int = 20) -> DataFrame:
    """The n worst rows by severity and score; a top-n report."""
    grade = F.when(F.col(score) < 0.5, 0).when(F.col(score) < 0.7, 1).when(F.col(score) < 0.85, 2).when(F.col(score) < 0.95, 3).otherwise(4)
    return scores.withColumn("severity", severity(F.col(score))).withColumn("__grade", grade).orderBy("__grade", score, order).limit(n).drop("__grade")
