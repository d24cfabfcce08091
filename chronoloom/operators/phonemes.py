"""Timed syllables from timed phonemes, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def syllables(words: DataFrame, phonemes: DataFrame, key: list[str]) -> DataFrame:
    """Syllables by maximal onset: (key, word, i, text, t0, t1, stressed, first, last).

    words: key, idx, text, t0, t1, one row an idx. phonemes: key, word (an idx), n (their order, no ties), symbol, t0, t1; those of no word are left out.
    Every vowel is a syllable with the consonants before it; those after the last one join it. Its text is the symbols, its time the first one's start and
    the last one's end, and it is stressed if one of them has primary stress; first and last number the word's phonemes from 0. A word without
    vowels is one syllable by its own text, over its phonemes' time; one without phonemes over its own, first and last null. A null symbol is a
    consonant without text. Words are grouped one by one, so a long track is spread over its words; one shuffle, and one for the words' join.
    """
    by = [*key, "word"]
    w = Window.partitionBy(*by).orderBy("n")
    vowel = F.coalesce(text.is_vowel(F.col("symbol")), F.lit(False)).cast("int")
    primary = F.coalesce(text.stress_level(F.col("symbol")) == 1, F.lit(False))
    flagged = phonemes.select(*by, "n", "symbol", "t0", "t1", vowel.alias("__vowel"), primary.alias("__primary"))
    before = F.sum("__vowel").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__vowel")
    total = F.sum("__vowel").over(Window.partitionBy(*by))
    marked = flagged.select(*by, "n", "symbol", "t0", "t1", "__primary", before.alias("__before"), total.alias("__vowels"), (F.row_number().over(w) - 1).alias("__at"))
    grouped = marked.groupBy(*by, F.least(F.col("__before"), F.greatest(F.lit(0), F.col("__vowels") - 1)).cast("int").alias("i")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("symbol", F.lit("")).alias("s")))), lambda x: x["s"]), "").alias("symbols"),
        F.min(F.struct("n", "t0"))["t0"].alias("__t0"),
        F.max(F.struct("n", "t1"))["t1"].alias("__t1"),
        F.bool_or("__primary").alias("stressed"),
        F.min("__at").alias("first"),
        F.max("__at").alias("last"),
        F.first("__vowels").alias("__vowels"),
    )
    named = words.select(*key, F.col("idx").alias("word"), "text", F.col("t0").alias("__w0"), F.col("t1").alias("__w1"))
    joined = named.join(grouped, by, "left")
    sounds = F.col("__vowels") > 0
    return joined.select(
        *by,
        F.coalesce("i", F.lit(0)).alias("i"),
        F.when(sounds, F.col("symbols")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("first").isNull(), F.col("__w0")).otherwise(F.col("__t0")).alias("t0"),
        F.when(F.col("first").isNull(), F.col("__w1")).otherwise(F.col("__t1")).alias("t1"),
        F.coalesce(sounds & F.col("stressed"), F.lit(False)).alias("stressed"),
        "first",
        "last",
    )


def groups(symbols: Column) -> Column:
    """Symbols of one pronunciation as an array per syllable; without vowels one, without symbols none."""
    flags = F.transform(symbols, lambda s: F.coalesce(text.is_vowel(s), F.lit(False)))
    ids = text.phoneme_groups(flags)
    each = lambda g: F.transform(F.sequence(F.lit(0), F.array_max(g)), lambda k: F.filter(symbols, lambda s, i: F.get(g, i) == k))
    return text.let(ids, lambda g: F.when(F.size(symbols) > 0, each(g)).otherwise(F.array().cast("array<array<string>>")))


def spelled(word: Column) -> Column:
    """A word's syllables by its letters, the word itself where it has none."""
    return text.let(text.syllables(word), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(word)))
