"""What is left over goes in between: orphans drained in order of time between words, lines and after the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .render import joined


def slots(words: DataFrame, key: list[str], line: str, tail: int) -> DataFrame:
    """Places for orphans in document order, with the time up to which (exclusive) each takes them: key, slot, line, idx (null: before the line), until.

    words: key, line, n (1, 2, ... in document order), idx, t0, t1. Before a line until its first word starts, after a word until the
    next of its line starts, after a line's last word until ``tail`` past its end.
    """
    inside = Window.partitionBy(*key, line).orderBy("n")
    until = F.coalesce(F.lead("t0").over(inside), F.col("t1") + tail)
    marked = words.withColumns({"__until": until, "__first": F.row_number().over(inside) == 1})
    after = F.struct((2 * F.col("n")).alias("slot"), F.col("idx").cast("long").alias("idx"), F.col("__until").cast("long").alias("until"))
    before = F.when(F.col("__first"), F.struct((2 * F.col("n") - 1).alias("slot"), F.lit(None).cast("long").alias("idx"), F.col("t0").cast("long").alias("until")))
    return marked.select(*key, line, F.inline(F.array_compact(F.array(before, after))))


def drain(orphans: DataFrame, places: DataFrame, key: list[str], line: str, block: int | None = None) -> DataFrame:
    """Orphans (key, t, further columns) with slot, line and idx of the first place in document order that takes them; null after the last.

    Only places that take later orphans than all before them can be first, so one as-of look at these, in order of time, is enough.
    """
    before = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    records = places.withColumn("__so_far", F.max("until").over(before)).where(F.col("__so_far").isNull() | (F.col("until") > F.col("__so_far")))
    place = F.struct("slot", F.col(line).alias("line"), "idx")
    left = orphans.select(*key, F.col("t").alias("__t"), F.lit(1).alias("__side"), F.struct(*orphans.columns).alias("__row"), F.lit(None).cast(records.select(place.alias("p")).schema["p"].dataType).alias("__place"))
    right = records.select(*key, F.col("until").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), place.alias("__place"))
    found = blocks.carried(blocks.with_block(left.unionByName(right), "__t", block), key, ["__t", "__side"], ["__place"]).where("__side = 1")
    return found.select("__row.*", F.col("next___place.slot").alias("slot"), F.col("next___place.line").alias(line), F.col("next___place.idx").alias("at_word"))


def rendered(words: DataFrame, drained: DataFrame, key: list[str], line: str, mark: str, trailing: str = "{c: trailing beats (after last section)}") -> DataFrame:
    """Text of every key: lines of words with the marks that were drained between them, marks before a line on a line of their own, the rest at the end.

    words: key, line, n, text; drained: as from ``drain``, with an order t and the column ``mark``.
    """
    piece = F.struct("t", F.col(mark).alias("piece"))
    of_slot = drained.where("slot IS NOT NULL").groupBy(*key, line, "slot").agg(joined(F.collect_list(piece), " ").alias("piece"))
    inline = words.select(*key, line, (2 * F.col("n")).alias("order"), F.lit(0).alias("kind"), F.col("text").alias("piece"))
    marks = of_slot.select(*key, line, F.col("slot").alias("order"), F.when(F.col("slot") % 2 == 0, 1).otherwise(-1).alias("kind"), "piece")
    every = inline.unionByName(marks).groupBy(*key, line).agg(F.array_sort(F.collect_list(F.struct("order", "kind", "piece"))).alias("all"))
    text = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: x["piece"]), " ")
    lines = every.select(*key, F.col(line).alias("seq"), F.concat_ws("\n", F.nullif(text(lambda x: x["kind"] < 0), F.lit("")), text(lambda x: x["kind"] >= 0)).alias("piece"))
    rest = drained.where("slot IS NULL").groupBy(*key).agg(F.concat_ws("\n", F.lit(trailing), joined(F.collect_list(piece), " ")).alias("__rest"))
    body = lines.groupBy(*key).agg(joined(F.collect_list(F.struct("seq", "piece")), "\n").alias("__body"))
    return body.join(rest, key, "full").select(*key, F.concat_ws("\n", "__body", "__rest").alias("body"))
