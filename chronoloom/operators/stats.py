"""Order statistics, weighted agreement and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64


def order_statistics(df: DataFrame, key: list[str], value: str, ranks: dict[str, Column], spread: bool = False, more: dict | None = None) -> DataFrame:
    """Exact elements of every key's sorted values: ``ranks`` maps names to 0-based ranks, as expressions of the count n. Returns key, n and a column per rank.

    The input is read once: values are counted (combined before the shuffle), and a key's different values pass one window that sums their counts up.
    spread: for keys of very many different values, these are laid into bins between approximate quantiles (bounded sketches, merged over the tasks), and only
    the bins that hold a wanted rank are sorted, about 1 / BINS of a key each; the counts are computed several times. Results are the same.
    more: further aggregates of all rows, null values included, as name: (aggregate, how it is merged); keys of null values only are kept then, with n = 0.
    """
    more = more or {}
    counts = df.groupBy(*key, F.col(value).alias("__v")).agg(F.count(value).alias("__c"), *[first.alias(f"__m_{name}") for name, (first, _) in more.items()])
    merged = [merge(f"__m_{name}").alias(name) for name, (_, merge) in more.items()]
    if spread:
        found = _spread_ranks(counts.where("__v IS NOT NULL").select(*key, "__v", "__c"), key, ranks)
        return counts.groupBy(*key).agg(*merged).join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))) if more else found
    whole = Window.partitionBy(*key)
    placed = counts.withColumns({"n": F.sum("__c").over(whole), "__upto": F.sum("__c").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))})
    here = lambda rank: (rank.cast("long") < F.col("__upto")) & (rank.cast("long") >= F.col("__upto") - F.col("__c"))
    found = placed.groupBy(*key).agg(F.max("n").alias("n"), *[F.max(F.when(here(rank), F.col("__v"))).alias(name) for name, rank in ranks.items()], *merged)
    return found if more else found.where("n > 0")


def _spread_ranks(counts: DataFrame, key: list[str], ranks: dict[str, Column]) -> DataFrame:
    edges = F.percentile_approx("__v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 10 * BINS)
    whole = counts.groupBy(*key).agg(F.sum("__c").alias("n"), edges.alias("__edges"))
    binned = counts.join(whole, key).withColumn("__bin", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")
    bins = binned.groupBy(*key, "__bin", "n").agg(F.sum("__c").alias("__in"))
    below = F.coalesce(F.sum("__in").over(Window.partitionBy(*key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = bins.withColumn("__below", below).withColumn("__r", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])))
    wanted = wanted.where((F.col("__r.rank") >= F.col("__below")) & (F.col("__r.rank") < F.col("__below") + F.col("__in"))).select(*key, "__bin", "__below", "__r")
    inside = Window.partitionBy(*key, "__bin", "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    candidates = binned.join(wanted, [*key, "__bin"]).withColumn("__upto", F.col("__below") + F.sum("__c").over(inside))
    found = candidates.where((F.col("__r.rank") < F.col("__upto")) & (F.col("__r.rank") >= F.col("__upto") - F.col("__c")))
    return found.groupBy(*key, "n").agg(*[F.max(F.when(F.col("__r.name") == name, F.col("__v"))).alias(name) for name in ranks])


def medians(df: DataFrame, key: list[str], value: str, name: str = "median", spread: bool = False, more: dict | None = None) -> DataFrame:
    """True median: the mean of the two middle values where their number is even. more: as in order_statistics."""
    n = F.col("n")
    found = order_statistics(df, key, value, {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)}, spread, more)
    return found.select(*key, ((F.col("__low") + F.col("__high")) / 2).alias(name), *(more or {}))


def confidence(df: DataFrame, key: list[str], value: str, spread: bool = False) -> DataFrame:
    """Mean, upper median x[n div 2] and x[n div 10] of the sorted values, all from one read."""
    n = F.col("n")
    ranks = {"upper_median": F.floor(n / 2), "p10": F.floor(n / 10)}
    return order_statistics(df, key, value, ranks, spread, {"__sum": (F.sum(value), F.sum)}).where("n > 0").withColumn("mean", F.col("__sum") / n).drop("__sum")


def tempo(beats: DataFrame, key: list[str], block: int | None = None, default_bpm: float = 60.0) -> DataFrame:
    """Beat period (upper median of gaps, from a default tempo below two beats), tempo, and mean gap (1 s below two beats)."""
    from . import blocks

    ahead = blocks.led(blocks.with_block(beats, "t", block), key, ["t", "idx"], {"__after": "t"}).select(*key, "t", (F.col("__after") - F.col("t")).alias("gap"))
    every = {"n_beats": (F.count("*"), F.sum), "first": (F.min("t"), F.min), "last": (F.max("t"), F.max)}
    whole = order_statistics(ahead, key, "gap", {"period": F.floor(F.col("n") / 2)}, block is not None, every)
    value = F.coalesce("period", F.lit(int(60e6 / default_bpm)))
    mean = F.when(F.col("n_beats") > 1, (F.col("last") - F.col("first")) / (F.col("n_beats") - 1)).otherwise(F.lit(1e6))
    return whole.select(*key, "n_beats", value.alias("period"), F.when(value > 0, 60e6 / value).alias("bpm"), mean.alias("mean_gap"))


def union_confidence(parts: list[DataFrame], keys: DataFrame, key: list[str]) -> DataFrame:
    """Mean over the union of several sets (key, confidence); 1.0 for keys without any."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = every.groupBy(*key).agg(F.avg("confidence").alias("confidence"))
    return keys.join(found, key, "left").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def bass_note(vectors: DataFrame, id_: str, vector: str, least: float = 0.5) -> DataFrame:
    """Strongest of the first twelve classes: (max - median) / max as confidence, null note below ``least`` or where nothing sounds."""
    twelve = F.slice(F.transform(vector, lambda x: x.cast("double")), F.lit(1), F.lit(12))
    ordered = F.array_sort(twelve)
    top = F.array_max(twelve)
    middle = (F.element_at(ordered, 6) + F.element_at(ordered, 7)) / 2
    sure = F.when(top > 0, F.greatest(F.lit(0.0), (top - middle) / top)).otherwise(F.lit(0.0))
    at = F.array_position(twelve, top) - 1
    return vectors.where(F.size(vector) >= 12).select(id_, F.when((top > 0) & (sure >= least), at).alias("pitch_class"), sure.alias("confidence"))


def chord_recall(reference: DataFrame, estimate: DataFrame, key: list[str], judge, silence: str = "N", block: int | None = None, every: bool = False) -> DataFrame:
    """Duration-weighted share of every reference's span (t0, t1, label) that the estimate meets, for keys that have both; every: all keys with a reference, null without an estimate.

    The estimate is clipped to the reference's intervals and padded with silence; judge(reference label, estimated label) is null where a stretch doesn't count.
    Both sides are read once and swept together.
    """
    from .intervals import swept

    cut = swept(reference, estimate, key, block, (None, silence))
    judged = F.when(F.col("left.label").isNotNull(), judge(F.col("left.label"), F.coalesce("right.label", F.lit(silence))))
    cut = cut.withColumns({"__hit": judged, "__long": (F.col("t1") - F.col("t")).cast("double")})  # the last boundary has no length
    hit, all_ = F.sum(F.when(F.col("__hit"), F.col("__long")).otherwise(0.0)), F.sum(F.when(F.col("__hit").isNotNull(), F.col("__long")).otherwise(0.0))
    found = cut.groupBy(*key).agg(F.when(all_ > 0, hit / all_).otherwise(0.0).alias("score"), F.max(F.col("left").isNotNull()).alias("__referred"), F.max(F.col("right").isNotNull()).alias("__estimated"))
    found = found.where("__referred")
    if every:
        return found.select(*key, F.when(F.col("__estimated"), F.col("score")).alias("score"))
    return found.where("__estimated").select(*key, "score")


def weighted_agreement(refined: DataFrame, key: list[str], match: Column, scorable: Column) -> DataFrame:
    """Duration-weighted share of matching stretches over scorable ones; 0 without any."""
    duration = (F.col("t1") - F.col("t0")).cast("double")
    hit = F.sum(F.when(scorable & match, duration).otherwise(0.0))
    all_ = F.sum(F.when(scorable, duration).otherwise(0.0))
    return refined.groupBy(*key).agg(F.when(all_ > 0, hit / all_).otherwise(0.0).alias("score"))
