"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source asks for its weight's share of the word budget and is clamped at ``max_epochs`` times its own
words; what the clamped sources cannot take is shared again, by weight, among the others until none exceeds
its clamp. In closed form: with the sources sorted by clamp / weight, the clamped ones are a prefix, and one
level per unit of weight holds for the rest.

Within a source, every document is repeated ``floor(target / words)`` times. The remainder goes to documents
in the order of a seeded digest until it is used up, the last one in part, so a source's taken words equal its
target to within one word. The order is found in two steps: words are summed by the digest's first three hex
digits (4,096 buckets a source), the buckets are cumulated, and only rows of one bucket are sorted together. The texts are
read once, or twice where columns of them are kept; the sums in between are a table in the shared folder. A source with a third of all rows is thereby spread over 4,096 groups.

Defined results: null text counts as no words; a null source is a source of its own, last in order; a row without a
doc_id is placed by its text's digest; identical rows share a digest and are told apart by nothing, so either may
take the part; a source without words has target 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows to one row per source: source_size, target.

    One row per source goes through one ordered window; the rows of the corpus do not.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (position + 1).cast("int"))
    weighed = by_source.withColumn("weight", weight).withColumn("clamp", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("clamp").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("clamp") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    )
    rest = F.when(~F.col("clamped"), F.struct("weight_left", "left"))
    level = F.max(rest).over(everything)  # the first that is not clamped has the most weight left
    target = F.when(F.col("clamped"), F.col("clamp").cast("double")).otherwise((F.col("weight") * level["left"]).cast("double") / level["weight_left"])
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42, keep=()) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken, and the columns named in keep."""
    sizes = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(docs["text"]).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))).cast("binary")).alias("digest"),
        *[docs[c].alias(f"__kept_{c}") for c in keep],
    ).withColumn("bucket", F.substring("digest", 1, 3))
    if not keep:
        sizes = written(sizes, "sizes")  # narrow rows: the texts are read once
    buckets = written(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    targets = source_targets(buckets.select("source", F.col("bucket_size").alias("size")), weights, max_epochs)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)))
    plan = buckets.join(targets, buckets["source"].eqNullSafe(targets["source"])).select(
        buckets["source"].alias("b_source"), buckets["bucket"].alias("b_bucket"), "before_bucket", "source_size", "target"
    )
    placed = sizes.join(plan, sizes["source"].eqNullSafe(plan["b_source"]) & (sizes["bucket"] == plan["b_bucket"]))
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("source_size")
    whole = F.when(words > 0, F.floor(F.col("target") / words)).otherwise(F.lit(0))
    placed = placed.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * words).cast("long"))
    before = F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return placed.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long")).select(
        "doc_id", "size", "source_size", "target", "taken", *[F.col(f"__kept_{c}").alias(c) for c in keep]
    )


#: The same rows without buckets, for DuckDB.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest
  FROM documents),
weighed AS (
  SELECT source, source_size, 3 * source_size AS clamp,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(clamp) OVER f, 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
  FROM weighed
  WINDOW f AS (ORDER BY clamp::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT left_over AS l, weight_left AS w FROM filled
  WHERE NOT (clamp * weight_left <= weight * left_over) ORDER BY weight_left DESC LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN clamp * weight_left <= weight * left_over THEN clamp::DOUBLE
              ELSE (weight * (SELECT l FROM level))::DOUBLE / (SELECT w FROM level)::DOUBLE END AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken
FROM placed
"""
