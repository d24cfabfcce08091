"""Rules over rows as queries: what breaks them comes back as rows with the rule's name (V1-V7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching


def rules(t0: str | None = None, t1: str | None = None, confidence: str | None = None, ranges: dict[str, tuple] | None = None, sets: dict[str, tuple] | None = None) -> dict[str, Column]:
    """Named conditions that hold for good rows."""
    out: dict[str, Column] = {}
    if t0:
        out["start_not_negative"] = F.col(t0) >= 0
    if t0 and t1:
        out["end_not_before_start"] = F.col(t1) >= F.col(t0)
    if confidence:
        out["confidence_in_unit"] = F.col(confidence).between(0, 1)
    for column, (low, high) in (ranges or {}).items():
        parts = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)
        out[f"{column}_in_range"] = reduce(lambda a, b: a & b, parts)
    for column, values in (sets or {}).items():
        out[f"{column}_allowed"] = F.col(column).isin(*values)
    return out


def violations(df: DataFrame, id_: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per broken rule; null counts as broken. A single pass over df."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(*id_, F.explode(broken).alias("rule"))


def strict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The same rows; the job fails at the first row that breaks a rule."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks.values()])
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a row breaks a rule: " + ", ".join(checks))).cast("boolean")))


def with_reason(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Adds the first reason for which a row fails, null where it doesn't; a bad row never stops the others."""
    return df.withColumn("reason", F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()]))


def rollup(marked: DataFrame, skipped: int = 0) -> DataFrame:
    """Mean score of rows without a reason to fail (0.0 without any), attempted, failed, skipped; one pass."""
    failed = F.count("reason")
    mean = F.coalesce(F.avg(F.when(F.col("reason").isNull(), F.col("score"))), F.lit(0.0))
    return marked.agg(mean.alias("mean_score"), F.count("*").alias("attempted"), failed.alias("failed")).withColumn("skipped", F.lit(skipped))


def beat_agreement(reference: DataFrame, estimate: DataFrame, key: list[str], tolerance: int = 70_000, trim: int = 0, block: int | None = None) -> DataFrame:
    """F-measure of two sets of beat times (t) per key: one-to-one matches in order of time within the tolerance; every reference takes the first free estimate in reach.

    Times before trim, and null ones, take no part. With blocks, a key's matching is spread over the tasks (``matching``); results do not depend on them.
    """
    both = reference.select(*key, "t", F.lit(0).alias("side")).union(estimate.select(*key, "t", F.lit(1).alias("side"))).where(F.col("t") >= trim)
    found = matching.matched(both, key, tolerance, block)
    return found.withColumn("f_measure", F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("n_ref") + F.col("n_est"))).otherwise(0.0))
