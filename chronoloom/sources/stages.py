"""Stage tables: one value per track and stage, kept between runs (K1, K2, K7, S3).

A stage is a table under ``<root>/<stage>`` that is only appended to: every write adds the rows of its keys with a version, and a
key's row of the highest version counts. So replacing single keys touches no other key, a write that fails leaves nothing behind (its
files are never committed), and several writers don't disturb each other. Values are JSON text. What can't be read is a miss: an absent
stage, a value that isn't JSON of the wanted schema, and a file that isn't Parquet. ``compact`` rewrites a stage without the rows that
no longer count.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the stages (fixed values).
STAGES = ("stems", "transcription", "alignment", "chords", "beats", "syllables", "document", "provenance")
#: Characters that an id has at least (fixed value).
ID_LENGTH = 4
KEY = "audio_id"
_STORED = f"{KEY} string, version long, value string"


def _folder(root: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(STAGES)}")
    return f"{root}/{stage}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checked(id_: Column) -> Column:
    """The id; one that is null or too short is an error when the row is made."""
    return F.when(F.length(id_) >= ID_LENGTH, id_).otherwise(F.raise_error(F.concat(F.lit("id too short: "), F.coalesce(id_, F.lit("null"))))).cast("string")


def as_json(value: Column) -> Column:
    """JSON text of a struct, array or map; null if the value is null."""
    return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))


def write_stage(rows: DataFrame, root: str, stage: str, version: int | None = None) -> None:
    """Append rows (audio_id, value: struct, array or map); they replace those of the same ids. version: microseconds now, if not given."""
    stamp = time.time_ns() // 1000 if version is None else version
    rows.select(checked(F.col(KEY)).alias(KEY), F.lit(stamp).cast("long").alias("version"), as_json(F.col("value")).alias("value")).write.mode("append").parquet(_folder(root, stage))


def stored(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """audio_id, version, value (text) of the row that counts for each id; no rows for an absent stage."""
    path = _folder(root, stage)
    if not _exists(spark, path):
        return spark.createDataFrame([], _STORED)
    rows = spark.read.option("ignoreCorruptFiles", "true").schema(_STORED).parquet(path)
    return rows.groupBy(KEY).agg(F.max(F.struct("version", "value")).alias("last")).select(KEY, "last.*")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with their value as the schema's type; null where the text isn't such JSON (a field of another type included; a missing one is null)."""
    found = F.from_json(F.concat(F.lit('{"x":'), "value", F.lit("}")), f"x {schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return rows.withColumn("value", F.when(found["__bad"].isNull(), found["x"]))


def read_stage(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """audio_id, value of all hits."""
    return parsed(stored(spark, root, stage).drop("version"), schema).where("value IS NOT NULL")


def unreadable(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """Ids whose value can't be read, with its text: for a log; the runner computes them again."""
    rows = stored(spark, root, stage).select(KEY, F.col("value").alias("text"), "value")
    return parsed(rows, schema).where("value IS NULL").select(KEY, "text")


def compact(spark: SparkSession, root: str, stage: str) -> None:
    """Rewrite a stage with the rows that count, in a new folder that then takes the old one's place. Not while others write."""
    path = _folder(root, stage)
    if not _exists(spark, path):
        return
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    stored(spark, root, stage).write.parquet(fresh)
    to = spark._jvm.org.apache.hadoop.fs.Path
    files = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.rename(to(path), to(old))
    files.rename(to(fresh), to(path))
    files.delete(to(old), True)


def fill(wanted: DataFrame, root: str, stage: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> None:
    """Write to the stage what compute makes of the wanted rows (audio_id and further columns) that it has no value of; where none is missing, compute isn't called."""
    missing = wanted.join(read_stage(wanted.sparkSession, root, stage, schema).select(KEY), KEY, "left_anti")
    if not missing.isEmpty():
        write_stage(compute(missing), root, stage)


def compute_missing(wanted: DataFrame, root: str, stage: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """audio_id, value of all wanted ids, those that were missing computed and written back."""
    fill(wanted, root, stage, schema, compute)
    return read_stage(wanted.sparkSession, root, stage, schema).join(wanted.select(KEY), KEY, "left_semi")
