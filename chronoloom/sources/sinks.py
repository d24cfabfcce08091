"""Sinks and logs: rendered documents as text or JSON, correction logs, scans of cached documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a correction log (fixed names): one row per log, its corrections as an array.
CORRECTIONS = (
    "audio_id string, schema_version int, corrections array<struct<audio_id: string, timestamp: double, field: string, original: map<string, string>, "
    "corrected: map<string, string>, user_id: string, note: string, created_at: string>>"
)
#: What a correction can be about (fixed values).
CORRECTED_FIELDS = ("chord_symbol", "chord_position", "word_text", "word_timestamp", "syllable_position", "beat_position", "meter")


def write_documents(documents: DataFrame, path: str, id_: str, text: str = "document") -> None:
    """One folder per id with the document's text; what was there before goes, so nothing stale stays (K3, K5)."""
    documents.select(id_, F.col(text).alias("value")).repartition(id_).write.mode("overwrite").partitionBy(id_).option("lineSep", "\n").text(path)


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def scan_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """All cached JSON documents with the file each is from, and the files that can't be read, with what they hold (S4). One bad file stops nothing."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    rows = rows.withColumn("document", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    broken = F.col("document").isNull() | F.col("document._corrupt_record").isNotNull()
    good = rows.where(~broken).select("file", "document.*").drop("_corrupt_record")
    return good, rows.where(broken).select("file", F.col("value").alias("record"))


def save_corrections(log: DataFrame, path: str) -> None:
    """A log of rows (audio_id, timestamp, field, ...) as one JSON object per audio_id (K6)."""
    entry = F.struct("audio_id", "timestamp", "field", "original", "corrected", "user_id", "note", "created_at")
    grouped = log.groupBy("audio_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "created_at", F.to_json(entry).alias("entry")))).alias("all"))
    entries = F.transform("all", lambda x: F.from_json(x["entry"], log.select(entry.alias("e")).schema["e"].dataType.simpleString()))
    grouped.select("audio_id", F.lit(1).alias("schema_version"), entries.alias("corrections")).write.mode("overwrite").json(path)


def load_corrections(spark: SparkSession, path: str) -> DataFrame:
    """One row per correction, in any order."""
    return spark.read.schema(CORRECTIONS).json(path).select(F.inline("corrections"))


def correction_rules() -> dict:
    """Conditions of good corrections, for ``validate.violations``."""
    return {"field_allowed": F.col("field").isin(*CORRECTED_FIELDS), "timestamp_not_negative": F.col("timestamp") >= 0}


def head(songs: DataFrame, order: str, n: int) -> DataFrame:
    """The first n songs in file order (a sample is the feature)."""
    return songs.orderBy(order).limit(n)


def pinned(songs: DataFrame, id_: str, ids: list[str]) -> DataFrame:
    """The songs of a given list, in its order; an error names the ids that are missing (T5). The list is a parameter."""
    spark = songs.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"position int, {id_} string")
    absent = [r[0] for r in wanted.join(songs.select(F.col(id_).cast("string")), id_, "left_anti").orderBy("position").select(id_).collect()]
    if absent:
        raise ValueError(f"not in the corpus: {', '.join(absent)}")
    return songs.join(F.broadcast(wanted), songs[id_].cast("string") == wanted[id_]).orderBy("position").select(*[songs[c] for c in songs.columns])


def write_report(lines: DataFrame, folder: str, day: str) -> str:
    """A report's rows (``render.report_lines``) as text under the day's folder, in order over the part files; a report of the same day is replaced (K4)."""
    path = f"{folder}/{day}/top-divergences"
    lines.orderBy("part", "at", "line").select("line").write.mode("overwrite").text(path)
    return path
