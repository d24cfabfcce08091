"""The driver's tables as timed-event tables: a user is a track, times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks

TRACK = ["track_id"]
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, *kinds: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("track_id"), micros.alias("t"), F.col("event_id").alias("idx"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


_WIDTHS: dict = {}


def block_width(spark, sf_dir) -> int | None:
    """Block width for the events' tracks, measured once per table and session; None while no track is large."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _WIDTHS:
        e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
        _WIDTHS[known] = blocks.width_for(e, TRACK, "t")
    return _WIDTHS[known]


def beats(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "error").select("track_id", "t", "idx")


def downbeats(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "signup").select("track_id", "t", "idx")


def grid(spark, sf_dir) -> DataFrame:
    """Beats and downbeats as one sequence with a flag."""
    return _events(spark, sf_dir, "error", "signup").select("track_id", "t", "idx", (F.col("event_type") == "signup").alias("downbeat"))


def onsets(spark, sf_dir) -> DataFrame:
    """Chord onsets with a pitch class, as a label; class 11 stands for no chord."""
    pc = F.col("k") % 12
    return _events(spark, sf_dir, "purchase").select("track_id", "t", "idx", pc.alias("pc"), F.when(pc == 11, "N").otherwise(pc.cast("string")).alias("label"))


def words(spark, sf_dir) -> DataFrame:
    """Views and clicks as words: value is a length in minutes, a click is stressed."""
    e = _events(spark, sf_dir, "view", "click")
    return e.select("track_id", F.col("t").alias("t0"), (F.col("t") + F.round(F.col("value") * 60_000_000).cast("long")).alias("t1"), "idx", (F.col("event_type") == "click").alias("stressed"))


#: The same tables for DuckDB, as common table expressions.
CTES = {
    "beats": "beats AS (SELECT user_id AS track_id, epoch_us(ts) AS t, event_id AS idx FROM events WHERE event_type = 'error')",
    "downbeats": "downbeats AS (SELECT user_id AS track_id, epoch_us(ts) AS t, event_id AS idx FROM events WHERE event_type = 'signup')",
    "grid": "grid AS (SELECT user_id AS track_id, epoch_us(ts) AS t, event_id AS idx, event_type = 'signup' AS downbeat FROM events WHERE event_type IN ('error', 'signup'))",
    "onsets": "onsets AS (SELECT user_id AS track_id, epoch_us(ts) AS t, event_id AS idx, CAST(json_extract_string(props, '$.k') AS INT) % 12 AS pc, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 12 = 11 THEN 'N' ELSE CAST(CAST(json_extract_string(props, '$.k') AS INT) % 12 AS VARCHAR) END AS label FROM events WHERE event_type = 'purchase')",
    "words": "words AS (SELECT user_id AS track_id, epoch_us(ts) AS t0, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS t1, event_id AS idx, event_type = 'click' AS stressed FROM events WHERE event_type IN ('view', 'click'))",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names)


def documents_words(spark, sf_dir) -> DataFrame:
    """doc_id and the array of all words of every text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def distinct_words(spark, sf_dir) -> DataFrame:
    return documents_words(spark, sf_dir).select(F.explode("words").alias("word")).distinct()


def durations(spark, sf_dir) -> DataFrame:
    """Track lengths: a day after the last event."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("track_id")).agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) + DAY).alias("duration"))


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
