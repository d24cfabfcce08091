"""Sources: catalogues, title maps, hashes, segments (S1, S2, S6, S8, S9, S12, J10); stage tables are in stages.py, sinks and logs in sinks.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import link_id


def read_corpus(spark: SparkSession, path: str, required=("title", "external_link", "chordpro")) -> tuple[DataFrame, DataFrame]:
    """Songs with a known link id, and a one-row count of skipped ones. A missing column is an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    marked = rows.withColumn("link_id", link_id(F.coalesce("external_link", F.lit(""))))
    return marked.where("link_id IS NOT NULL"), marked.agg(F.count_if(F.col("link_id").isNull()).alias("skipped"))


def title_map(rows: DataFrame, id_: str, title: str, order: str) -> DataFrame:
    """id -> title of the last row in order."""
    return rows.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.max(F.struct(order, title))[title].alias(title))


def content_ids(spark: SparkSession, path: str) -> DataFrame:
    """First 16 hex digits of every file's SHA-256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("content_id"))


def named_ids(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Ids of listed files (path): of their content, or of the path itself where there is no content to read."""
    known = contents.select(F.col("path").alias("__path"), "content_id")
    return files.join(known, files["path"] == known["__path"], "left").select(*files.columns, F.coalesce("content_id", F.substring(F.sha2(files["path"].cast("binary"), 256), 1, 16)).alias("content_id"))


def parsed_cache(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """Cached JSON values; corrupt ones become null and so count as missing."""
    return rows.withColumn("value", F.from_json(json, schema, {"mode": "PERMISSIVE"}))


def missing(wanted: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """Keys that still have to be computed."""
    return wanted.join(cached.select(*key), key, "left_anti")


def segment_words(segments: DataFrame) -> DataFrame:
    """Segments in centiseconds to words in microseconds: trimmed, empty and wholly bracketed ones dropped, ends not before starts."""
    text = F.trim("text")
    kept = segments.where((text != "") & ~text.rlike(r"^\s*\[[^\[\]]*\]\s*$"))
    return kept.select("track_id", "seq", text.alias("text"), (F.col("t0_cs") * 10_000).cast("long").alias("t0"), (F.greatest("t0_cs", "t1_cs") * 10_000).cast("long").alias("t1"))


def stems(files: DataFrame, wanted=("Vocals", "Drums", "Bass", "Other"), strict: bool = False) -> DataFrame:
    """One row per track with a path per stem, and the names that are missing. strict: a track without exactly one file of each is an error when its row is made."""
    named = files.withColumn("stem", F.regexp_extract("path", r"\(([A-Za-z]+)\)", 1))
    wide = named.groupBy("track_id").pivot("stem", list(wanted)).agg(F.min("path"))
    if strict:
        sizes = named.groupBy("track_id").agg(F.count("*").alias("__files"))
        whole = (F.col("__files") == len(wanted)) & F.forall(F.array(*wanted), lambda p: p.isNotNull())
        told = F.concat(F.lit(f"not exactly {len(wanted)} stems: "), F.col("track_id"))
        wide = wide.join(sizes, "track_id").withColumn("track_id", F.when(whole, F.col("track_id")).otherwise(F.raise_error(told))).drop("__files")
    return wide.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(w).isNull(), F.lit(w)) for w in wanted])))


def fixtures(spark: SparkSession) -> dict[str, DataFrame]:
    """A small deterministic track: 8 s, three words, four chords, eight beats at 60 a minute, downbeats every four."""
    s = 1_000_000
    words = [("t", i, w, a, b) for i, (w, a, b) in enumerate((("hello", 0, s // 2), ("world", 6 * s // 10, s), ("test", 11 * s // 10, 15 * s // 10)))]
    chords = [("t", i, c, 2 * i * s, 2 * (i + 1) * s) for i, c in enumerate(("C", "G", "Am", "F"))]
    beats = [("t", i, i * s, i % 4 == 0) for i in range(8)]
    return {
        "tracks": spark.createDataFrame([("t", 8 * s)], "track_id string, duration bigint"),
        "words": spark.createDataFrame(words, "track_id string, idx bigint, text string, t0 bigint, t1 bigint"),
        "chords": spark.createDataFrame(chords, "track_id string, idx bigint, symbol string, t0 bigint, t1 bigint"),
        "beats": spark.createDataFrame(beats, "track_id string, idx bigint, t bigint, downbeat boolean"),
    }
