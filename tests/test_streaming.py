"""Adaptive sessions over a stream equal those of the batch, whatever the order of arrival and however often the query starts again."""

from pyspark.sql import functions as F

from chronoloom.operators import sessions
from chronoloom.plans import timed
from chronoloom.sources import adapters
from chronoloom.streaming.sessions import gap_blocks, late_rows

KEY = ["track_id"]
DAY = 86_400_000_000
SCHEMA = "track_id bigint, ts timestamp, t1 bigint, idx bigint"


def streamed(spark, tmp_path, thresholds, lateness, floor):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = gap_blocks(stream, thresholds, KEY, "section_gap", floor, lateness)
    query = found.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet")
    assert query.awaitTermination(240)
    return query


def arrive(words, tmp_path):
    words.select("track_id", F.timestamp_micros("t0").alias("ts"), "t1", "idx").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def last_word(spark):
    """A word of another track, long after all others: lets the watermark pass."""
    return spark.createDataFrame([(-1, 4_000_000_000_000_000, 4_000_000_000_000_000, 0)], "track_id bigint, t0 bigint, t1 bigint, idx bigint")


def found(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("track_id", "block", "t0", "t1", "n_words").collect())


def test_equals_the_batch_over_restarts(spark, tmp_path, sf_dir):
    words = adapters.words(spark, sf_dir).cache()
    thresholds = sessions.gap_thresholds(words, KEY, timed.RULES)
    arrive(words.where("idx % 3 = 0"), tmp_path)  # thirds out of order, within the lateness
    streamed(spark, tmp_path, thresholds, "4000 days", timed.RULES["section_gap"][1])
    arrive(words.where("idx % 3 = 1"), tmp_path)
    streamed(spark, tmp_path, thresholds, "4000 days", timed.RULES["section_gap"][1])
    arrive(words.where("idx % 3 = 2"), tmp_path)
    arrive(last_word(spark), tmp_path)
    query = streamed(spark, tmp_path, thresholds, "4000 days", timed.RULES["section_gap"][1])
    want = timed.q_gap_blocks(spark, sf_dir).select("track_id", "block", "t0", "t1", "n_words")
    got = found(spark, tmp_path)
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > len({r[0] for r in got}) and late_rows(query) == 0


S = 1_000_000


def test_ends_thresholds_and_late_words(spark, tmp_path):
    rows = lambda *w: spark.createDataFrame([(k, a * S, b * S, i) for k, a, b, i in w], "track_id bigint, t0 bigint, t1 bigint, idx bigint")
    thresholds = spark.createDataFrame([(1, 10.0 * S)], "track_id bigint, section_gap double")
    arrive(rows((1, 1, 30, 0), (1, 5, 6, 1), (1, 17, 18, 2), (1, 28, 29, 3), (2, 1, 2, 0), (2, 3, 4, 1), (2, 7, 8, 2)), tmp_path)  # the second word's end counts, not the first's; 10 s is not beyond
    arrive(rows((3, 1000, 1001, 0)), tmp_path)
    streamed(spark, tmp_path, thresholds, "20 seconds", 2.0 * S)
    assert found(spark, tmp_path) == [(1, 0, S, 6 * S, 2), (1, 1, 17 * S, 29 * S, 2), (2, 0, S, 4 * S, 2), (2, 1, 7 * S, 8 * S, 1)]
    arrive(rows((1, 40, 41, 4), (2, 990, 991, 3)), tmp_path)  # the first is late, the second goes on with the numbers
    query = streamed(spark, tmp_path, thresholds, "20 seconds", 2.0 * S)
    assert late_rows(query) == 1
    arrive(last_word(spark), tmp_path)
    streamed(spark, tmp_path, thresholds, "20 seconds", 2.0 * S)
    assert found(spark, tmp_path)[-2:] == [(2, 2, 990 * S, 991 * S, 1), (3, 0, 1000 * S, 1001 * S, 1)]
