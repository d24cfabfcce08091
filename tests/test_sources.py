"""Readers, stage tables, engines, streams, and the registry of queries."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoloom.plans import plugins
from chronoloom.sources import readers
from chronoloom.streaming.sessions import session_counts


def test_corpus(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text('title,external_link,chordpro\nA,https://youtu.be/abcdefghijk,"[C]x\n[G]""y"""\nB,,z\nC,https://www.youtube.com/watch?v=ABCDEFGHIJK,q\n')
    songs, skipped = readers.read_corpus(spark, str(path))
    assert sorted(r["link_id"] for r in songs.collect()) == ["ABCDEFGHIJK", "abcdefghijk"]
    assert skipped.first()["skipped"] == 1
    path.write_text("title\nA\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_corpus(spark, str(path))


def test_missing(spark):
    wanted, there = spark.createDataFrame([(2,), (3,)], "id int"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert [r["id"] for r in readers.missing(wanted, there, ["id"]).collect()] == [3]


def test_corrupt_cache_counts_as_missing(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{nope",), (None,)], "j string")
    got = [r["value"]["a"] if r["value"] else None for r in readers.parsed_cache(rows, "j", "a int").collect()]
    assert got == [1, None, None]


def test_segments(spark):
    rows = [("t", 0, " Hello ", 100, 150), ("t", 1, "[Música]", 0, 1), ("t", 2, "[]", 0, 1), ("t", 3, "Hello [pause] world", 5, 2), ("t", 4, "  ", 0, 1)]
    got = readers.segment_words(spark.createDataFrame(rows, "track_id string, seq int, text string, t0_cs int, t1_cs int")).collect()
    assert [(r["text"], r["t0"], r["t1"]) for r in got] == [("Hello", 1_000_000, 1_500_000), ("Hello [pause] world", 50_000, 50_000)]


def test_content_ids_and_stems(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert readers.content_ids(spark, str(tmp_path)).first()["content_id"] == "ba7816bf8f01cfea"
    files = spark.createDataFrame([("t", "a_(Vocals).wav"), ("t", "a_(Drums).wav")], "track_id string, path string")
    assert readers.stems(files).first()["missing"] == ["Bass", "Other"]
    with pytest.raises(Exception, match="not exactly 4 stems: t"):
        readers.stems(files, strict=True).collect()
    four = spark.createDataFrame([("t", f"a_({n}).wav") for n in ("Vocals", "Drums", "Bass", "Other")], "track_id string, path string")
    assert readers.stems(four, strict=True).first()["Bass"] == "a_(Bass).wav"
    with pytest.raises(Exception, match="not exactly"):
        readers.stems(four.unionByName(spark.createDataFrame([("t", "b_(Bass).wav")], files.schema)), strict=True).collect()


def test_fixtures(spark):
    f = readers.fixtures(spark)
    assert [f[n].count() for n in ("words", "chords", "beats")] == [3, 4, 8]


def test_engines(spark):
    def double(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([2 * x for x in b.column(0).to_pylist()], pa.int64())], ["y"])

    plugins.register("chords", plugins.Engine("mock", "y bigint", double))
    plugins.register("chords", plugins.Engine("absent", "y bigint", double, ("no_such_module_here",)))
    assert sorted(r["y"] for r in plugins.apply(spark.range(3), "chords").collect()) == [0, 2, 4]
    with pytest.raises(plugins.EngineUnavailableError):
        plugins.select("chords", "absent")
    with pytest.raises(ValueError):
        plugins.select("chords", "nothing")


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    far = spark.createDataFrame([(-1, "2100-01-01 00:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = session_counts(stream, "user_id", "ts", "6 hours", "60 days").writeStream.outputMode("append").format("memory").queryName("sessions_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    far.write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("sessions_out").where("user_id >= 0").collect())
    assert got == sorted(tuple(r) for r in session_counts(events, "user_id", "ts", "6 hours").collect())


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {n for n in queries if n.startswith("q_")} <= set(oracles)
    assert entry.entry(spark).count() > 0
