"""Stage tables, and the runner over them from end to end."""

import glob

import pytest

from chronoloom.plans import plugins, transcribe
from chronoloom.sources import stages

CHORDS = "array<struct<idx: bigint, symbol: string>>"


def values(spark, rows):
    return spark.createDataFrame([(i, [(k, s) for k, s in enumerate(v)]) for i, v in rows], f"audio_id string, value {CHORDS}")


def found(df):
    return {r["audio_id"]: [x["symbol"] for x in r["value"]] for r in df.collect()}


def test_keys_are_replaced_alone(spark, tmp_path):
    root = str(tmp_path)
    assert stages.read_stage(spark, root, "chords", CHORDS).count() == 0  # an absent stage is all misses
    stages.write_stage(values(spark, [("aaaa", "CG"), ("bbbb", "F")]), root, "chords")
    stages.write_stage(values(spark, [("bbbb", "DA"), ("cccc", "")]), root, "chords")
    assert found(stages.read_stage(spark, root, "chords", CHORDS)) == {"aaaa": ["C", "G"], "bbbb": ["D", "A"], "cccc": []}
    stages.compact(spark, root, "chords")
    assert found(stages.read_stage(spark, root, "chords", CHORDS)) == {"aaaa": ["C", "G"], "bbbb": ["D", "A"], "cccc": []}
    assert spark.read.parquet(f"{root}/chords").count() == 3 and glob.glob(f"{root}/chords*") == [f"{root}/chords"]


def test_ids_and_names(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown stage 'nothing'"):
        stages.read_stage(spark, str(tmp_path), "nothing", CHORDS)
    for bad in ("abc", None):
        with pytest.raises(Exception, match="id too short"):
            stages.write_stage(values(spark, [(bad, "C"), ("aaaa", "C")]), str(tmp_path), "chords")
    assert stages.read_stage(spark, str(tmp_path), "chords", CHORDS).count() == 0  # nothing of a failed write


def test_corrupt_values_and_files_are_misses(spark, tmp_path):
    root = str(tmp_path)
    stages.write_stage(values(spark, [("aaaa", "C"), ("bbbb", "G"), ("cccc", "F")]), root, "chords")
    raw = [("aaaa", "{not json"), ("bbbb", '[{"idx": "x", "symbol": 3}]')]
    spark.createDataFrame([(i, 1 << 60, t) for i, t in raw], "audio_id string, version long, value string").write.mode("append").parquet(f"{root}/chords")
    (tmp_path / "chords" / "part-9.parquet").write_bytes(b"no parquet at all")
    assert found(stages.read_stage(spark, root, "chords", CHORDS)) == {"cccc": ["F"]}
    assert {r["audio_id"]: r["text"] for r in stages.unreadable(spark, root, "chords", CHORDS).collect()} == dict(raw)


def test_only_missing_keys_are_computed(spark, tmp_path):
    root, seen = str(tmp_path), []
    stages.write_stage(values(spark, [("aaaa", "C")]), root, "chords")

    def compute(missing):
        seen.append(sorted(r["audio_id"] for r in missing.collect()))
        return values(spark, [(i, "X") for i in seen[-1]])

    wanted = spark.createDataFrame([("aaaa", 1), ("bbbb", 2)], "audio_id string, more int")
    for _ in range(2):
        assert found(stages.compute_missing(wanted, root, "chords", CHORDS, compute)) == {"aaaa": ["C"], "bbbb": ["X"]}
    assert seen == [["bbbb"]]


@pytest.fixture()
def spied(monkeypatch):
    chosen = []
    choose = plugins.select
    monkeypatch.setattr(plugins, "select", lambda stage, name=plugins.MOCK: chosen.append(stage) or choose(stage, name))
    return chosen


def audio(spark, *ids):
    return spark.createDataFrame([(i, f"/music/{i}.mp3") for i in ids], "audio_id string, path string")


EXPECTED = """{title: song}
{tempo: 60}
{meta: chronoloom_version 0.3}
{meta: audio_id song}

{start_of_verse: Verse 1}
[C]hello world test
{end_of_verse}
{c: Outro}
[G]x///   [Am]x///   [F]x///"""


def test_from_end_to_end(spark, tmp_path, spied):
    root = str(tmp_path)
    first = transcribe.transcribe(spark, audio(spark, "song", "tune"), root, transcribe.Options(language="en")).collect()
    texts = {r["audio_id"]: r["value"]["text"] for r in first}
    assert texts["song"] == EXPECTED and texts["tune"] == EXPECTED.replace("song", "tune")
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{root}/*")) == sorted(stages.STAGES)
    assert sorted(spied) == sorted(transcribe.ENGINES.values())
    # A second run chooses no engine and writes nothing; a new track is computed alone.
    del spied[:]
    files = sorted(glob.glob(f"{root}/*/*.parquet"))
    assert {r["audio_id"]: r["value"]["text"] for r in transcribe.transcribe(spark, audio(spark, "song", "tune"), root).collect()} == texts
    assert spied == [] and sorted(glob.glob(f"{root}/*/*.parquet")) == files
    proof = stages.read_stage(spark, root, "provenance", transcribe.SCHEMAS["provenance"]).where("audio_id = 'song'").first()["value"]
    assert proof["version"] == "0.3" and proof["engines"]["alignment"] == "mock" and proof["engines"]["syllabification"] == "spelled"
    words = next(c for c in proof["confidence"] if c["stage"] == "transcription")
    assert (words["n"], round(words["mean"], 6), words["median"], words["p10"]) == (3, 0.8, 0.8, 0.7)
    # Corrupt chords and document of one track: these are computed again, with a new track, and all else is left alone.
    bad = spark.createDataFrame([("song", 1, "{not json")], "audio_id string, version long, value string")
    for stage in ("document", "chords"):
        rows = spark.read.parquet(f"{root}/{stage}").where("audio_id <> 'song'").unionByName(bad).collect()
        spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{root}/{stage}")
    got = {r["audio_id"]: r["value"]["text"] for r in transcribe.transcribe(spark, audio(spark, "song", "tune", "hymn"), root, transcribe.Options(language="en")).collect()}
    assert got == texts | {"hymn": EXPECTED.replace("song", "hymn")}
    rows = {s: sorted(r["audio_id"] for r in spark.read.parquet(f"{root}/{s}").select("audio_id").collect()) for s in stages.STAGES}
    again = ["hymn", "song", "song", "tune"]
    assert rows == {s: again if s in ("document", "chords", "provenance") else ["hymn", "song", "tune"] for s in stages.STAGES}


def test_syllables_by_language(spark):
    words = "array(named_struct('idx', 0L, 'text', 'bem-vindo', 't0', 0L, 't1', 800L, 'confidence', 0.5D))"
    row = spark.range(1).selectExpr(f"{words} AS w")
    cut = lambda language: [tuple(s) for s in row.select(transcribe.syllables_of(row["w"], transcribe.F.lit(language)).alias("s")).first()["s"]]
    assert cut("pt-BR") == [(0, "bem", 0, 300, 0.5, 0, 0, False), (1, "vin", 300, 550, 0.5, 0, 4, True), (2, "do", 550, 800, 0.5, 0, 7, False)]
    assert [s[7] for s in cut("en")] == [True, False, False]
    assert cut("xx") == [(0, "bem-vindo", 0, 800, 0.5, 0, 0, True)]  # the mock: a syllable a word


def test_tracks_with_phonemes_need_no_alignment(spark, tmp_path, spied):
    root, schema = str(tmp_path), f"audio_id string, value {transcribe.SCHEMAS['transcription']}"
    heard = spark.createDataFrame([("song", ("en", [(0, "hi", 0, 500_000, 0.9)], [("HH", 0, 1)])), ("hush", ("en", [], []))], schema)
    stages.write_stage(heard, root, "transcription")
    got = {r["audio_id"]: r["value"]["text"] for r in transcribe.transcribe(spark, audio(spark, "song", "hush"), root, transcribe.Options(profile="chordpro_ref")).collect()}
    assert "[C]hi" in got["song"] and "{start_of_grid: Instrumental}\n| C . . . | G . . . | Am . . . | F . . . |\n{end_of_grid}" in got["hush"]
    assert "alignment" not in spied and not (tmp_path / "alignment").exists()
    assert [tuple(r) for r in transcribe.silent(spark, root).collect()] == [("hush", 8_000_000)]
