"""From audio files to documents, stage by stage, each track and stage computed once.

Every stage has a table of its own (``sources.stages``). A run takes the tracks whose document isn't there yet, and for each stage in
order only the tracks whose value is missing: engines are chosen, and their modules looked for, only where there is something to compute,
so a second run over the same tracks starts no engine. Engines are batch functions (``plugins``) from (audio_id, inputs) to (audio_id, value);
syllables, sections, placement and rendering are DataFrame operators over the stages' values as long tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import text
from ..operators import cascade, intervals, render, sessions
from ..sources import stages
from ..sources.stages import KEY
from . import plugins

VERSION = "0.3"
_SPAN = "idx: bigint, text: string, t0: bigint, t1: bigint, confidence: double"
_WORDS = f"array<struct<{_SPAN}>>"
_PHONEMES = "array<struct<symbol: string, t0: bigint, t1: bigint>>"
#: Type of every stage's value.
SCHEMAS = {
    "stems": "struct<vocals: string, drums: string, bass: string, other: string, duration: bigint>",
    "transcription": f"struct<language: string, words: {_WORDS}, phonemes: {_PHONEMES}>",
    "alignment": f"struct<words: {_WORDS}, phonemes: {_PHONEMES}>",
    "syllables": f"array<struct<{_SPAN}, word: bigint, offset: int, stressed: boolean>>",
    "chords": "array<struct<idx: bigint, symbol: string, t0: bigint, t1: bigint, confidence: double>>",
    "beats": "struct<bpm: double, beats: array<struct<idx: bigint, t: bigint, downbeat: boolean>>>",
    "document": "struct<title: string, profile: string, text: string>",
    "provenance": "struct<version: string, engines: map<string, string>, confidence: array<struct<stage: string, n: int, mean: double, median: double, p10: double>>>",
}
#: Engine kinds of the stages that engines compute.
ENGINES = {"stems": "separation", "transcription": "transcription", "alignment": "alignment", "chords": "chord_recognition", "beats": "beat_tracking"}
SPELLED = ("pt", "en")  # languages whose words are cut by spelling; others get the mock: a syllable a word
_S = 1_000_000
RULES = {"section_gap": (8.0, 4 * _S), "line_gap": (2.5, _S)}


@dataclass(frozen=True)
class Options:
    language: str | None = None
    profile: str = "inline_slash"
    engines: dict[str, str] = field(default_factory=dict)  # by kind; mock where none is named
    syllables: str = "spelled"
    overrides: dict = field(default_factory=dict)  # go to every engine
    progress: Callable[[str, str], None] | None = None


def _engine_value(rows: DataFrame, stage: str, options: Options) -> DataFrame:
    kind = ENGINES[stage]
    return plugins.apply(rows, kind, options.engines.get(kind, plugins.MOCK), options.progress, **options.overrides)


def _language(transcribed: Column, options: Options) -> Column:
    return F.coalesce(transcribed["language"], F.lit(options.language), F.lit("en"))


def syllables_of(words: Column, language: Column, by_spelling: bool = True) -> Column:
    """Timed syllables of a track's words, numbered over the track, with their word, offset in it and stress."""
    base = F.lower(F.substring_index(language, "-", 1))
    spelled = base.isin(*SPELLED) & F.lit(by_spelling)

    def one(w: Column) -> Column:
        whole = F.array(F.struct(w["text"].alias("syllable"), w["t0"].alias("t0"), w["t1"].alias("t1")))
        spans = F.when(spelled, text.syllable_spans(w["text"], w["t0"], w["t1"])).otherwise(whole)

        def timed(found: Column) -> Column:
            parts = F.transform(found, lambda s: s["syllable"])
            stressed, offsets = text.stress_by_language(base, w["text"], parts), text.found_offsets(w["text"], parts)
            return F.transform(found, lambda s, i: F.struct(s["syllable"].alias("text"), s["t0"].alias("t0"), s["t1"].alias("t1"), w["confidence"].alias("confidence"), w["idx"].alias("word"), F.get(offsets, i).cast("int").alias("offset"), (i == stressed).alias("stressed")))

        return text.let(spans, timed)

    flat = F.flatten(F.transform(F.filter(words, lambda w: w["text"] != ""), one))
    return F.transform(flat, lambda s, i: F.struct(i.cast("bigint").alias("idx"), s["text"].alias("text"), s["t0"].alias("t0"), s["t1"].alias("t1"), s["confidence"].alias("confidence"), s["word"].alias("word"), s["offset"].alias("offset"), s["stressed"].alias("stressed")))


def _rendered(tracks: DataFrame, options: Options) -> DataFrame:
    """audio_id, text of tracks with all stages: lines and sections by gaps, chords placed by the cascade, rendered by the profile."""
    key = [KEY]
    words = tracks.select(KEY, F.inline("words"))
    chords = tracks.select(KEY, F.inline("chords"))
    beats = tracks.select(KEY, F.inline("beats.beats"))
    syllables = tracks.select(KEY, F.inline("syllables"))
    blocks = sessions.gap_sessions(sessions.thresholded(words, key, RULES), key, F.col("section_gap"))
    lined = sessions.gap_sessions(blocks, [KEY, "block"], F.col("line_gap"), "line")
    lines = lined.groupBy(KEY, "block", "line").agg(F.array_sort(F.collect_list(F.struct("t0", "idx", "text", "t1"))).alias("w"))
    texts = F.transform("w", lambda x: x["text"])
    lines = lines.select(KEY, "block", "line", F.array_join(texts, " ").alias("text"), F.get("w", F.lit(0))["t0"].alias("l0"), F.element_at("w", -1)["t1"].alias("l1"), F.transform("w", lambda x: x["idx"]).alias("ids"), text.word_offsets(texts).alias("offsets"))
    at_words = lines.select(KEY, "block", "line", "l0", "l1", F.inline(F.arrays_zip(F.col("ids").alias("word"), F.col("offsets").alias("start"))))
    placed = cascade.place(chords.withColumn("t", F.col("t0")), beats, syllables, words, key)
    on_word = placed.where("strategy <> 'orphan'").join(syllables.select(KEY, F.col("idx").alias("target"), "word", "offset"), [KEY, "target"], "left")
    before = F.col("strategy") == "before_word"
    on_word = on_word.select(KEY, "idx", F.when(before, F.col("target")).otherwise(F.col("word")).alias("word"), F.when(before, 0).otherwise(F.col("offset")).alias("offset"))
    markers = on_word.join(chords.select(KEY, "idx", "symbol", "t0", "t1"), [KEY, "idx"]).join(at_words, [KEY, "word"]).where("t0 < l1 AND t1 > l0")
    markers = markers.select(KEY, "block", "line", (F.col("start") + F.col("offset")).alias("pos"), "idx", F.concat(F.lit("["), "symbol", F.lit("]")).alias("chord"))
    sung = render.lyric_lines(lines.select(KEY, "block", F.col("line").alias("nth"), "text"), markers.withColumnRenamed("line", "nth"), [KEY, "block", "nth"])
    lyrics = sung.groupBy(KEY, "block").agg(render.joined(F.collect_list(F.struct("nth", F.col("line").alias("piece"))), "\n").alias("lyrics"))
    found = sessions.summarised(blocks, key, ["block"], F.max("section_gap").alias("threshold"))
    sections = sessions.sections(found, tracks.select(KEY, F.col("stems.duration").alias("duration")), key)
    sung_at = found.select(KEY, "t0", "block").join(lyrics, [KEY, "block"]).select(KEY, "t0", "lyrics", F.lit(True).alias("is_sung"))
    sections = sections.withColumn("is_sung", F.col("kind").isin("verse", "chorus")).join(sung_at, [KEY, "t0", "is_sung"], "left")
    held = intervals.starts_in(chords.select(KEY, F.col("t0").alias("t"), "symbol", F.col("idx").alias("chord")), sections.where("NOT is_sung").select(KEY, "t0", "t1", "seq"), key)
    cells = held.withColumn("idx", F.row_number().over(Window.partitionBy(KEY, "seq").orderBy("t", "chord")) - 1)
    grids = render.profile(options.profile)["instrumental"](cells.select(KEY, "seq", "idx", "symbol"), [KEY, "seq"], "full").withColumnRenamed("line", "grid")
    bodies = sections.join(grids, [KEY, "seq"], "left").select(KEY, "seq", render.routed(options.profile, F.col("kind"), F.col("label"), F.col("lyrics"), F.col("grid")).alias("body"))
    nothing = F.lit(None).cast("string")
    extensions = F.create_map(F.lit("chronoloom_version"), F.lit(VERSION), F.lit("audio_id"), F.col(KEY))
    headers = tracks.select(KEY, render.profiled_header(options.profile, F.col("title"), nothing, nothing, F.round("beats.bpm").cast("int"), nothing, F.lit(0), extensions).alias("header"))
    return render.documents(headers, bodies, key).select(KEY, F.col("document").alias("text"))


def stage_confidence(stage: str, items: Column) -> Column:
    """Mean, upper median x[n div 2] and x[n div 10] of a stage's confidences; null without any."""
    values = F.array_sort(F.filter(F.transform(items, lambda x: x["confidence"]), lambda c: c.isNotNull()))

    def told(x: Column) -> Column:
        n = F.size(x)
        mean = F.when(n > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n)
        return F.struct(F.lit(stage).alias("stage"), n.alias("n"), mean.alias("mean"), F.get(x, F.floor(n / 2).cast("int")).alias("median"), F.get(x, F.floor(n / 10).cast("int")).alias("p10"))

    return text.let(values, told)


def _provenance(tracks: DataFrame, options: Options) -> DataFrame:
    names = {kind: options.engines.get(kind, plugins.MOCK) for kind in ENGINES.values()} | {"syllabification": options.syllables}
    engines = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.array(stage_confidence("transcription", F.col("transcription.words")), stage_confidence("alignment", F.col("words")), stage_confidence("chord_recognition", F.col("chords")), stage_confidence("syllabification", F.col("syllables")))
    return tracks.select(KEY, F.struct(F.lit(VERSION).alias("version"), engines.alias("engines"), parts.alias("confidence")).alias("value"))


def transcribe(spark: SparkSession, audio: DataFrame, root: str | None = None, options: Options = Options()) -> DataFrame:
    """audio_id, value (a document) of all tracks: audio has audio_id and path, and optionally title. root: the stages' folder, kept; without it a folder of this run."""
    register_mocks()
    root = root or f"{working_folder(spark)}/{uuid.uuid4().hex}"
    title = F.col("title") if "title" in audio.columns else F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    wanted = audio.select(KEY, "path", title.alias("title")).dropDuplicates([KEY])
    known = stages.read_stage(spark, root, "document", SCHEMAS["document"]).select(KEY)
    todo = wanted.join(known, KEY, "left_anti").withColumn("language", F.lit(options.language).cast("string"))
    if not todo.isEmpty():
        _computed(todo, root, options)
    return stages.read_stage(spark, root, "document", SCHEMAS["document"]).join(wanted.select(KEY), KEY, "left_semi")


def _computed(todo: DataFrame, root: str, options: Options) -> None:
    spark = todo.sparkSession

    def with_stage(tracks: DataFrame, stage: str, how: str = "inner") -> DataFrame:
        return tracks.join(stages.read_stage(spark, root, stage, SCHEMAS[stage]).withColumnRenamed("value", stage), KEY, how)

    def by_engine(rows: DataFrame, stage: str) -> None:
        stages.fill(rows, root, stage, SCHEMAS[stage], lambda missing: _engine_value(missing, stage, options))

    by_engine(todo.select(KEY, "path"), "stems")
    tracks = with_stage(todo, "stems")
    by_engine(tracks.select(KEY, "stems", "language"), "transcription")
    tracks = with_stage(tracks, "transcription")
    # Tracks that come with phonemes need no alignment.
    by_engine(tracks.where("transcription.phonemes IS NULL").select(KEY, "stems", F.col("transcription.words").alias("words"), F.coalesce("language", F.lit("pt")).alias("language")), "alignment")
    by_engine(tracks.select(KEY, "path", "stems"), "chords")
    by_engine(tracks.select(KEY, "path"), "beats")
    tracks = with_stage(with_stage(with_stage(tracks, "chords"), "beats"), "alignment", "left").withColumn("words", F.coalesce("alignment.words", "transcription.words"))
    cut = syllables_of(F.col("words"), _language(F.col("transcription"), options), options.syllables == "spelled")
    stages.fill(tracks, root, "syllables", SCHEMAS["syllables"], lambda missing: missing.select(KEY, cut.alias("value")))
    # The stages meet once; the operators below read them from one narrow table.
    folder = f"{working_folder(spark)}/tracks-{uuid.uuid4().hex}"
    with_stage(tracks, "syllables").write.parquet(folder)
    tracks = spark.read.parquet(folder)
    # The document is written last: a track with a document has all its stages.
    stages.write_stage(_provenance(tracks, options), root, "provenance")
    written = _rendered(tracks, options).join(tracks.select(KEY, "title"), KEY)
    stages.write_stage(written.select(KEY, F.struct("title", F.lit(options.profile).alias("profile"), "text").alias("value")), root, "document")
    stages.delete(spark, folder)


def working_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; in local mode without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir, or give the stages' folder")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def silent(spark: SparkSession, root: str) -> DataFrame:
    """Tracks that sound but have no words (audio_id, duration): an instrumental, or a transcription that failed."""
    stems = stages.read_stage(spark, root, "stems", SCHEMAS["stems"])
    heard = stages.read_stage(spark, root, "transcription", SCHEMAS["transcription"]).where(F.coalesce(F.size("value.words"), F.lit(0)) <= 0)
    return stems.join(heard.select(KEY), KEY).where("value.duration > 0").select(KEY, F.col("value.duration").alias("duration"))


def _mock(make: Callable[..., dict | list], *inputs: str) -> Callable[..., Iterator]:
    """A batch function that makes every row's value from its inputs."""

    def run(batches, kind=None, **_):
        for batch in batches:
            values = [make(*row) for row in zip(*(batch.column(c).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(values, kind)], [KEY, "value"])

    return run


def _moments(items, names) -> list[dict]:
    return [dict(zip(names, (i, *x))) for i, x in enumerate(items)]


def _mock_words() -> list[dict]:
    return _moments([("hello", 0, _S // 2, 0.9), ("world", 6 * _S // 10, _S, 0.8), ("test", 11 * _S // 10, 15 * _S // 10, 0.7)], ("idx", "text", "t0", "t1", "confidence"))


#: Mock engines: a track of 8 s with three words, four chords and eight beats.
MOCKS = {
    "separation": ("stems", _mock(lambda path: {n: f"{path}_({n.title()}).wav" for n in ("vocals", "drums", "bass", "other")} | {"duration": 8 * _S}, "path")),
    "transcription": ("transcription", _mock(lambda language: {"language": language, "words": _mock_words(), "phonemes": None}, "language")),
    "alignment": ("alignment", _mock(lambda words: {"words": words, "phonemes": []}, "words")),
    "chord_recognition": ("chords", _mock(lambda _: _moments([(c, 2 * i * _S, 2 * (i + 1) * _S, 0.5 + i / 10) for i, c in enumerate(("C", "G", "Am", "F"))], ("idx", "symbol", "t0", "t1", "confidence")), "path")),
    "beat_tracking": ("beats", _mock(lambda _: {"bpm": 60.0, "beats": _moments([(i * _S, i % 4 == 0) for i in range(8)], ("idx", "t", "downbeat"))}, "path")),
}


def register_mocks() -> None:
    """Mock engines for all kinds that have none (a session is needed to parse their types)."""
    for kind, (stage, run) in MOCKS.items():
        if not plugins.known(kind, plugins.MOCK):
            schema = f"{KEY} string, value {SCHEMAS[stage]}"
            plugins.register(kind, plugins.Engine(plugins.MOCK, schema, partial(run, kind=to_arrow_type(DataType.fromDDL(schema)["value"].dataType))))
