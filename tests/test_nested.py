"""Rules over nested documents by hand-made cases, and their counts while a table is written."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import symbols
from chronoloom.operators import nested

CHORD = "struct<symbol: string, bass_note: string, t0: double, t1: double, confidence: double>"
SCHEMA = f"""id int, metadata struct<title: string, tempo: int, capo: int>,
beat_grid struct<beats: array<double>, bpm: double, meter: struct<count: int, unit: int>, confidence: double>,
sections array<struct<kind: string, label: string, t0: double, t1: double, lines: array<struct<line_type: string, measures: int, pattern_hint: string, confidence: double,
  chords: array<{CHORD}>, markers: array<struct<char_position: int, placement: string, chord: {CHORD}>>>>>>"""
GOOD = ("Song", 120, 0), ([0.0, 0.5, 1.0], 120.0, (4, 4), 1.0)


def line(kind="lyric", measures=None, hint=None, confidence=1.0, chords=(), markers=()):
    return kind, measures, hint, confidence, list(chords), list(markers)


def section(*lines, kind="verse", label="Verse 1", t0=0.0, t1=1.0):
    return kind, label, t0, t1, list(lines)


def broken(spark, metadata=GOOD[0], grid=GOOD[1], sections=()):
    rows = spark.createDataFrame([(1, metadata, grid, list(sections))], SCHEMA)
    return {r["rule"]: r["n"] for r in nested.violations(rows, ["id"]).collect()}


def chord(symbol="C", note=None, t0=0.0, t1=1.0, confidence=1.0):
    return symbol, note, t0, t1, confidence


def test_good_documents_break_nothing(spark):
    full = section(line(chords=[chord("C/ E", "E")], markers=[(0, "orphan", chord())]), line("instrumental", 4, "beat"))
    assert broken(spark, sections=[full]) == {}
    assert broken(spark, ("", None, 12), None, []) == {}  # nothing stands in a grid that isn't there
    assert broken(spark, grid=([], 0.1, (1, 16), 0.0)) == {}


@pytest.mark.parametrize("metadata, rules", [(("x", 19, 0), ["tempo"]), (("x", 301, 13), ["capo", "tempo"]), ((None, 20, -1), ["capo", "title"]), (("x", 300, None), ["capo"])])
def test_metadata(spark, metadata, rules):
    assert sorted(broken(spark, metadata)) == rules


@pytest.mark.parametrize(
    "grid, rules",
    [
        (([0.0, 0.5, 0.5], 120.0, (4, 4), 1.0), ["beats_increasing"]),
        (([1.0, None, 2.0], 120.0, (4, 4), 1.0), ["beats_increasing"]),
        (([None], 0.0, (4, 4), 1.0), ["beats_increasing", "bpm"]),
        (([1.0], -1.0, (0, 4), 1.01), ["bpm", "grid_confidence", "meter"]),
        ((None, None, (3, 3), None), ["beats_increasing", "bpm", "grid_confidence", "meter"]),
    ],
)
def test_grid(spark, grid, rules):
    assert sorted(broken(spark, grid=grid)) == rules


def test_inside_sections(spark):
    bad = section(line("sung", confidence=float("nan"), chords=[chord("C/G", "E"), chord("C/", "E", 2.0), chord(confidence=-0.1)], markers=[(-1, "after", chord(None))]), kind="refrain", label=None, t0=-1.0)
    second = section(line("instrumental"), line("instrumental", 0, "bar"), line(measures=0))
    got = broken(spark, sections=[bad, second])
    base = "sections_lines_"
    assert got == {
        "section_kind": 1, "section_label": 1, "section_span": 1, "line_kind": 1, "line_confidence": 1, "line_measures": 2, "line_hint": 1, f"{base}chords_bass": 2, f"{base}chords_span": 1,
        f"{base}chords_confidence": 1, "marker_position": 1, "marker_placement": 1, f"{base}markers_chord_bass": 1,
    }


def test_rules_follow_the_schema(spark):
    part = spark.createDataFrame([(1, ("x",))], "id int, metadata struct<title: string>")
    assert list(nested.applicable(part.schema)) == ["title"]
    assert nested.violations(part.select("id"), ["id"]).count() == 0 and nested.valid(part).count() == 1
    odd = spark.createDataFrame([(1, [[1.0]])], "id int, sections array<array<double>>")
    assert nested.applicable(odd.schema) == {}


def test_counted_while_written(spark, tmp_path):
    rows = [(i, ("x", 10 * i, 0), GOOD[1], [section(line(confidence=float(i)))]) for i in range(1, 6)]
    documents = spark.createDataFrame(rows, SCHEMA).repartition(3)
    through, seen = nested.observed(documents, "rules")
    through.write.parquet(f"{tmp_path}/out")
    counts = seen.get
    assert (counts["documents"], counts["broken"], counts["tempo"], counts["line_confidence"], counts["capo"]) == (5, 5, 1, 4, 0)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5 and nested.valid(documents).count() == 0
    none, seen = nested.observed(documents.limit(0), "none")
    assert none.count() == 0 and (seen.get["documents"], seen.get["broken"]) == (0, 0)


@pytest.mark.parametrize("symbol, note, agrees", [("C/ E", "E", True), ("C/E\t", "E", True), ("C/E", "F", False), ("C", "E", True), ("C/E", None, True), ("C/G/E", "E", True)])
def test_bass_is_compared_without_white_space(spark, symbol, note, agrees):
    row = spark.range(1).select(symbols.slash_agrees(F.lit(symbol), F.lit(note)).alias("x")).first()
    assert row["x"] is agrees
