"""Fixtures with hand-computed results, ties and boundaries; differential tests against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import symbols, text
from chronoloom.operators import blocks, cascade, intervals, nearest, render, sequences, sessions, stats, validate

MS = 1000
S = 1_000_000
KEY = ["track_id"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, "track_id string, " + schema)


def beats(spark, *times, track="t"):
    return frame(spark, [(track, int(t * S), i) for i, t in enumerate(times)], "t bigint, idx bigint")


@pytest.mark.parametrize("at, level, snapped", [(1.04, "beat", 1.0), (1.41, "unsnapped", 1.41), (1.28, "8th", 1.25), (1.05, "beat", 1.0), (1.07, "beat", 1.0), (0.25, "unsnapped", 0.25)])
def test_snap_ladder(spark, at, level, snapped):
    grid = beats(spark, 0.5, 1, 1.5, 2)
    row = nearest.snap(beats(spark, at), grid, KEY, "t").first()
    assert (row["level"], row["snapped"]) == (level, int(snapped * S))


def test_snap_without_beats(spark):
    assert nearest.snap(beats(spark, 1.0), beats(spark).limit(0), KEY, "t").first()["level"] == "unsnapped"
    assert nearest.snap(beats(spark, 1.0), beats(spark, 0.5), KEY, "t").first()["level"] == "unsnapped"


def slow_nearest(t, grid):
    return min(grid, key=lambda g: (abs(g[0] - t), g[0], g[1]), default=None)


@pytest.mark.parametrize("width", [3, 17, 10_000, None])
def test_nearest_equals_brute_force_at_any_block_width(spark, width):
    rng = random.Random(width or 0)
    left = [(k, rng.randint(0, 60), i) for k in "abc" for i in range(30)]
    right = [(k, rng.randint(0, 60), i) for k in "ab" for i in range(12)]
    found = nearest.nearest(frame(spark, left, "t bigint, idx bigint"), {"r": frame(spark, right, "t bigint, idx bigint")}, KEY, "t", width).collect()
    assert len(found) == len(left)
    for r in found:
        want = slow_nearest(r["t"], [(t, i) for k, t, i in right if k == r["track_id"]])
        assert (tuple(r["r"]) if r["r"] else None) == want


def test_nearest_within_is_strict_and_prefers_the_first(spark):
    right = beats(spark, 0.0, 0.2, 0.4)
    got = lambda at, tol, strict=True: [tuple(r["nearest"])[:2] for r in nearest.nearest_within(beats(spark, at).withColumnRenamed("idx", "id"), right, KEY, ["id"], tol, strict).collect()]
    assert got(0.25, 150 * MS) == [(50 * MS, 1)]
    assert got(0.3, 150 * MS) == [(100 * MS, 1)]
    assert got(0.6, 200 * MS) == []
    assert got(0.6, 200 * MS, False) == [(200 * MS, 2)]


def test_nearest_interval_distance_inside_is_zero(spark):
    spans = frame(spark, [("t", 0, 10, 0), ("t", 20, 30, 1), ("t", 28, 40, 2)], "t0 bigint, t1 bigint, idx bigint")
    points = frame(spark, [("t", t, i) for i, t in enumerate((5, 14, 15, 29, 45, 46))], "t bigint, p bigint")
    got = {r["p"]: (r["nearest"]["idx"], r["nearest"]["distance"]) for r in nearest.nearest_interval(points, spans, KEY, ["p"], F.lit(5)).collect()}
    assert got == {0: (0, 0), 1: (0, 4), 2: (0, 5), 3: (1, 0), 4: (2, 5)}


def test_blocks_equal_plain_windows(spark):
    rng = random.Random(0)
    rows = [("ab"[rng.randrange(2)], rng.randint(0, 40), i, rng.randint(-3, 3)) for i in range(120)]
    df = frame(spark, rows, "t bigint, idx bigint, v bigint")
    for width in (1, 5, 1000, None):
        b = blocks.with_block(df, "t", width)
        lag = {(r["idx"]): r["p"] for r in blocks.lagged(b, KEY, ["t", "idx"], {"p": "v"}).collect()}
        lead = {(r["idx"]): r["n"] for r in blocks.led(b, KEY, ["t", "idx"], {"n": "v"}).collect()}
        total = {(r["idx"]): r["s"] for r in blocks.running_sum(b, KEY, ["t", "idx"], F.col("v"), "s").collect()}
        for k in "ab":
            ordered = sorted((t, i, v) for kk, t, i, v in rows if kk == k)
            upto = 0
            for at, (_, i, v) in enumerate(ordered):
                upto += v
                assert lag[i] == (ordered[at - 1][2] if at else None)
                assert lead[i] == (ordered[at + 1][2] if at + 1 < len(ordered) else None)
                assert total[i] == upto


def test_onset_intervals_end_at_boundaries_before_these_are_dropped(spark):
    onsets = frame(spark, [("t", 0, 0, "C"), ("t", 1 * S, 1, "N"), ("t", 2 * S, 2, "G")], "t bigint, idx bigint, label string")
    got = sorted(tuple(r) for r in intervals.onset_intervals(onsets, KEY, "label").select("label", "t0", "t1").collect())
    assert got == [("C", 0, S), ("G", 2 * S, 3 * S)]
    assert intervals.onset_intervals(onsets.withColumn("label", F.lit("N")), KEY, "label").count() == 0


def test_overlaps_are_strict_and_counted_once(spark):
    rng = random.Random(4)
    make = lambda n: [(k, a, a + rng.randint(0, 25), i) for k in "ab" for i in range(n) for a in [rng.randint(0, 80)]]
    left, right = make(15), make(15)
    got = intervals.overlaps(frame(spark, left, "t0 bigint, t1 bigint, a bigint"), frame(spark, right, "u0 bigint, u1 bigint, b bigint"), KEY)
    want = sorted((k, i, j) for k, s, e, i in left for kk, u, v, j in right if k == kk and s < v and e > u)
    assert sorted((r["track_id"], r["a"], r["b"]) for r in got.collect()) == want


def test_points_in_closed_intervals(spark):
    spans = frame(spark, [("t", S, 2 * S, 0), ("t", S, 3 * S, 1)], "t0 bigint, t1 bigint, idx bigint")
    points = beats(spark, 0.9, 1.0, 2.0, 3.0, 3.1).withColumnRenamed("idx", "p")
    assert {r["p"]: r["idx"] for r in intervals.first_interval_at(points, spans, KEY, ["p"]).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r["idx"]: r["n"] for r in intervals.points_per_interval(spans, points, KEY, ["idx"]).collect()} == {0: 2, 1: 3}


def words(spark, *spans):
    return frame(spark, [("t", int(a * S), int(b * S), i) for i, (a, b) in enumerate(spans)], "t0 bigint, t1 bigint, idx bigint")


RULES = {"instrumental": (8.0, 4 * S), "line": (2.5, S)}


def test_gap_thresholds(spark):
    one = sessions.gap_thresholds(words(spark, (0, 1), (1.1, 2), (2.1, 3)), KEY, RULES, block=S).first()
    assert (one["instrumental"], one["line"]) == (4.0 * S, 1.0 * S)
    wide = sessions.gap_thresholds(words(spark, (0, 1), (2, 3), (5, 6)), KEY, RULES, block=S).first()
    assert wide["instrumental"] == 8.0 * 1.5 * S
    alone = sessions.gap_thresholds(words(spark, (0, 1)), KEY, RULES, F.lit(6.0 * S), S).first()
    assert (alone["instrumental"], alone["line"]) == (6.0 * S, 6.0 * S)


def test_gap_sessions_break_strictly_beyond_the_threshold(spark):
    found = sessions.gap_sessions(words(spark, (0, 1), (2, 3), (4.000001, 5)), KEY, F.lit(S), block=2 * S)
    assert [r["block"] for r in found.orderBy("idx").collect()] == [0, 0, 1]


def sectioned(spark, spans, duration, threshold=4.0):
    marked = sessions.gap_sessions(words(spark, *spans), KEY, F.lit(threshold * S), block=S)
    tracks = frame(spark, [("t", int(duration * S))], "duration bigint")
    found = sessions.sections(sessions.summarised(marked, KEY, ["block"], F.lit(threshold * S).alias("threshold")), tracks, KEY)
    return [(r["label"], r["t0"] / S, r["t1"] / S) for r in found.orderBy("seq").collect()]


def test_sections(spark):
    assert sectioned(spark, [], 10) == [("Instrumental", 0, 10)]
    assert sectioned(spark, [(5, 5.4), (5.5, 6)], 12) == [("Intro", 0, 5), ("Verse 1", 5, 6), ("Outro", 6, 12)]
    assert sectioned(spark, [(0, 1), (11, 12), (22, 23), (33, 34)], 34) == [
        ("Verse 1", 0, 1), ("Instrumental", 1, 11), ("Chorus", 11, 12), ("Instrumental 2", 12, 22), ("Verse 2", 22, 23), ("Instrumental 3", 23, 33), ("Chorus 2", 33, 34),
    ]
    assert sectioned(spark, [], 0) == []


def cascaded(spark, chord, syllables, spans, grid=()):
    syl = frame(spark, [("t", int(a * S), int(b * S), i, s) for i, (a, b, s) in enumerate(syllables)], "t0 bigint, t1 bigint, idx bigint, stressed boolean")
    row = cascade.place(beats(spark, chord), beats(spark, *grid), syl, words(spark, *spans), KEY, block=S).first()
    return row["strategy"], row["target"]


def test_cascade(spark):
    amigo = [(0.0, 0.2, False), (0.2, 0.4, True), (0.4, 0.5, False)]
    assert cascaded(spark, 0.2, amigo, [(0, 0.5)]) == ("stressed_syllable", 1)
    assert cascaded(spark, 0.5, [(0.4, 1.4, True)], [(0.4, 1.4)]) == ("melisma_start", 0)
    assert cascaded(spark, 0.1, [(0, 0.1, False)], [(0, 0.5)]) == ("any_syllable", 0)
    assert cascaded(spark, 0.55, [(1.0, 1.1, False)], [(1.0, 1.5)]) == ("before_word", 0)
    assert cascaded(spark, 5.0, [(1.0, 1.1, False)], [(1.0, 1.5)]) == ("orphan", None)
    assert cascaded(spark, 0.15, [(0.0, 0.1, True)], [(3, 4)]) == ("any_syllable", 0)  # 150 ms is not within 150 ms
    assert cascaded(spark, 0.3, [(0.0, 0.6, True)], [(3, 4)]) == ("orphan", None)  # 600 ms is not long, 300 ms is not within 300 ms


def test_order_statistics_equal_sorted_lists(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.random(), 0.5, 7.25])) for k in "aab" for _ in range(200)] + [("c", 1.0)]
    found = stats.order_statistics(frame(spark, rows, "v double"), KEY, "v", {"upper": F.floor(F.col("n") / 2), "p10": F.floor(F.col("n") / 10), "last": F.col("n") - 1})
    for r in found.collect():
        values = sorted(v for k, v in rows if k == r["track_id"])
        n = len(values)
        assert (r["n"], r["upper"], r["p10"], r["last"]) == (n, values[n // 2], values[n // 10], values[-1])
    even = stats.medians(frame(spark, [("x", 1), ("x", 2), ("x", 3), ("x", 4)], "v bigint"), KEY, "v").first()
    assert even["median"] == 2.5


def test_tempo(spark):
    r = stats.tempo(beats(spark, 0, 1, 2, 4), KEY, S).first()
    assert (r["period"], r["bpm"], round(r["mean_gap"])) == (S, 60.0, 1333333)
    assert stats.tempo(beats(spark, 3), KEY, S, 120).first()["period"] == S // 2


def test_agreement_of_identical_and_disjoint_labels(spark):
    rows = [("t", 0, 4, "C"), ("t", 4, 8, "G"), ("t", 8, 12, "A")]
    df = frame(spark, rows, "t0 bigint, t1 bigint, label string")
    score = lambda other: stats.weighted_agreement(intervals.refinement(df, other, KEY, 5), KEY, F.col("left_label") == F.col("right_label"), F.lit(True)).first()["score"]
    assert score(df) == 1.0
    assert score(df.withColumn("label", F.lit("X"))) == 0.0
    assert score(frame(spark, [("t", 0, 6, "C"), ("t", 6, 12, "A")], "t0 bigint, t1 bigint, label string")) == pytest.approx(8 / 12)


def test_beat_agreement(spark):
    r = validate.beat_agreement(beats(spark, 1, 2, 3, 4), beats(spark, 1.05, 2.08, 3.07, 3.075), KEY).first()
    assert (r["hits"], r["n_ref"], r["n_est"]) == (2, 4, 4)
    assert r["f_measure"] == 0.5


def test_runs_and_spans(spark):
    tokens = ["a"] * 3 + ["-"] * 2 + ["a", "b", "b"]
    df = frame(spark, [("t", i, x) for i, x in enumerate(tokens)], "frame bigint, token string")
    for width in (1, 2, 100, None):
        got = sorted((r["first"], r["last"], r["token"]) for r in sequences.runs(df, KEY, "frame", "token", F.col("token") == "-", width).collect())
        assert got == [(0, 2, "a"), (5, 5, "a"), (6, 7, "b")]
    spans = frame(spark, [("t", 0, 9, 0), ("t", 10, 19, 0), ("t", 20, 29, 0)], "first bigint, last bigint, word bigint")
    assert tuple(sequences.spans_to_words(spans, KEY, "word").first())[2:] == (0, 600_000)


def test_measures_and_order(spark):
    grid = frame(spark, [("t", i, i, i in (1, 4)) for i in range(6)], "t bigint, idx bigint, downbeat boolean")
    assert [r["position"] for r in sequences.measure_positions(grid, KEY, F.col("downbeat"), 2).orderBy("idx").collect()] == [1, 1, 2, 3, 1, 2]
    bad = frame(spark, [("t", t, i) for i, t in enumerate((1, 2, 2, 5, 4))], "t bigint, idx bigint")
    assert [r["idx"] for r in sequences.not_increasing(bad, KEY, 2).orderBy("idx").collect()] == [2, 4]


def test_windows_with_context(spark):
    got = sequences.context_windows(frame(spark, [("t", 70 * S)], "duration bigint"), "duration", 30 * S, 2 * S).orderBy("window").collect()
    assert [(r["t0"] // S, r["t1"] // S, r["c0"] // S, r["c1"] // S) for r in got] == [(0, 30, 0, 32), (30, 60, 28, 62), (60, 70, 58, 70)]
    frames = spark.createDataFrame([(28 * S, 30 * S, 60 * S, i) for i in (0, 99, 100, 1599, 1600)], "c0 bigint, t0 bigint, t1 bigint, frame bigint")
    assert [r["frame"] for r in sequences.cropped(frames, 20_000).collect()] == [100, 1599]


def test_order_statistics_both_ways(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(m)])) for k, m, n in (("a", 3, 200), ("b", 500, 300), ("c", 1, 5)) for _ in range(n)] + [("none", None)] * 2
    df = spark.createDataFrame(rows, "k string, v long")
    n = F.col("n")
    ranks = {"low": F.floor((n - 1) / 2), "p10": F.floor(n / 10), "top": n - 1}
    more = {"all": (F.count("*"), F.sum), "sum": (F.sum("v"), F.sum)}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(v for i, v in rows if i == k and v is not None)
        want[k] = (len(v), *((v[(len(v) - 1) // 2], v[len(v) // 10], v[-1]) if v else (None,) * 3), sum(i == k for i, _ in rows), sum(v) if v else None)
    for spread in (False, True):
        found = stats.order_statistics(df, ["k"], "v", ranks, spread, more).select("k", "n", *ranks, *more)
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == want
        plain = stats.order_statistics(df, ["k"], "v", ranks, spread).select("k", "n", *ranks)
        assert {r[0]: tuple(r[1:]) for r in plain.collect()} == {k: x[:4] for k, x in want.items() if k != "none"}


def test_thresholds_by_windows_or_join(spark):
    rng = random.Random(3)
    spans = [(rng.randint(0, 500), rng.randint(1, 9)) for _ in range(80)]
    w = words(spark, *[(a, a + b) for a, b in spans])
    got = [sorted(map(tuple, sessions.thresholded(w, KEY, RULES, block).select("idx", *RULES).collect())) for block in (None, 20 * S)]
    assert got[0] == got[1] and len(got[0]) == 80


def test_long_intervals_make_few_rows(spark):
    """One interval as long as the track stands in two cells like any other; points ask a cell for each level in use."""
    rng = random.Random(5)
    day = 86_400 * S
    spans = [("t", 0, 400 * day, 0), *[("t", a := rng.randint(0, 400 * day), a + rng.choice([0, 1, S, 3000 * S, 5 * day]), i) for i in range(1, 300)], ("t", 9, 3, 300), ("u", -5 * S, 7 * S, 301)]
    points = [("t", rng.choice([rng.randint(0, 400 * day), rng.choice(spans)[1], rng.choice(spans)[2]]), i) for i in range(200)] + [("u", -S, 200), ("v", 0, 201)]
    intervals_ = spark.createDataFrame(spans, "track_id string, t0 bigint, t1 bigint, i bigint")
    index = nearest.indexed(intervals_, F.col("t0"), F.col("t1"))
    assert index.groupBy("i").count().agg({"count": "max"}).first()[0] <= 2
    asked = nearest.asking(spark.createDataFrame(points, "track_id string, t bigint, p bigint"), F.col("t"), KEY, index)
    assert asked.groupBy("p").count().agg({"count": "max"}).first()[0] <= 5 and len(nearest.LEVELS) == 11
    got = intervals.points_in(spark.createDataFrame(points, "track_id string, t bigint, p bigint"), intervals_, KEY).select("p", "i").collect()
    assert sorted(map(tuple, got)) == sorted((p, i) for k, t, p in points for m, a, b, i in spans if k == m and a <= t <= b)
    others = [("t", a := rng.randint(0, 400 * day), a + rng.choice([0, S, 40 * day]), i) for i in range(150)]
    right = spark.createDataFrame(others, "track_id string, u0 bigint, u1 bigint, j bigint")
    pairs = intervals.overlaps(intervals_, right, KEY).select("i", "j").collect()
    assert sorted(map(tuple, pairs)) == sorted((i, j) for k, a, b, i in spans for m, c, d, j in others if k == m and a <= b and a < d and b > c)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, parts, stressed", [("amigo", "a-mi-go", 1), ("música", "mú-si-ca", 0), ("hello", "hel-lo", 0), ("beautiful", "beau-ti-ful", 2), ("vindo", "vin-do", 0), ("bem-vindo", "bem-vin-do", 1), ("open", "o-pen", 0), ("xyz", "xyz", 0), ("", "", None), ("amor", "a-mor", 1), ("papel", "pa-pel", 1), ("casa", "ca-sa", 0), ("café", "ca-fé", 1), ("pão", "pão", 0), ("ruim", "ruim", 0), ("self-aware", "self-a-wa-re", 2), ("-a-", "a", 0)])
def test_syllables_and_stress(spark, word, parts, stressed):
    found = text.syllables(F.lit(word))
    assert "-".join(value(spark, found)) == parts
    if stressed is not None:
        assert value(spark, text.stress(F.lit(word), found)) == stressed


def test_syllable_spans(spark):
    """Parts of a word share its time by length, syllables a part's time in equal steps; hyphens alone are one syllable."""
    spans = lambda word, t1: [tuple(x) for x in value(spark, text.syllable_spans(F.lit(word), F.lit(0), F.lit(t1)))]
    assert spans("bem-vindo", 800) == [("bem", 0, 300), ("vin", 300, 550), ("do", 550, 800)]
    assert spans("amigo", 900) == [("a", 0, 300), ("mi", 300, 600), ("go", 600, 900)]
    assert spans("--", 500) == [("--", 0, 500)] and spans("", 500) == [] and spans("-x", 7) == [("x", 0, 7)]
    assert value(spark, text.syllables(F.lit("--"))) == ["--"] and value(spark, text.syllables(F.lit("-"))) == ["-"]


def test_text_functions(spark):
    assert [value(spark, text.sanitised(F.lit(w))) for w in ("Coração", "a'b", "123 abc", "   ")] == ["coracao", "ab", "abc", ""]
    la = F.array(F.lit("la"), F.lit("la"))
    assert value(spark, text.word_offsets(la)) == [0, 3]
    assert value(spark, text.found_offsets(F.lit("LA  la"), la)) == [0, 4]
    assert value(spark, text.found_offsets(F.lit("x la"), F.array(F.lit("no"), F.lit("la")))) == [0, 2]
    assert value(spark, text.syllable_offset(F.lit(0), F.lit(1), F.lit(5), F.lit(3))) == 1
    assert value(spark, text.bracketed(F.lit("{t: Title}\n{key: C}\n[C]Hello [ G ]world"))) == ["C", "G"]
    links = ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=10s", "https://www.youtube.com/embed/abcdefghijk", "https://vimeo.com/12345678901", ""]
    assert [value(spark, text.link_id(F.lit(x))) for x in links] == ["abcdefghijk"] * 3 + [None] * 2
    assert value(spark, text.loose_link_id(F.lit("https://x.y/abcdefghijk?z=1"))) == "abcdefghijk"
    assert [value(spark, text.slug(F.lit(x))) for x in ("A b! c", "--", "a_b")] == ["A-b-c", "untitled", "a_b"]
    assert [value(spark, text.base_language(F.lit(x))) for x in ("pt-BR", "en_US", "FR")] == ["pt", "en", "fr"]
    assert [value(spark, text.proportional_offset(F.lit(f), F.lit(5))) for f in (0.5, 0.3, 1.5, -1.0)] == [2, 2, 5, 0]
    flags = F.array(*[F.lit(x) for x in (False, True, False, True, False)])
    assert value(spark, text.phoneme_groups(flags)) == [0, 0, 1, 1, 1]
    phones = F.array(*[F.lit(x) for x in ("HH", "AH0", "L", "OW1")])
    assert value(spark, text.lexicon_stress(phones)) == 1
    assert [value(spark, text.stress_level(F.lit(x))) for x in ("AH1", "AH0", "ˈa", "ˌe", "T", "a")] == [1, 0, 1, 2, -1, 0]


@pytest.mark.parametrize("symbol, want", [("Cm7", "C:min7"), ("F7M/A", "F:maj7/A"), ("Esus/B", "E:maj/B"), ("D9", "D:maj"), ("C+", "C:aug"), ("Bm7b5", "B:min"), ("C13", "C:maj"), ("N", "N"), ("C7/E", "C:maj"), ("Cdim7", "C:maj"), ("C7", "C:7"), ("hello", "hello"), ("F#m/C#", "F#:min/C#")])
def test_labels(spark, symbol, want):
    assert value(spark, symbols.label(F.lit(symbol))) == want


def test_symbols(spark):
    assert [value(spark, symbols.from_engine(F.lit(x))) for x in ("C:maj", "G:min7", "N")] == ["C", "Gm7", None]
    assert [value(spark, symbols.root(F.lit(x))) for x in ("Bbm", "C#7", "x")] == ["A#", "C#", None]
    assert value(spark, symbols.bracket(F.lit("C/E"), F.lit("E"))) == "[C/E]"
    assert value(spark, symbols.bracket(F.lit("C"), F.lit("E"))) == "[C/E]"
    assert value(spark, symbols.emits_bass(F.lit("C"), F.lit("C"))) is False
    assert value(spark, symbols.bass(F.lit("C/E"), F.lit(None).cast("string"))) == "E"
    assert value(spark, symbols.same_triad(F.lit("Db:min7"), F.lit("C#:min"))) is True


def test_rendering(spark):
    lines = frame(spark, [("t", "Em tua presença quero estar")], "text string")
    marks = frame(spark, [("t", 24, 1, "[A/E]"), ("t", 3, 0, "[E]")], "pos int, idx int, chord string")
    assert render.lyric_lines(lines, marks, KEY).first()["line"] == "Em [E]tua presença quero es[A/E]tar"
    cells = lambda *names: frame(spark, [("t", i, n) for i, n in enumerate(names)], "idx bigint, symbol string")
    assert render.inline_bars(cells("C", "A", "D"), KEY, "full").first()["line"] == "[C]x///   [A]x///   [D]x///"
    assert render.inline_bars(cells("E", "D", "A"), KEY, "half").first()["line"] == "[E]x/[D]/   [A]x/[A]/"
    assert render.grid_bars(cells("E", "D", "A"), KEY, "full").first()["line"] == "| E . . . | D . . . | A . . . |"
    assert render.grid_bars(cells("E", "D", "A", "E"), KEY, "half").first()["line"] == "| E . D . | A . E . |"
    ext = F.create_map(F.lit("sbp_section"), F.lit("Sun"), F.lit("sbp_difficulty"), F.lit("easy"), F.lit("x"), F.lit("y"))
    assert value(spark, render.tags(ext)) == "{x_sbp_tags: section=Sun difficulty=easy}"  # the extensions' own order
    head = render.header(F.lit("T"), F.lit("A"), F.lit("C"), F.lit(90), F.lit("4/4"), F.lit(2), F.array(F.lit("version 1")))
    assert value(spark, head).split("\n") == ["{title: T}", "{artist: A}", "{key: C}", "{tempo: 90}", "{time: 4/4}", "{capo: 2}", "{meta: version 1}", ""]
    with pytest.raises(ValueError):
        render.profile("none")
    words_ = frame(spark, [("t", 0, "hello")], "idx bigint, text string")
    spots = frame(spark, [("t", 0, "before", 1, 4, 0.0), ("t", 0, "inside", 2, 1, 0.5)], "idx bigint, slot string, t bigint, position int, fraction double")
    assert render.beat_markers(spots, words_, KEY).first()["text"] == "|4 he|1llo"


def test_severity_and_ranking(spark):
    grades = [value(spark, cascade.severity(F.lit(x))) for x in (0.49, 0.50, 0.69, 0.70, 0.84, 0.85, 0.94, 0.95)]
    assert grades == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "NEGLIGIBLE"]
    rows = spark.createDataFrame([("A", 0.92, 0), ("B", 0.40, 1), ("C", 0.65, 2), ("D", 0.30, 3)], "name string, score double, seq int")
    assert [r["name"] for r in cascade.worst(rows, "score", "seq").collect()] == ["D", "B", "C", "A"]


def test_rules(spark):
    df = frame(spark, [("t", 0, 1, 0.5), ("t", 2, 1, 0.5), ("t", -1, 1, 2.0), ("t", None, 1, 0.5)], "t0 bigint, t1 bigint, c double")
    checks = validate.rules("t0", "t1", "c")
    assert validate.violations(df, ["t0"], checks).count() == 1 + 2 + 2
    assert validate.strict(df.where("t0 = 0"), checks).count() == 1
    with pytest.raises(Exception, match="breaks a rule"):
        validate.strict(df, checks).collect()


def test_bass_note(spark):
    flat, peak = [0.1] * 12, [0.1] * 9 + [1.0, 0.1, 0.1]
    df = spark.createDataFrame([(0, flat), (1, peak), (2, [0.0] * 12), (3, [-1.0] * 12)], "id int, v array<float>")
    assert {r["id"]: r["pitch_class"] for r in stats.bass_note(df, "id", "v").collect()} == {0: None, 1: 9, 2: None, 3: None}
