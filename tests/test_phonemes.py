"""Syllables from phonemes by hand-made pronunciations; times in milliseconds."""

from pyspark.sql import functions as F

from chronoloom.functions import text
from chronoloom.operators import phonemes

#: Words with their span, and their phonemes with each one's end.
WORDS = {
    "hello": (0, 500, [("HH", 50), ("AH1", 200), ("L", 250), ("OW0", 500)]),
    "beautiful": (0, 900, [("B", 50), ("Y", 100), ("UW1", 300), ("T", 400), ("AH0", 550), ("F", 650), ("AH0", 800), ("L", 900)]),
    "ago": (0, 300, [("AH0", 100), ("G", 200), ("OW1", 300)]),
    "amigo": (0, 600, [("a", 100), ("m", 200), ("ˈi", 400), ("ɡ", 500), ("u", 600)]),
    "boy": (0, 300, [("b", 100), ("ɔɪ", 300)]),
    "hmm": (0, 300, [("h", 100), ("m", 250)]),
    "foo": (0, 300, []),
    "a": (0, 200, [("AH1", 200)]),
    "odd": (0, 400, [(None, 100), ("ˌe", 300), ("s", 400)]),
}


def made(spark):
    words = spark.createDataFrame([("t", i, w, v[0], v[1]) for i, (w, v) in enumerate(WORDS.items())], "k string, idx long, text string, t0 long, t1 long")
    rows = [("t", i, 10 * n, s, v[2][n - 1][1] if n else v[0], end) for i, v in enumerate(WORDS.values()) for n, (s, end) in enumerate(v[2])]
    sounds = spark.createDataFrame([*rows, ("t", 99, 0, "a", 0, 1)], "k string, word long, n long, symbol string, t0 long, t1 long")
    names = list(WORDS)
    found: dict = {}
    for r in phonemes.syllables(words, sounds.repartition(3), ["k"]).orderBy("word", "i").collect():
        found.setdefault(names[r["word"]], []).append((r["text"], r["t0"], r["t1"], r["stressed"], r["first"], r["last"]))
    return found


def test_pronunciations(spark):
    assert made(spark) == {
        "hello": [("HHAH1", 0, 200, True, 0, 1), ("LOW0", 200, 500, False, 2, 3)],
        "beautiful": [("BYUW1", 0, 300, True, 0, 2), ("TAH0", 300, 550, False, 3, 4), ("FAH0L", 550, 900, False, 5, 7)],
        "ago": [("AH0", 0, 100, False, 0, 0), ("GOW1", 100, 300, True, 1, 2)],
        "amigo": [("a", 0, 100, False, 0, 0), ("mˈi", 100, 400, True, 1, 2), ("ɡu", 400, 600, False, 3, 4)],
        "boy": [("bɔɪ", 0, 300, False, 0, 1)],
        "hmm": [("hmm", 0, 250, False, 0, 1)],
        "foo": [("foo", 0, 300, False, None, None)],
        "a": [("AH1", 0, 200, True, 0, 0)],
        "odd": [("ˌes", 0, 400, False, 0, 2)],
    }


def test_arrays(spark):
    told = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    of = lambda *s: F.array(*[F.lit(x) for x in s]).cast("array<string>")
    assert told(phonemes.groups(of("HH", "AH0", "L", "OW1"))) == [["HH", "AH0"], ["L", "OW1"]]
    assert told(phonemes.groups(of("S", "T"))) == [["S", "T"]] and told(phonemes.groups(of())) == []
    assert told(phonemes.groups(of("AE1", "N", "D", "Z"))) == [["AE1", "N", "D", "Z"]]
    assert [told(phonemes.spelled(F.lit(w))) for w in ("casa", "amor", "", "--")] == [["ca", "sa"], ["a", "mor"], [""], ["--"]]
    vowels = ("AH1", "Y", "y", "ˈɐ̃ʊ̃", "eɪ", "aː", "É", "HH", "ˌˈo", "j", "AH12")
    assert [told(text.is_vowel(F.lit(v))) for v in vowels] == [True, False, True, True, True, False, True, False, True, False, False]


def test_empty(spark):
    words = spark.createDataFrame([], "k string, idx long, text string, t0 long, t1 long")
    sounds = spark.createDataFrame([], "k string, word long, n long, symbol string, t0 long, t1 long")
    assert phonemes.syllables(words, sounds, ["k"]).count() == 0
