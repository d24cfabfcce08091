"""Chord symbols as column expressions: labels, roots, bass notes, brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "[A-G][#b]?"
#: Suffix patterns in order of priority, the label quality, and whether the slash stays (fixed values).
RULES = (
    ("m7/([A-G][#b]?)", "min7", True),
    ("maj7/([A-G][#b]?)", "maj7", True),
    ("7M/([A-G][#b]?)", "maj7", True),
    ("m/([A-G][#b]?)", "min", True),
    ("/([A-G][#b]?)", "maj", True),
    ("m7", "min7", False),
    ("maj7", "maj7", False),
    ("7M", "maj7", False),
    ("sus[24]?/([A-G][#b]?)", "maj", True),
    ("sus[24]?", "maj", False),
    ("dim|°", "dim", False),
    (r"aug|\+", "aug", False),
    ("m9|m6|m", "min", False),
    ("7", "7", False),
    ("9|6", "maj", False),
    ("", "maj", False),
)
#: Pitch classes in order, and flats by their sharps (fixed values).
PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#", "Cb": "B", "Fb": "E"}


def label(symbol: Column) -> Column:
    """root:quality for evaluation; N stays, what has no root stays."""
    root = F.regexp_extract(symbol, f"^({ROOT})", 1)
    rest = F.substring(symbol, F.length(root) + 1, F.length(symbol))
    out = F.when(symbol == "N", symbol).when(root == "", symbol)
    for pattern, quality, slash in RULES:
        named = F.concat(root, F.lit(f":{quality}"))
        out = out.when(rest.rlike(f"^(?:{pattern})$"), F.concat(named, F.lit("/"), F.regexp_extract(rest, f"^{pattern}$", 1)) if slash else named)
    minor = rest.startswith("m") & ~rest.startswith("maj")
    return out.otherwise(F.concat(root, F.when(minor, F.lit(":min")).otherwise(F.lit(":maj"))))


def labelled(symbol: Column, note: Column) -> Column:
    """The label of a chord event: the symbol's, with the event's own bass note after it."""
    return F.concat(label(symbol), F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("/"), note)).otherwise(F.lit("")))


def without_bass(name: Column) -> Column:
    return F.regexp_replace(name, "/[A-G][#b]?$", "")


def with_bass(name: Column, bass: Column) -> Column:
    """Bass note appended, unless there is one already."""
    return F.when(bass.isNotNull() & ~name.contains("/"), F.concat(name, F.lit("/"), bass)).otherwise(name)


def from_engine(name: Column) -> Column:
    """C:maj -> C, G:min7 -> Gm7, N -> null."""
    return F.when(name == "N", None).otherwise(F.replace(F.regexp_replace(F.regexp_replace(name, ":maj$", ""), ":min", "m"), F.lit(":"), F.lit("")))


def root(symbol: Column) -> Column:
    """Root with flats as sharps; null without."""
    found = F.nullif(F.regexp_extract(symbol, f"^({ROOT})", 1), F.lit(""))
    flats = F.create_map(*[F.lit(x) for pair in sorted(FLATS.items()) for x in pair])
    return F.coalesce(F.try_element_at(flats, found), found)


def bass(symbol: Column, note: Column) -> Column:
    """Explicit note, else what follows the last slash."""
    return F.coalesce(note, F.when(symbol.contains("/"), F.trim(F.substring_index(symbol, "/", -1))))


def emits_bass(symbol: Column, letter: Column) -> Column:
    """Whether a found bass letter is worth writing: no slash yet, and not the root."""
    return letter.isNotNull() & ~symbol.contains("/") & ~F.coalesce(root(symbol) == letter, F.lit(False))


def pitch_letter(number: Column) -> Column:
    return F.when(number.isNotNull(), F.element_at(F.array(*[F.lit(p) for p in PITCHES]), number + 1))


def same_triad(reference: Column, estimate: Column) -> Column:
    """Whether two labels have the same root and are both major or both minor, or are both N; null where the reference is neither."""

    def kind(x: Column) -> Column:
        quality = F.regexp_extract(x, ":([^/]*)", 1)
        return F.when(x == "N", "N").when(quality.isin("maj", "maj7", "7"), "maj").when(quality.isin("min", "min7"), "min")

    ours, theirs = kind(reference), F.coalesce(kind(estimate), F.lit(""))
    return F.when(ours.isNotNull(), (ours == theirs) & ((ours == "N") | F.coalesce(root(reference) == root(estimate), F.lit(False))))


def slash_agrees(symbol: Column, note: Column) -> Column:
    """V3: what follows a symbol's last slash, without white space around, is its bass note, where both are given."""
    return ~symbol.contains("/") | note.isNull() | (F.regexp_replace(F.substring_index(symbol, "/", -1), r"^\s+|\s+$", "") == note)


def bracket(symbol: Column, note: Column) -> Column:
    """[symbol], with the bass note where the symbol has none."""
    return F.concat(F.lit("["), with_bass(symbol, note), F.lit("]"))
