"""Rules over nested documents, compiled to one column a rule: how often a document breaks it.

A rule is a path and a condition on what stands there. Paths go through structs by name and into arrays by ``[]``
("sections[].lines[].measures"). Nothing stands inside a null struct or array, so rules below it don't apply; a null at the path's end breaks the rule unless
it is optional. Conditions on several fields take the struct that holds them. All rules of a document are counted in one pass over the rows, without
exploding them; ``observed`` counts over a whole table while it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import symbols


class Rule(NamedTuple):
    path: str
    holds: Callable[[Column], Column]
    optional: bool = False


#: Allowed values of documents (fixed values).
SECTION_KINDS = ("verse", "chorus", "bridge", "pre-chorus", "instrumental", "intro", "outro")
LINE_KINDS = ("lyric", "instrumental")
HINTS = ("full_measure", "half_measure", "beat")
PLACEMENTS = ("melisma_start", "stressed_syllable", "any_syllable", "before_word", "orphan")
DENOMINATORS = (2, 4, 8, 16)
STAGES = ("separation", "transcription", "alignment", "chord_recognition", "beat_tracking", "syllabification", "fusion")
BACKENDS = ("cuda", "mps", "mlx", "coreml", "metal", "cpu")


def one_of(values: tuple) -> Callable[[Column], Column]:
    return lambda x: x.isin(*values)


def between(low=None, high=None) -> Callable[[Column], Column]:
    """Within closed bounds, none where there is no bound; NaN is within none."""

    def holds(x: Column) -> Column:
        bounds = [x >= low] * (low is not None) + [x <= high] * (high is not None)
        return reduce(lambda a, b: a & b, bounds)

    return holds


def above(low) -> Callable[[Column], Column]:
    return lambda x: x > low


def span(x: Column) -> Column:
    """A struct's t0 and t1: not negative, in order."""
    return (x["t0"] >= 0) & (x["t1"] >= x["t0"])


def increasing(x: Column) -> Column:
    """Strictly, every element known; compared with the array shifted by one."""
    shifted = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    return F.forall(F.arrays_zip(F.slice(x, F.lit(1), F.size(shifted)).alias("a"), shifted.alias("b")), lambda p: F.coalesce(p["a"] < p["b"], F.lit(False))) & F.forall(x, lambda v: v.isNotNull())


def meter(x: Column) -> Column:
    """A struct's count and unit."""
    return (x["count"] > 0) & x["unit"].isin(*DENOMINATORS)


def bass_agrees(x: Column) -> Column:
    return x["symbol"].isNotNull() & symbols.slash_agrees(x["symbol"], x["bass_note"])


_UNIT = between(0, 1)


def _chord(path: str) -> dict[str, Rule]:
    name = path.replace("[]", "").replace(".", "_")
    return {f"{name}_span": Rule(path, span), f"{name}_confidence": Rule(f"{path}.confidence", _UNIT), f"{name}_bass": Rule(path, bass_agrees)}


#: The rules of a document: metadata, beat_grid, sections (of lines, of markers, words and syllables) and provenance; times are t0 and t1.
DOCUMENT: dict[str, Rule] = {
    "title": Rule("metadata.title", lambda x: x.isNotNull()),
    "tempo": Rule("metadata.tempo", between(20, 300), True),
    "capo": Rule("metadata.capo", between(0, 12)),
    "bpm": Rule("beat_grid.bpm", above(0)),
    "beats_increasing": Rule("beat_grid.beats", increasing),
    "meter": Rule("beat_grid.meter", meter),
    "grid_confidence": Rule("beat_grid.confidence", _UNIT),
    "section_kind": Rule("sections[].kind", one_of(SECTION_KINDS)),
    "section_label": Rule("sections[].label", lambda x: x.isNotNull()),
    "section_span": Rule("sections[]", span),
    "line_kind": Rule("sections[].lines[].line_type", one_of(LINE_KINDS)),
    "line_confidence": Rule("sections[].lines[].confidence", _UNIT, True),
    "line_measures": Rule("sections[].lines[]", lambda x: (x["line_type"] != "instrumental") | F.coalesce(x["measures"] > 0, F.lit(False))),
    "line_hint": Rule("sections[].lines[].pattern_hint", one_of(HINTS), True),
    **_chord("sections[].lines[].chords[]"),
    **_chord("sections[].lines[].markers[].chord"),
    "marker_position": Rule("sections[].lines[].markers[].char_position", between(0)),
    "marker_placement": Rule("sections[].lines[].markers[].placement", one_of(PLACEMENTS)),
    "word_span": Rule("sections[].lines[].words[]", span),
    "word_confidence": Rule("sections[].lines[].words[].confidence", _UNIT),
    "syllable_span": Rule("sections[].lines[].syllables[]", span),
    "syllable_word": Rule("sections[].lines[].syllables[].word", between(0)),
    "syllable_confidence": Rule("sections[].lines[].syllables[].confidence", _UNIT),
    "stage": Rule("provenance.confidence[].stage", one_of(STAGES)),
    "stage_mean": Rule("provenance.confidence[].mean", _UNIT),
    "stage_median": Rule("provenance.confidence[].median", _UNIT),
    "stage_p10": Rule("provenance.confidence[].p10", _UNIT),
    "backend": Rule("provenance.engines[].backend", one_of(BACKENDS)),
}


def _steps(path: str) -> list[str]:
    return path.replace("[]", ".[]").split(".")


#: Fields that a rule on a struct reads; such a rule applies where they are all there.
_READ = {span: ("t0", "t1"), meter: ("count", "unit"), bass_agrees: ("symbol", "bass_note")}


def applicable(schema: T.StructType, rules: dict[str, Rule] = DOCUMENT) -> dict[str, Rule]:
    """The rules whose path, and whose struct's fields, the schema has: a table may hold a part of the documents."""

    def there(rule: Rule) -> bool:
        at: T.DataType = schema
        for step in _steps(rule.path):
            if step == "[]" and isinstance(at, T.ArrayType):
                at = at.elementType
            elif isinstance(at, T.StructType) and step in at.names:
                at = at[step].dataType
            else:
                return False
        wanted = ("line_type", "measures") if rule is rules.get("line_measures") else _READ.get(rule.holds, ())
        return not wanted or isinstance(at, T.StructType) and set(wanted) <= set(at.names)

    return {name: rule for name, rule in rules.items() if there(rule)}


def times_broken(rule: Rule) -> Column:
    """How often a row breaks the rule."""
    zero = F.lit(0).cast("long")

    def at(value: Column, steps: list[str]) -> Column:
        if not steps:
            fine = F.coalesce(rule.holds(value), F.lit(False))
            return F.when((value.isNull() & F.lit(rule.optional)) | fine, zero).otherwise(zero + 1)
        if steps[0] == "[]":
            return F.coalesce(F.aggregate(value, zero, lambda n, x: n + inside(x, steps[1:])), zero)
        return inside(value[steps[0]], steps[1:])

    def inside(value: Column, steps: list[str]) -> Column:
        return F.when(value.isNull(), zero).otherwise(at(value, steps)) if steps else at(value, steps)

    first, *rest = _steps(rule.path)
    return inside(F.col(f"`{first}`"), rest)


def violations(documents: DataFrame, id_: list[str], rules: dict[str, Rule] | None = None) -> DataFrame:
    """id, rule, n: one row per document and rule that it breaks, n times. A map over the rows, read once."""
    chosen = applicable(documents.schema) if rules is None else rules
    if not chosen:
        return documents.select(*id_, F.lit("").alias("rule"), F.lit(0).cast("long").alias("n")).where("false")
    told = F.array(*[F.struct(F.lit(name).alias("rule"), times_broken(rule).alias("n")) for name, rule in chosen.items()])
    return documents.select(*id_, F.inline(F.filter(told, lambda x: x["n"] > 0)))


def observed(documents: DataFrame, name: str, rules: dict[str, Rule] | None = None) -> tuple[DataFrame, Observation]:
    """The same rows, and their counts once an action has read them all: documents, broken ones, and every rule's total (V4)."""
    chosen = applicable(documents.schema) if rules is None else rules
    counts = {rule: times_broken(r) for rule, r in chosen.items()}
    seen = Observation(name)
    broken = reduce(lambda a, b: a | b, [n > 0 for n in counts.values()], F.lit(False))
    totals = [F.coalesce(F.sum(n), F.lit(0)).alias(rule) for rule, n in counts.items()]
    return documents.observe(seen, F.count(F.lit(1)).alias("documents"), F.count_if(broken).alias("broken"), *totals), seen


def valid(documents: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Documents that break no rule."""
    chosen = applicable(documents.schema) if rules is None else rules
    return documents.where(reduce(lambda a, b: a & b, [times_broken(r) == 0 for r in chosen.values()], F.lit(True)))
