"""Text functions as column expressions: syllables, stress, offsets, extraction, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vowels of the orthographic rules (fixed values): plain, acute, circumflex, tilde, grave, diaeresis.
VOWELS = "aeiouyáéíóúýâêîôûãõàèìòùäëïöüAEIOUYÁÉÍÓÚÝÂÊÎÔÛÃÕÀÈÌÒÙÄËÏÖÜ"
#: Written accents that carry stress, and endings of words stressed on the last syllable (fixed values).
ACCENTED = "áéíóúâêîôûãõàèìòù"
LAST_STRESSED = ("r", "l", "z", "x", "i", "u", "im", "um", "om", "ins", "uns", "ons")
#: Elements of one block of a running sum.
BLOCK = 1024
#: Phoneme vowels (fixed values).
ARPABET_VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
#: Phonetic vowels: single, falling together, nasal (fixed values).
IPA_VOWELS = (
    ("i", "ɪ", "e", "ɛ", "æ", "a", "ɑ", "ɒ", "ʌ", "ɔ", "o", "ʊ", "u", "y", "ø", "œ", "ɶ", "ɨ", "ʉ", "ɯ", "ə", "ɚ", "ɜ", "ɝ", "ɐ")
    + ("eɪ", "aɪ", "ɔɪ", "aʊ", "oʊ", "ɛə", "ɪə", "ʊə")
    + ("ɐ̃", "ẽ", "ĩ", "õ", "ũ", "ɐ̃ʊ̃", "õĩ", "ɐ̃ĩ")
)
_ACCENTS = "áàâãäåéèêëíìîïóòôõöúùûüýÿçñÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÝÇÑ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyycnAAAAAAEEEEIIIIOOOOOUUUUYCN"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def _cut(part: Column) -> Column:
    """A part without hyphens, cut so that one consonant goes to the next vowel and of several the first stays."""
    v, c = f"[{VOWELS}]", f"[^{VOWELS}]"
    return F.split(part, f"(?<={v})(?={c}{v})|(?<={v}{c})(?={c}+{v})")


def _parts(word: Column) -> Column:
    """Parts at hyphens; a word of nothing but hyphens is its own part."""
    found = F.filter(F.split(word, "-"), lambda p: p != "")
    return F.when((F.size(found) == 0) & (word != ""), F.array(word)).otherwise(found)


def syllables(word: Column) -> Column:
    """The syllables of a word's parts at hyphens; hyphens alone are one syllable, an empty word has none (F1)."""
    return F.flatten(F.transform(_parts(word), _cut))


def syllable_spans(word: Column, t0: Column, t1: Column) -> Column:
    """Syllables with their time (syllable, t0, t1): parts share the word's by length, syllables a part's in equal steps."""

    def steps(part: Column) -> Column:
        at = lambda s, k: interpolated(part["t0"], part["t1"], k, F.size(s)).cast("long")
        return let(_cut(part["part"]), lambda s: F.transform(s, lambda x, k: F.struct(x.alias("syllable"), at(s, k).alias("t0"), at(s, k + 1).alias("t1"))))

    return F.flatten(F.transform(part_spans(word, t0, t1), steps))


def stress(word: Column, parts: Column) -> Column:
    """0-based stressed syllable: the first with a written accent, else the last for certain endings, else the last but one."""
    accent = F.array_position(F.transform(parts, lambda p: F.lower(p).rlike(f"[{ACCENTED}]")), True)
    last = F.size(parts) - 1
    ends = F.lower(word).rlike("(" + "|".join(LAST_STRESSED) + ")$")
    return let(accent, lambda at: F.when(at > 0, (at - 1).cast("int")).when(ends, last).otherwise(F.greatest(F.lit(0), last - 1)))


def stress_by_language(language: Column, word: Column, parts: Column) -> Column:
    """0-based stressed syllable by the language's rules: Portuguese by spelling, all others (English too) the first."""
    return F.when(language == "pt", stress(word, parts)).otherwise(F.lit(0))


def pronounced(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Words with their lexicon entry's syllables and stress (word, parts, stressed), where there is none by spelling (F8). The lexicon has one row per word."""
    spelled = syllables(F.col(word))
    known = lexicon.select(F.col("word").alias("__known"), "parts", "stressed")
    found = words.join(known, F.lower(F.col(word)) == F.col("__known"), "left")
    return found.select(*words.columns, F.coalesce("parts", spelled).alias("parts"), F.coalesce("stressed", stress(F.col(word), spelled)).cast("int").alias("stressed"), F.col("__known").isNotNull().alias("in_lexicon"))


def part_spans(word: Column, t0: Column, t1: Column) -> Column:
    """Parts at hyphens with their share of the word's time by length: (part, t0, t1), the last one to the end."""

    def spans(found: Column) -> Column:
        upto = running_sum(F.transform(found, lambda p: F.length(p)))
        at = lambda s, i: F.when(i >= F.size(found), t1).otherwise(t0 + F.floor((t1 - t0) * F.get(s, i) / F.element_at(s, -1)))
        return let(upto, lambda s: F.transform(found, lambda p, i: F.struct(p.alias("part"), at(s, i).cast("long").alias("t0"), at(s, i + 1).cast("long").alias("t1"))))

    return let(_parts(word), spans)


def decimals(x: Column, places: int) -> Column:
    """A number from 0 to 1 with up to three decimals, by its exact binary value, ties to even."""
    scaled, tens = x * F.lit(float(1 << 53)), 10**places
    whole = F.floor(scaled).cast("long")

    def rounded(w: Column) -> Column:
        down = F.shiftright(w * tens, 53)
        beyond = (w * tens - F.shiftleft(down, 53) - (1 << 52)).cast("double") + (scaled - w) * tens  # the half of a last place
        return down + F.when((beyond > 0) | ((beyond == 0) & (down % 2 == 1)), 1).otherwise(0)

    told = let(whole, rounded)
    return let(told, lambda c: F.concat(F.floor(c / tens).cast("string"), F.lit("."), F.lpad((c % tens).cast("string"), places, "0")))


def two_decimals(x: Column) -> Column:
    """A number from 0 to 1 with two decimals."""
    return decimals(x, 2)


def failure_message(message: Column, stage: Column, engine: Column, audio_id: Column, cause: Column) -> Column:
    """A message and what is known of its context, ids cut to twelve characters."""
    named = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), c))
    return F.concat_ws(" | ", message, named("stage", stage), named("engine", engine), named("audio_id", F.substring(audio_id, 1, 12)), F.when(cause.isNotNull(), F.concat(F.lit("caused_by="), cause)))


def lexicon_stress(phones: Column) -> Column:
    """Ordinal among a pronunciation's vowels of the last one with primary stress; 0 without."""
    vowels = F.filter(phones, lambda p: p.rlike("[0-2]$"))
    marks = F.transform(vowels, lambda p: p.endswith("1"))
    return F.greatest(F.lit(0), F.size(marks) - F.array_position(F.reverse(marks), True).cast("int")) * F.when(F.array_contains(marks, True), 1).otherwise(0)


def stress_level(symbol: Column) -> Column:
    """-1 for consonants, else 0, 1 or 2: a digit at the end, or a stress mark before."""
    digit = F.regexp_extract(symbol, "([0-2])$", 1)
    return F.when(digit != "", digit.cast("int")).when(symbol.startswith("ˈ"), 1).when(symbol.startswith("ˌ"), 2).when(is_vowel(symbol), 0).otherwise(-1)


def is_vowel(symbol: Column) -> Column:
    """Whether a symbol, without a digit at its end and stress marks before, is a vowel: capitals by ARPABET, others by the phonetic vowels or as a single letter."""
    bare = F.regexp_replace(F.regexp_replace(symbol, "[0-2]$", ""), "^[ˈˌ]+", "")
    return F.when(bare.rlike("^[A-Z]+$"), bare.isin(*ARPABET_VOWELS)).otherwise(bare.isin(*IPA_VOWELS) | bare.rlike(f"^[{VOWELS}]$"))


def running_sum(values: Column) -> Column:
    """Sum of an int array's elements before each one, and of all at the end: blocks of BLOCK are summed up one by one, then shifted."""
    none = F.array().cast("array<int>")

    def sums(items: Column) -> Column:
        return F.aggregate(items, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def shifted(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(ends, lambda e: F.array_append(F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(e, i)))), F.element_at(e, -1)))

    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda at: sums(F.slice(v, at, F.lit(BLOCK))))
    return let(F.coalesce(values, none), lambda v: F.when(F.size(v) > 0, let(cut(v), shifted)).otherwise(F.array(F.lit(0))))


def phoneme_groups(vowel_flags: Column) -> Column:
    """Syllable number of every symbol by maximal onset: vowels before it, the tail joining the last one; 0 without vowels."""
    ones = F.transform(vowel_flags, lambda x: F.when(x, 1).otherwise(0))
    return let(running_sum(ones), lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: F.least(x, F.greatest(F.lit(0), F.element_at(s, -1) - 1))))


def sanitised(word: Column) -> Column:
    """Letters a-z of a Latin word, accents taken off."""
    return F.lower(F.regexp_replace(F.translate(word, _ACCENTS, _PLAIN), "[^A-Za-z]", ""))


def word_offsets(words: Column) -> Column:
    """Start of every word in the line joined by single blanks."""
    return let(running_sum(F.transform(words, lambda w: F.length(w) + 1)), lambda s: F.slice(s, F.lit(1), F.size(s) - 1))


def found_offsets(line: Column, words: Column) -> Column:
    """Start of every word by search from the end of the one before, case aside; where it isn't found, that end itself."""
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("places"))

    def step(acc, w):
        at = F.position(F.lower(w), F.lower(line), acc["cursor"] + 1)
        place = F.when(at > 0, at - 1).otherwise(acc["cursor"])
        return F.struct((place + F.when(at > 0, F.length(w)).otherwise(0)).alias("cursor"), F.array_append(acc["places"], place).alias("places"))

    return F.aggregate(words, start, step, lambda acc: acc["places"])


def syllable_offset(word_offset: Column, i: Column, word_length: Column, n: Column) -> Column:
    """Word's offset plus the i-th of n equal parts of its length, rounded down."""
    return word_offset + F.floor(i * word_length / n)


def proportional_offset(fraction: Column, length: Column) -> Column:
    """Half-even rounding of a share of the length, within it."""
    return F.greatest(F.lit(0), F.least(length, F.bround(fraction * length).cast("int")))


def bracketed(document: Column) -> Column:
    """Contents of [..] in order, trimmed, lines of directives {..} left out."""
    lines = F.filter(F.split(document, "\n"), lambda x: ~x.rlike(r"^\s*\{[^}]*\}\s*$"))
    return F.transform(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))), lambda s: F.trim(s))


#: Shapes of links that hold an id of eleven characters (fixed values).
LINKS = (r"youtu\.be/([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", r"[?&]v=([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", r"/embed/([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)")


def link_id(url: Column) -> Column:
    """Id by the first shape that fits; null without."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in LINKS])


def loose_link_id(url: Column) -> Column:
    """What follows v=, else the last path part, without the query; null below eleven characters."""
    after = F.when(url.contains("v="), F.element_at(F.split(url, "v="), 2)).otherwise(F.element_at(F.split(F.split(url, r"\?")[0], "/"), -1))
    bare = F.split(after, "[&?]")[0]
    return F.when(F.length(bare) >= 11, bare)


def slug(title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def base_language(tag: Column) -> Column:
    """pt-BR, en_US -> pt, en."""
    return F.lower(F.substring_index(F.substring_index(tag, "-", 1), "_", 1))


def interpolated(t0: Column, t1: Column, k: Column, n: Column) -> Column:
    """Time of the k-th of n equal steps; the last is the end itself."""
    return F.when(k >= n, t1).otherwise(t0 + F.floor(k * (t1 - t0) / n))
