"""Catalogue queries over documents, conversations, pages and the other tables, each with its SQL for DuckDB where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols, text
from ..operators import blocks, render, stats, validate
from ..sources import adapters as a
from ..sources import readers

V = text.VOWELS


def q_syllables(spark, sf):
    words = a.distinct_words(spark, sf)
    return words.select("word", F.array_join(text.syllables(F.col("word")), "|").alias("syllables"))


_DISTINCT = f"words AS (SELECT DISTINCT unnest({a.WORDS_SQL}) AS word FROM documents)"


def _cut_sql(part: str) -> str:
    """Syllables of a part: breaks before one consonant between vowels, or after the first of several; a match takes its last vowel along, so each rule is applied twice."""
    one, several = f"'([{V}])([^{V}\x01][{V}])', '\\1\x01\\2', 'g'", f"'([{V}][^{V}\x01])([^{V}\x01]+[{V}])', '\\1\x01\\2', 'g'"
    return f"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({part}, {one}), {one}), {several}), {several}), '\x01')"


#: Words and their parts at hyphens; a word of hyphens alone is its own part.
_PARTS = """
found AS (SELECT word, list_filter(string_split(word, '-'), lambda x: x <> '') AS f FROM words),
parted AS (SELECT word, CASE WHEN len(f) = 0 THEN [word] ELSE f END AS parts FROM found)"""
_SYLLABLES = f"""{_PARTS},
syl AS (SELECT word, flatten(list_transform(parts, lambda p: {_cut_sql("p")})) AS s FROM parted)"""


Q_SYLLABLES = f"""WITH {_DISTINCT},{_SYLLABLES} SELECT word, array_to_string(s, '|') AS syllables FROM syl"""


def q_stress(spark, sf):
    words = a.distinct_words(spark, sf).select("word", text.syllables(F.col("word")).alias("parts"))
    return words.select("word", F.size("parts").alias("n"), text.stress(F.col("word"), F.col("parts")).cast("int").alias("stressed"))


Q_STRESS = f"""WITH {_DISTINCT},{_SYLLABLES},
s AS (SELECT word, len(s) AS n, list_position(list_transform(s, lambda x: regexp_matches(lower(x), '[áéíóúâêîôûãõàèìòù]')), true) - 1 AS accent FROM syl)
SELECT word, CAST(n AS INT) AS n, CAST(CASE WHEN accent >= 0 THEN accent WHEN regexp_matches(lower(word), '(r|l|z|x|i|u|im|um|om|ins|uns|ons)$') THEN n - 1 ELSE greatest(0, n - 2) END AS INT) AS stressed FROM s"""


def q_syllable_time(spark, sf):
    """Every syllable's span in a word that lasts 100 ms a letter: parts at hyphens by length, syllables in equal steps."""
    words = a.distinct_words(spark, sf)
    spans = text.syllable_spans(F.col("word"), F.lit(0), F.length("word") * 100_000)
    return words.select("word", F.posexplode(spans).alias("i", "x")).select("word", "i", "x.*")


Q_SYLLABLE_TIME = f"""WITH {_DISTINCT},{_PARTS},
e AS (SELECT word, length(word) * 100000 AS d, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS p FROM parted),
shared AS (SELECT *, list_sum(list_transform(parts[1:p - 1], lambda x: length(x))) AS before, list_sum(list_transform(parts, lambda x: length(x))) AS total FROM e),
timed AS (SELECT word, p, {_cut_sql("part")} AS s, CASE WHEN p = 1 THEN 0 ELSE d * before // total END AS a, CASE WHEN p = len(parts) THEN d ELSE d * (coalesce(before, 0) + length(part)) // total END AS b FROM shared),
steps AS (SELECT word, p, a, b, len(s) AS n, unnest(s) AS syllable, generate_subscripts(s, 1) - 1 AS k FROM timed)
SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY p, k) - 1 AS INT) AS i, syllable,
       CAST(a + k * (b - a) // n AS BIGINT) AS t0, CAST(CASE WHEN k + 1 = n THEN b ELSE a + (k + 1) * (b - a) // n END AS BIGINT) AS t1 FROM steps"""


def q_phoneme_groups(spark, sf):
    """Letters as phonemes: number of groups and the last letter's group."""
    flags = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: c.rlike(f"[{V}]"))
    words = a.distinct_words(spark, sf).select("word", text.phoneme_groups(flags).alias("g"))
    return words.select("word", F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("groups"))


Q_PHONEME_GROUPS = f"""WITH {_DISTINCT},
l AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS pos FROM words),
f AS (SELECT word, pos, CASE WHEN regexp_matches(c, '[{V}]') THEN 1 ELSE 0 END AS v FROM l),
g AS (SELECT word, pos, coalesce(sum(v) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(v) OVER (PARTITION BY word) AS n FROM f)
SELECT word, string_agg(CAST(CAST(least(before, greatest(0, n - 1)) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS groups FROM g GROUP BY word"""


def q_sanitize(spark, sf):
    return a.distinct_words(spark, sf).select("word", text.sanitised(F.col("word")).alias("clean"))


Q_SANITIZE = f"WITH {_DISTINCT} SELECT word, lower(regexp_replace(translate(word, '{text._ACCENTS}', '{text._PLAIN}'), '[^A-Za-z]', '', 'g')) AS clean FROM words"


def _lines(spark, sf):
    """Turns as lines of words joined by single blanks."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return a.turns(spark, sf).select("conv_id", "turn", words.alias("words"))


_LINES = rf"lines AS (SELECT conv_id, turn, {a.WORDS_SQL} AS words FROM conversations), spread AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM lines)"
_OFFSETS = "offsets AS (SELECT conv_id, turn, pos, word, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_char FROM spread)"


def _word_offsets(spark, sf):
    spread = _lines(spark, sf).select("conv_id", "turn", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos") + 1)
    found = blocks.running_sum(spread, ["conv_id", "turn"], ["pos"], (F.length("word") + 1).cast("long"), "upto")
    return found.select("conv_id", "turn", "pos", "word", (F.col("upto") - F.length("word") - 1).alias("at_char"))


def q_word_offsets(spark, sf):
    return _word_offsets(spark, sf)


Q_WORD_OFFSETS = f"WITH {_LINES}, {_OFFSETS} SELECT conv_id, turn, pos, word, at_char FROM offsets"


def q_syllable_offsets(spark, sf):
    """Offsets of two halves of every word."""
    halves = _word_offsets(spark, sf).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return halves.select("conv_id", "turn", "pos", "i", text.syllable_offset(F.col("at_char"), F.col("i"), F.length("word"), F.lit(2)).cast("long").alias("at_char"))


Q_SYLLABLE_OFFSETS = f"WITH {_LINES}, {_OFFSETS} SELECT conv_id, turn, pos, CAST(i AS INT) AS i, at_char + i * length(word) // 2 AS at_char FROM offsets, (VALUES (0), (1)) v(i)"


def q_chord_extract(spark, sf):
    """Documents of a directive and a turn's whole text, its role and every word of letters before a blank in brackets."""
    made = F.concat(F.lit("{c: [X]}\n["), "role", F.lit("]"), F.regexp_replace(F.coalesce("text", F.lit("")), "([A-Za-z]+) ", "[ $1] "))
    found = a.turns(spark, sf).select("conv_id", "turn", text.bracketed(made).alias("found"))
    return found.select("conv_id", "turn", F.array_join("found", "|").alias("found"))


Q_CHORD_EXTRACT = r"""
WITH m AS (SELECT conv_id, turn, '{c: [X]}' || chr(10) || '[' || role || ']' || regexp_replace(coalesce(text, ''), '([A-Za-z]+) ', '[ \1] ', 'g') AS doc FROM conversations),
l AS (SELECT conv_id, turn, list_filter(string_split(doc, chr(10)), lambda x: NOT regexp_full_match(x, '\s*\{[^}]*\}\s*')) AS lines FROM m)
SELECT conv_id, turn, array_to_string(list_transform(flatten(list_transform(lines, lambda x: regexp_extract_all(x, '\[([^\[\]]+)\]', 1))), lambda s: trim(s, ' ')), '|') AS found FROM l"""


#: Symbols that go with a part's key, in order, and what the labels' rules say of them: label, label without bass, root, symbol made of the label (fixed values).
SYMBOLS = (
    ("C", "C:maj", "C:maj", "C", "C"),
    ("Gm7", "G:min7", "G:min7", "G", "Gm7"),
    ("F7M/A", "F:maj7/A", "F:maj7", "F", "Fmaj7/A"),
    ("Esus/B", "E:maj/B", "E:maj", "E", "Emaj/B"),
    ("D9", "D:maj", "D:maj", "D", "D"),
    ("C+", "C:aug", "C:aug", "C", "Caug"),
    ("Bm7b5", "B:min", "B:min", "B", "Bm"),
    ("C13", "C:maj", "C:maj", "C", "C"),
    ("N", "N", "N", None, None),
    ("Bbm/Db", "Bb:min/Db", "Bb:min", "A#", "Bbm/Db"),
    ("Cmaj7", "C:maj7", "C:maj7", "C", "Cmaj7"),
    ("A6", "A:maj", "A:maj", "A", "A"),
    ("Edim", "E:dim", "E:dim", "E", "Edim"),
    ("F#m", "F#:min", "F#:min", "F#", "F#m"),
    ("G7", "G:7", "G:7", "G", "G7"),
    ("Dsus4", "D:maj", "D:maj", "D", "D"),
    ("hello", "hello", "hello", None, "hello"),
    ("C/9", "C:maj", "C:maj", "C", "C"),
    ("Cm7/x", "C:min", "C:min", "C", "Cm"),
    ("Gsus4/add9", "G:maj", "G:maj", "G", "G"),
)
_NOTES = (None, "E", "", "F#")


def _part_symbols(spark, sf):
    names, notes = F.array(*[F.lit(s[0]) for s in SYMBOLS]), F.array(*[F.lit(n) for n in _NOTES])
    at = lambda items, n: F.element_at(items, (F.col("p_partkey") % n + 1).cast("int"))
    return a.table(spark, sf, "part").select("p_partkey", at(names, len(SYMBOLS)).alias("symbol"), at(notes, len(_NOTES)).alias("note"))


def q_chord_labels(spark, sf):
    label = symbols.label(F.col("symbol"))
    return _part_symbols(spark, sf).select("p_partkey", "symbol", label.alias("label"), symbols.without_bass(label).alias("plain"), symbols.root(F.col("symbol")).alias("root"), symbols.from_engine(label).alias("back"))


def _values(rows) -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    return "(VALUES " + ", ".join(f"({i}, {', '.join(quoted(x) for x in row)})" for i, row in enumerate(rows)) + ")"


_SYMBOL_ROWS = f"{_values(SYMBOLS)} v(i, symbol, label, plain, root, back)"
Q_CHORD_LABELS = f"SELECT p_partkey, symbol, label, plain, root, back FROM part JOIN {_SYMBOL_ROWS} ON p_partkey % {len(SYMBOLS)} = i"


def q_event_labels(spark, sf):
    """Labels of chord events with a bass note of their own (F15), and whether it is the one after the symbol's slash (V3)."""
    label = symbols.labelled(F.col("symbol"), F.col("note"))
    return _part_symbols(spark, sf).select("p_partkey", label.alias("label"), symbols.slash_agrees(F.col("symbol"), F.nullif("note", F.lit(""))).alias("agrees"))


Q_EVENT_LABELS = f"""
SELECT p_partkey, label || coalesce('/' || nullif(note, ''), '') AS label,
  position('/' IN symbol) = 0 OR coalesce(note, '') = '' OR split_part(symbol, '/', 2) = note AS agrees
FROM part JOIN {_SYMBOL_ROWS} ON p_partkey % {len(SYMBOLS)} = v.i JOIN {_values([(n,) for n in _NOTES])} n(j, note) ON p_partkey % {len(_NOTES)} = n.j"""


def _links(spark, sf):
    """Pages' links, and links of four shapes made of them."""
    p = a.table(spark, sf, "pages")
    id_ = F.substring(F.md5(F.col("url").cast("binary")), 1, 11)
    shapes = F.array(F.col("url"), F.concat(F.lit("https://youtu.be/"), id_), F.concat(F.lit("https://www.youtube.com/watch?v="), id_, F.lit("&t=10s")), F.concat(F.lit("https://www.youtube.com/embed/"), id_), F.lit(""))
    return p.select("page_id", F.posexplode(shapes).alias("shape", "link"))


def q_url_id(spark, sf):
    return _links(spark, sf).select("page_id", "shape", text.link_id(F.col("link")).alias("id"), text.loose_link_id(F.col("link")).alias("loose"))


_LINKS_SQL = """
links AS (SELECT page_id, CAST(shape AS INT) AS shape, CASE shape WHEN 0 THEN url WHEN 1 THEN 'https://youtu.be/' || id WHEN 2 THEN 'https://www.youtube.com/watch?v=' || id || '&t=10s' WHEN 3 THEN 'https://www.youtube.com/embed/' || id ELSE '' END AS link
  FROM (SELECT page_id, url, substr(md5(url), 1, 11) AS id FROM pages), (VALUES (0), (1), (2), (3), (4)) v(shape))"""
_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(link, '{p}', 1), '')" for p in text.LINKS) + ")"
_LOOSE = "string_split_regex(CASE WHEN contains(link, 'v=') THEN string_split(link, 'v=')[2] ELSE string_split(string_split(link, '?')[1], '/')[-1] END, '[&?]')[1]"
Q_URL_ID = f"WITH {_LINKS_SQL} SELECT page_id, shape, {_ID} AS id, CASE WHEN length({_LOOSE}) >= 11 THEN {_LOOSE} END AS loose FROM links"


def q_slugify(spark, sf):
    return a.table(spark, sf, "part").select("p_partkey", text.slug(F.concat(F.lit(" ("), "p_name", F.lit(")! "), "p_brand")).alias("slug"), text.slug(F.lit("?!")).alias("none"))


Q_SLUGIFY = "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(' (' || p_name || ')! ' || p_brand, '[^A-Za-z0-9_-]+', '-', 'g'), '-'), ''), 'untitled') AS slug, 'untitled' AS none FROM part"


def q_lang_norm(spark, sf):
    tag = F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "-BR").otherwise("_us"))
    return a.table(spark, sf, "documents").select("doc_id", text.base_language(tag).alias("base"))


Q_LANG_NORM = "SELECT doc_id, lower(split_part(split_part(upper(lang) || CASE WHEN doc_id % 2 = 0 THEN '-BR' ELSE '_us' END, '-', 1), '_', 1)) AS base FROM documents"


def q_confidence(spark, sf):
    items = a.table(spark, sf, "lineitem").select("l_returnflag", (1 - F.col("l_discount")).alias("c"))
    return stats.confidence(items, ["l_returnflag"], "c").select("l_returnflag", "n", F.round("mean", 6).alias("mean"), "upper_median", "p10")


Q_CONFIDENCE = "SELECT l_returnflag, count(*) AS n, round(avg(1 - l_discount), 6) AS mean, list_sort(list(1 - l_discount))[count(*) // 2 + 1] AS upper_median, list_sort(list(1 - l_discount))[count(*) // 10 + 1] AS p10 FROM lineitem GROUP BY l_returnflag"


def q_line_confidence(spark, sf):
    key = ["l_returnflag"]
    items = a.table(spark, sf, "lineitem")
    by_order = a.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("l_returnflag"), (F.col("o_totalprice") / 1e6).alias("confidence"))
    keys = items.select("l_returnflag").union(by_order.select("l_returnflag")).union(spark.range(1).select(F.lit("Z").alias("l_returnflag"))).distinct()
    found = stats.union_confidence([items.select("l_returnflag", (1 - F.col("l_discount")).alias("confidence")), by_order], keys, key)
    return found.select("l_returnflag", F.round("confidence", 6).alias("confidence"))


Q_LINE_CONFIDENCE = """
WITH u AS (SELECT l_returnflag, 1 - l_discount AS c FROM lineitem UNION ALL SELECT o_orderstatus, o_totalprice / 1e6 FROM orders UNION ALL SELECT 'Z', NULL)
SELECT l_returnflag, round(coalesce(avg(c), 1.0), 6) AS confidence FROM u GROUP BY l_returnflag"""


def q_bass_note(spark, sf):
    """Of chroma vectors; an embedding's first twelve components stand for one."""
    found = stats.bass_note(a.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", symbols.pitch_letter(F.col("pitch_class").cast("int")).alias("note"), F.round("confidence", 6).alias("confidence"))


Q_BASS_NOTE = (
    "WITH v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS c FROM embeddings WHERE len(embedding) >= 12), "
    "s AS (SELECT vec_id, c, list_max(c) AS top, (list_sort(c)[6] + list_sort(c)[7]) / 2 AS middle FROM v), "
    "f AS (SELECT *, CASE WHEN top > 0 THEN greatest(0.0, (top - middle) / top) ELSE 0.0 END AS sure FROM s) "
    "SELECT vec_id, CASE WHEN top > 0 AND sure >= 0.5 THEN list_value(" + ", ".join(f"'{p}'" for p in symbols.PITCHES) + ")[list_position(c, top)] END AS note, round(sure, 6) AS confidence FROM f"
)


def _markers(spark, sf):
    """A marker at the start of every third word, and one at the start of the line."""
    at = _word_offsets(spark, sf).where("pos % 3 = 1")
    return at.select("conv_id", "turn", F.col("at_char").alias("pos"), F.col("pos").alias("idx"), symbols.bracket(F.lit("C"), F.when(F.col("pos") % 2 == 0, F.lit("E"))).alias("chord"))


def q_render_lyric(spark, sf):
    lines = _lines(spark, sf).select("conv_id", "turn", F.array_join("words", " ").alias("text"))
    return render.lyric_lines(lines, _markers(spark, sf).withColumn("pos", F.col("pos").cast("int")).withColumn("idx", F.col("idx").cast("int")), ["conv_id", "turn"]).select("conv_id", "turn", "line")


Q_RENDER_LYRIC = f"""WITH {_LINES},
p AS (SELECT conv_id, turn, pos, (CASE WHEN pos % 3 = 1 THEN CASE WHEN pos % 2 = 0 THEN '[C/E]' ELSE '[C]' END ELSE '' END) || word AS piece FROM spread),
j AS (SELECT conv_id, turn, string_agg(piece, ' ' ORDER BY pos) AS line FROM p GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(line, '') AS line FROM lines LEFT JOIN j USING (conv_id, turn)"""


def _cells(spark, sf):
    from .timed import _numbered_onsets

    return _numbered_onsets(spark, sf).withColumn("symbol", symbols.pitch_letter(F.when(F.col("label") == "N", F.lit(11)).otherwise(F.try_to_number("label", F.lit("99"))).cast("int")))


def q_render_grid(spark, sf):
    cells = _cells(spark, sf)
    full = render.grid_bars(cells, ["track_id"], "full").withColumnRenamed("line", "full")
    half = render.grid_bars(cells, ["track_id"], "half").withColumnRenamed("line", "half")
    beat = render.grid_bars(cells, ["track_id"], "beat").withColumnRenamed("line", "beat")
    inline = render.inline_bars(cells, ["track_id"], "half").withColumnRenamed("line", "inline")
    return full.join(half, "track_id").join(beat, "track_id").join(inline, "track_id")


Q_RENDER_GRID = (
    a.ctes("onsets")
    + ", c AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, idx) - 1 AS i, list_value("
    + ", ".join(f"'{p}'" for p in symbols.PITCHES)
    + """)[pc + 1] AS s FROM onsets),
f AS (SELECT track_id, '| ' || string_agg(s || ' . . .', ' | ' ORDER BY i) || ' |' AS "full" FROM c GROUP BY track_id),
h AS (SELECT track_id, i // 2 AS b, max(s) FILTER (i % 2 = 0) AS x, coalesce(max(s) FILTER (i % 2 = 1), max(s) FILTER (i % 2 = 0)) AS y FROM c GROUP BY track_id, i // 2),
g AS (SELECT track_id, '| ' || string_agg(x || ' . ' || y || ' .', ' | ' ORDER BY b) || ' |' AS half, string_agg('[' || x || ']x/[' || y || ']/', '   ' ORDER BY b) AS inline FROM h GROUP BY track_id),
q AS (SELECT track_id, i // 4 AS b, string_agg(s, ' ' ORDER BY i) AS line FROM c GROUP BY track_id, i // 4),
r AS (SELECT track_id, '| ' || string_agg(line, ' | ' ORDER BY b) || ' |' AS beat FROM q GROUP BY track_id)
SELECT track_id, "full", half, beat, inline FROM f JOIN g USING (track_id) JOIN r USING (track_id)"""
)


def q_render_header(spark, sf):
    c = a.table(spark, sf, "customer")
    metas = F.array(F.concat(F.lit("segment "), "c_mktsegment"))
    head = render.header(F.col("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise(F.lit("")), F.lit("C"), F.col("c_nationkey") + 60, F.lit("4/4"), F.col("c_custkey") % 5, metas)
    return c.select("c_custkey", head.alias("header"))


Q_RENDER_HEADER = """
SELECT c_custkey, concat_ws(chr(10), '{title: ' || c_name || '}', CASE WHEN c_custkey % 3 > 0 THEN '{artist: ' || c_mktsegment || '}' END, '{key: C}', '{tempo: ' || (c_nationkey + 60) || '}', '{time: 4/4}',
  CASE WHEN c_custkey % 5 > 0 THEN '{capo: ' || (c_custkey % 5) || '}' END, '{meta: segment ' || c_mktsegment || '}') || chr(10) AS header FROM customer"""


def q_section_wrap(spark, sf):
    t = a.turns(spark, sf)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("verse", "chorus", "bridge", "intro", "outro")]), (F.col("turn") % 5 + 1).cast("int"))
    return t.select("conv_id", "turn", render.wrapped(kind, F.initcap(kind), F.coalesce("text", F.lit(""))).alias("body"))


Q_SECTION_WRAP = """
WITH k AS (SELECT conv_id, turn, coalesce(text, '') AS body, list_value('verse', 'chorus', 'bridge', 'intro', 'outro')[turn % 5 + 1] AS kind FROM conversations),
l AS (SELECT *, upper(kind[1]) || kind[2:] AS label FROM k)
SELECT conv_id, turn, CASE WHEN kind IN ('verse', 'chorus', 'bridge') THEN '{start_of_' || kind || ': ' || label || '}' || chr(10) || body || chr(10) || '{end_of_' || kind || '}' ELSE '{c: ' || label || '}' || chr(10) || body END AS body FROM l"""


def q_render_document(spark, sf):
    """A header and the turns as sections, in order."""
    sections = q_section_wrap(spark, sf).select("conv_id", F.col("turn").alias("seq"), "body")
    headers = sections.select("conv_id").distinct().withColumn("header", F.concat(F.lit("{title: Talk "), F.col("conv_id").cast("string"), F.lit("}\n")))
    return render.documents(headers, sections, ["conv_id"])


Q_RENDER_DOCUMENT = f"WITH s AS ({Q_SECTION_WRAP}) SELECT conv_id, '{{title: Talk ' || conv_id || '}}' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY turn) AS document FROM s GROUP BY conv_id"


def q_title_map(spark, sf):
    p = a.table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "https?://([^/]+)", 1))
    return readers.title_map(p.withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "host", "title", "page_id")


Q_TITLE_MAP = "SELECT host, arg_max(title, page_id) AS title FROM (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) GROUP BY host"


def q_cache_miss(spark, sf):
    return readers.missing(a.table(spark, sf, "documents").select("doc_id", "lang"), a.table(spark, sf, "labels"), ["doc_id"])


Q_CACHE_MISS = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def q_failures(spark, sf):
    joined = a.table(spark, sf, "documents").join(a.table(spark, sf, "labels"), "doc_id")
    marked = validate.with_reason(joined, {"empty": F.length(F.coalesce("text", F.lit(""))) == 0, "low quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return marked.where("reason IS NOT NULL").select("doc_id", "reason")


Q_FAILURES = "SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' WHEN quality = 0 THEN 'low quality' ELSE 'toxic' END AS reason FROM documents JOIN labels USING (doc_id) WHERE length(coalesce(text, '')) = 0 OR quality = 0 OR toxic = 1"


def q_segments(spark, sf):
    """Turns as speech segments of their whole texts; every tenth is a wholly bracketed mark."""
    t = a.turns(spark, sf)
    said = F.when(F.col("turn") % 10 == 3, F.concat(F.lit("["), "role", F.lit("]"))).otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    segments = t.select(F.col("conv_id").alias("track_id"), F.col("turn").alias("seq"), said.alias("text"), (F.col("turn") * 100).alias("t0_cs"), (F.col("turn") * 100 + F.when(F.col("turn") % 2 == 0, 50).otherwise(-5)).alias("t1_cs"))
    return readers.segment_words(segments)


Q_SEGMENTS = """SELECT conv_id AS track_id, turn AS seq, trim(text, ' ') AS text, turn * 1000000 AS t0, greatest(turn * 100, turn * 100 + CASE WHEN turn % 2 = 0 THEN 50 ELSE -5 END) * 10000 AS t1
FROM conversations WHERE turn % 10 <> 3 AND trim(text, ' ') <> '' AND NOT regexp_full_match(text, '\\s*\\[[^\\[\\]]*\\]\\s*')"""


def q_language_counts(spark, sf):
    """Whole-text statistics by language and source, with roll-ups."""
    d = a.table(spark, sf, "documents")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.grouping_id().cast("int").alias("level"))


Q_LANGUAGE_COUNTS = "SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(grouping(lang, source) AS INT) AS level FROM documents GROUP BY ROLLUP (lang, source)"


def q_stream_sessions(spark, sf):
    """Sessions of a track's events with a fixed gap, as a batch; tests hold the stream against it."""
    from ..streaming.sessions import session_counts

    e = a.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = session_counts(e, "user_id", "ts", "6 hours")
    return found.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


Q_STREAM_SESSIONS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN t - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY user_id, g"""
