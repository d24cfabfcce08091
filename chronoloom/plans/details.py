"""Catalogue queries for the smaller operators: predicates, lookups with fallback, nested documents, selections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import symbols, text
from ..operators import blocks, drain, halo, intervals, nested, phonemes, render, stats
from ..sources import adapters as a
from . import timed

HOUR = timed.HOUR
KEY = a.TRACK


def q_melisma(spark, sf):
    """Words of over an hour with more than one beat inside."""
    long_words = a.words(spark, sf).where(F.col("t1") - F.col("t0") > HOUR)
    return intervals.points_per_interval(long_words, a.beats(spark, sf), KEY, ["idx"]).where("n > 1").select("track_id", "idx", "n")


Q_MELISMA = a.ctes("words", "beats") + " SELECT w.track_id, w.idx, count(*) AS n FROM words w JOIN beats b ON w.track_id = b.track_id AND b.t BETWEEN w.t0 AND w.t1 WHERE w.t1 - w.t0 > 3600000000 GROUP BY ALL HAVING count(*) > 1"


def q_measures_in_span(spark, sf):
    """Whole measures of four beats in every chord's span, at least one."""
    found = timed.q_points_per_interval(spark, sf)
    return found.select("track_id", "idx", F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("long").alias("measures"))


Q_MEASURES_IN_SPAN = f"WITH p AS ({timed.Q_POINTS_PER_INTERVAL}) SELECT track_id, idx, greatest(1, n // 4) AS measures FROM p"


def q_left_fallback(spark, sf):
    """Words with the span of an aligned one (the click's own), or else their own times."""
    words = a.words(spark, sf)
    aligned = words.where("stressed").select("track_id", "idx", (F.col("t0") + 1000).alias("a0"), (F.col("t1") + 1000).alias("a1"))
    joined = words.join(aligned, ["track_id", "idx"], "left")
    return joined.select("track_id", "idx", F.coalesce("a0", "t0").alias("t0"), F.coalesce("a1", "t1").alias("t1"))


Q_LEFT_FALLBACK = a.ctes("words") + " SELECT track_id, idx, CASE WHEN stressed THEN t0 + 1000 ELSE t0 END AS t0, CASE WHEN stressed THEN t1 + 1000 ELSE t1 END AS t1 FROM words"


def q_parent_lookup(spark, sf):
    """Orders with their customer's segment and nation; unknown parents are left out."""
    orders = a.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nations = a.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return orders.join(customers, "o_custkey").join(nations, "c_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


Q_PARENT_LOOKUP = "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def q_bass_emission(spark, sf):
    """Chords with a found bass letter: whether to write it, the effective bass, and the bracket."""
    o = a.onsets(spark, sf).withColumn("symbol", F.concat(symbols.pitch_letter(F.col("pc")), F.when(F.col("idx") % 3 == 0, "/E").otherwise("m")))
    letter = symbols.pitch_letter((F.col("idx") % 12).cast("int"))
    emits = symbols.emits_bass(F.col("symbol"), letter)
    note = F.when(emits, letter)
    return o.select("track_id", "idx", "symbol", emits.alias("emits"), symbols.bass(F.col("symbol"), note).alias("bass"), symbols.bracket(F.col("symbol"), note).alias("bracket"))


_PITCH = "list_value(" + ", ".join(f"'{p}'" for p in symbols.PITCHES) + ")"
Q_BASS_EMISSION = (
    a.ctes("onsets")
    + f""", s AS (SELECT track_id, idx, {_PITCH}[pc + 1] AS root, {_PITCH}[pc + 1] || CASE WHEN idx % 3 = 0 THEN '/E' ELSE 'm' END AS symbol, {_PITCH}[idx % 12 + 1] AS letter FROM onsets),
e AS (SELECT *, NOT contains(symbol, '/') AND root <> letter AS emits FROM s)
SELECT track_id, idx, symbol, emits, CASE WHEN emits THEN letter WHEN contains(symbol, '/') THEN 'E' END AS bass,
       '[' || symbol || CASE WHEN emits THEN '/' || letter ELSE '' END || ']' AS bracket FROM e"""
)


def q_flatten_document(spark, sf):
    """Conversations as nested documents (sections of lines), flattened again in document order."""
    t = a.turns(spark, sf)
    sections = t.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("chars")))).alias("lines"))
    docs = sections.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "lines"))).alias("sections"))
    flat = docs.select("conv_id", F.posexplode("sections").alias("section", "s")).select("conv_id", "section", "s.role", F.posexplode("s.lines").alias("line", "l"))
    return flat.select("conv_id", "section", "role", "line", "l.turn", "l.chars")


Q_FLATTEN_DOCUMENT = """
SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS INT) AS section, role,
       CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, length(text)) - 1 AS INT) AS line, turn, CAST(length(text) AS INT) AS chars FROM conversations"""


def q_missing_kinds(spark, sf):
    """Wanted kinds of events that a track lacks."""
    wanted = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "refund", "signup", "view")])
    e = a.table(spark, sf, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.collect_set("event_type").alias("have"))
    return e.select("track_id", F.explode(F.array_except(wanted, "have")).alias("missing"))


Q_MISSING_KINDS = "SELECT t.track_id, w.kind AS missing FROM (SELECT DISTINCT user_id AS track_id FROM events) t, (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) w(kind) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.track_id AND e.event_type = w.kind)"


def q_audible_silence(spark, sf):
    """Tracks that sound (root mean square of values over 50) but have no purchases of over 99."""
    e = a.table(spark, sf, "events").withColumnRenamed("user_id", "track_id")
    loud = e.groupBy("track_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")).where("rms > 50")
    return loud.join(e.where("event_type = 'purchase' AND value > 99"), "track_id", "left_anti").select("track_id", F.round("rms", 6).alias("rms"))


Q_AUDIBLE_SILENCE = "SELECT user_id AS track_id, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id HAVING sqrt(avg(value * value)) > 50 AND count(*) FILTER (event_type = 'purchase' AND value > 99) = 0"


def q_last_selection(spark, sf):
    """A track's last event of each kind, and the first of all."""
    e = a.table(spark, sf, "events").withColumnRenamed("user_id", "track_id")
    last = e.groupBy("track_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event"))
    first = e.groupBy("track_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first_event"))
    return last.join(first, "track_id")


Q_LAST_SELECTION = "SELECT user_id AS track_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event, any_value(first_event) AS first_event FROM events JOIN (SELECT user_id AS u, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY user_id) ON u = user_id GROUP BY user_id, event_type"


def q_beat_confidence(spark, sf):
    """Order statistics of every track's beat gaps."""
    from ..operators import blocks

    beats = blocks.led(a.beats(spark, sf), KEY, ["t", "idx"], {"after": "t"})
    gaps = beats.where("after IS NOT NULL").select("track_id", (F.col("after") - F.col("t")).alias("gap"))
    n = F.col("n")
    return stats.order_statistics(gaps, KEY, "gap", {"upper_median": F.floor(n / 2), "p10": F.floor(n / 10)})


Q_BEAT_CONFIDENCE = (
    a.ctes("beats")
    + ", g AS (SELECT track_id, lead(t) OVER (PARTITION BY track_id ORDER BY t, idx) - t AS gap FROM beats) SELECT track_id, count(gap) AS n, list_sort(list(gap))[count(gap) // 2 + 1] AS upper_median, list_sort(list(gap))[count(gap) // 10 + 1] AS p10 FROM g WHERE gap IS NOT NULL GROUP BY track_id"
)


def q_profile_tags(spark, sf):
    """Customers' extensions as one tag directive."""
    c = a.table(spark, sf, "customer")
    ext = F.create_map(F.lit("sbp_section"), F.col("c_mktsegment"), F.lit("sbp_difficulty"), F.when(F.col("c_acctbal") > 0, "easy").otherwise("hard"), F.lit("other"), F.lit("x"))
    return c.select("c_custkey", render.tags(ext).alias("tags"))


Q_PROFILE_TAGS = "SELECT c_custkey, '{x_sbp_tags: section=' || c_mktsegment || ' difficulty=' || CASE WHEN c_acctbal > 0 THEN 'easy' ELSE 'hard' END || '}' AS tags FROM customer"


def q_lexicon_stress(spark, sf):
    """Stress by a pronunciation with marks, made of a part's name."""
    phones = F.transform(F.filter(F.split("p_name", ""), lambda c: c.rlike("[a-z]")), lambda c, i: F.when(c.rlike("[aeiou]"), F.concat(F.upper(c), F.when(i % 3 == 1, "1").otherwise("0"))).otherwise(F.upper(c)))
    return a.table(spark, sf, "part").select("p_partkey", text.lexicon_stress(phones).alias("stressed"))


Q_LEXICON_STRESS = """
WITH l AS (SELECT p_partkey, list_filter(string_split(p_name, ''), lambda c: regexp_matches(c, '[a-z]')) AS cs FROM part),
c AS (SELECT p_partkey, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM l),
v AS (SELECT p_partkey, i % 3 = 1 AS primary_mark, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS ordinal FROM c WHERE regexp_matches(c, '[aeiou]'))
SELECT p_partkey, CAST(coalesce(max(ordinal) FILTER (primary_mark), 0) AS INT) AS stressed FROM part LEFT JOIN v USING (p_partkey) GROUP BY p_partkey"""


def q_profile_headers(spark, sf):
    """Customers' headers under all profiles, and a section as every profile routes it."""
    c = a.table(spark, sf, "customer")
    ext = F.create_map(F.lit("ccli"), F.col("c_custkey").cast("string"), F.lit("sbp_section"), F.col("c_mktsegment"), F.lit("mood"), F.lit("x"))
    capo = F.col("c_custkey") % 3
    header = lambda name: render.profiled_header(name, F.col("c_name"), F.lit(""), F.lit("C"), F.col("c_nationkey") + 60, F.lit("4/4"), capo, ext)
    grid = F.when(F.col("c_custkey") % 2 == 0, F.lit("| C . . . |"))
    body = lambda name: render.routed(name, F.lit("verse"), F.lit("Verse 1"), F.lit("[C]la"), grid)
    rows = F.array(*[F.struct(F.lit(n).alias("profile"), header(n).alias("header"), body(n).alias("body")) for n in sorted(render.PROFILES)])
    return c.select("c_custkey", F.inline(rows))


Q_PROFILE_HEADERS = """
WITH p AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, profile FROM customer, (VALUES ('inline_slash'), ('chordpro_ref'), ('onsong'), ('propresenter'), ('songbookpro')) v(profile))
SELECT c_custkey, profile,
  concat_ws(chr(10), '{title: ' || c_name || '}', '{key: C}', '{tempo: ' || (c_nationkey + 60) || '}', '{time: 4/4}',
    CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN profile = 'onsong' THEN '{x_capo: ' ELSE '{capo: ' END || (c_custkey % 3) || '}' END,
    CASE WHEN profile = 'propresenter' THEN '{ccli: ' ELSE '{meta: ccli ' END || c_custkey || '}',
    CASE WHEN profile <> 'songbookpro' THEN '{meta: sbp_section ' || c_mktsegment || '}' END, '{meta: mood x}',
    CASE WHEN profile = 'songbookpro' THEN '{x_sbp_tags: section=' || c_mktsegment || '}' END) || chr(10) AS header,
  CASE WHEN profile = 'chordpro_ref' AND c_custkey % 2 = 0 THEN '{start_of_grid: Verse 1}' || chr(10) || '| C . . . |' || chr(10) || '{end_of_grid}'
    ELSE concat_ws(chr(10), '{start_of_verse: Verse 1}', '[C]la', CASE WHEN c_custkey % 2 = 0 THEN '| C . . . |' END, '{end_of_verse}') END AS body FROM p"""


def _lined_words(spark, sf):
    """Words in document order, eight to a line."""
    words = blocks.numbered(a.words(spark, sf), a.TRACK, ["t0", "idx"], "n")
    return words.select("track_id", "idx", "t0", "t1", "n", F.floor((F.col("n") - 1) / 8).alias("line"), F.concat(F.lit("w"), (F.col("idx") % 100).cast("string")).alias("text"))


def _drained(spark, sf):
    beats = a.beats(spark, sf).withColumn("mark", F.concat(F.lit("|"), (F.col("idx") % 4 + 1).cast("string")))
    return drain.drain(beats, drain.slots(_lined_words(spark, sf), a.TRACK, "line", 4 * 3_600_000_000), a.TRACK, "line", a.block_width(spark, sf))


def q_orphan_drain(spark, sf):
    return _drained(spark, sf).select("track_id", "idx", "slot", "line", "at_word")


_DRAIN = """
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t0, idx) AS n FROM words),
lined AS (SELECT track_id, idx, t0, t1, n, (n - 1) // 8 AS line FROM n),
slots AS (SELECT track_id, line, 2 * n AS slot, idx AS at_word, coalesce(lead(t0) OVER w, t1 + 14400000000) AS until FROM lined WINDOW w AS (PARTITION BY track_id, line ORDER BY n)
  UNION ALL SELECT track_id, line, 2 * min(n) - 1, NULL, arg_min(t0, n) FROM lined GROUP BY track_id, line),
drained AS (SELECT b.track_id, b.idx, b.t, (SELECT min(s.slot) FROM slots s WHERE s.track_id = b.track_id AND s.until > b.t) AS slot FROM beats b)"""
Q_ORPHAN_DRAIN = a.ctes("beats", "words") + "," + _DRAIN + " SELECT d.track_id, d.idx, d.slot, s.line, s.at_word FROM drained d LEFT JOIN slots s ON s.track_id = d.track_id AND s.slot = d.slot"


def q_beat_document(spark, sf):
    """Words eight to a line with the beats drained between them."""
    return drain.rendered(_lined_words(spark, sf), _drained(spark, sf), a.TRACK, "line", "mark")


Q_BEAT_DOCUMENT = (
    a.ctes("beats", "words")
    + ","
    + _DRAIN
    + """,
marks AS (SELECT track_id, slot, string_agg('|' || (idx % 4 + 1), ' ' ORDER BY t, '|' || (idx % 4 + 1)) AS m FROM drained GROUP BY track_id, slot),
pieces AS (SELECT l.track_id, l.line, l.n, 'w' || (l.idx % 100) || coalesce(' ' || m.m, '') AS p FROM lined l LEFT JOIN marks m ON m.track_id = l.track_id AND m.slot = 2 * l.n),
gaps AS (SELECT l.track_id, l.line, m.m FROM lined l JOIN marks m ON m.track_id = l.track_id AND m.slot = 2 * l.n - 1),
lines AS (SELECT p.track_id, p.line, coalesce(g.m || chr(10), '') || string_agg(p.p, ' ' ORDER BY p.n) AS x FROM pieces p LEFT JOIN gaps g ON g.track_id = p.track_id AND g.line = p.line GROUP BY p.track_id, p.line, g.m),
bodies AS (SELECT track_id, string_agg(x, chr(10) ORDER BY line) AS x FROM lines GROUP BY track_id),
rest AS (SELECT track_id, '{c: trailing beats (after last section)}' || chr(10) || m AS x FROM marks WHERE slot IS NULL)
SELECT track_id, concat_ws(chr(10), b.x, r.x) AS body FROM bodies b FULL JOIN rest r USING (track_id)"""
)


def q_part_spans(spark, sf):
    """Parts' names with hyphens for blanks, their parts' share of a second a letter."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    p = a.table(spark, sf, "part").select("p_partkey", name.alias("word"), (F.length("p_name") * 1_000_000).alias("t1"))
    return p.select("p_partkey", F.posexplode(text.part_spans(F.col("word"), F.lit(0), F.col("t1"))).alias("i", "x")).select("p_partkey", "i", "x.*")


Q_PART_SPANS = """
WITH w AS (SELECT p_partkey, length(p_name) * 1000000 AS t1, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS ps FROM part),
e AS (SELECT p_partkey, t1, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS i FROM w),
s AS (SELECT *, sum(length(part)) OVER o AS upto, sum(length(part)) OVER (PARTITION BY p_partkey) AS total, count(*) OVER (PARTITION BY p_partkey) AS k FROM e WINDOW o AS (PARTITION BY p_partkey ORDER BY i))
SELECT p_partkey, CAST(i AS INT) AS i, part, CAST(t1 * (upto - length(part)) // total AS BIGINT) AS t0, CAST(CASE WHEN i + 1 >= k THEN t1 ELSE t1 * upto // total END AS BIGINT) AS t1 FROM s"""


def q_language_stress(spark, sf):
    """Stress of customers' segments by language, and by a lexicon of three words where it has them."""
    c = a.table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("word"), F.element_at(F.array(F.lit("pt"), F.lit("en"), F.lit("xx")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("lang"))
    lexicon = spark.createDataFrame([("building", ["buil", "ding"], 0), ("machinery", ["ma", "chi", "ne", "ry"], 1), ("household", ["house", "hold"], 0)], "word string, parts array<string>, stressed int")
    known = text.pronounced(c, lexicon)
    return known.select("c_custkey", F.array_join("parts", "|").alias("syllables"), text.stress_by_language(F.col("lang"), F.col("word"), F.col("parts")).alias("by_rule"), "stressed", "in_lexicon")


#: What the rules say of the five segments: parts by lexicon or spelling, stress by Portuguese rules over these, stress with the lexicon, whether it is there (fixed values).
_SEGMENTS = (
    ("automobile", "au|to|mo|bi|le", 3, 3, False),
    ("building", "buil|ding", 0, 0, True),
    ("furniture", "fur|ni|tu|re", 2, 2, False),
    ("household", "house|hold", 0, 0, True),
    ("machinery", "ma|chi|ne|ry", 2, 1, True),
)
Q_LANGUAGE_STRESS = (
    "SELECT c_custkey, syllables, CASE WHEN c_custkey % 3 = 0 THEN pt ELSE 0 END AS by_rule, stressed, in_lexicon FROM customer JOIN (VALUES "
    + ", ".join(f"('{w}', '{p}', {pt}, {s}, {str(k).lower()})" for w, p, pt, s, k in _SEGMENTS)
    + ") v(word, syllables, pt, stressed, in_lexicon) ON lower(c_mktsegment) = word"
)


def q_failure_messages(spark, sf):
    """Messages of failed documents with their context (F24), and a confidence of two decimals by its exact value."""
    d = a.table(spark, sf, "documents").join(a.table(spark, sf, "labels"), "doc_id").where("quality = 0")
    message = text.failure_message(F.lit("low quality"), F.lit("quality"), F.when(F.col("toxic") == 1, "en"), F.concat(F.lit("document-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), F.when(F.col("doc_id") % 2 == 0, "ValueError: no"))
    return d.select("doc_id", message.alias("message"), text.two_decimals((F.col("doc_id") % 1000) / 1000).alias("confidence"))


Q_FAILURE_MESSAGES = """
WITH d AS (SELECT doc_id, toxic, doc_id % 1000 AS k, CAST(CAST((doc_id % 1000) / 1000.0::DOUBLE AS DOUBLE) * pow(2::DOUBLE, 63) AS HUGEINT) * 1000 - CAST(doc_id % 1000 AS HUGEINT) * CAST(pow(2::DOUBLE, 63) AS HUGEINT) AS off_by FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
r AS (SELECT *, k // 10 + CASE WHEN k % 10 > 5 OR (k % 10 = 5 AND (off_by > 0 OR (off_by = 0 AND (k // 10) % 2 = 1))) THEN 1 ELSE 0 END AS cents FROM d)
SELECT doc_id, concat_ws(' | ', 'low quality', 'stage=quality', CASE WHEN toxic = 1 THEN 'engine=en' END, 'audio_id=' || substr('document-' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), 1, 12),
  CASE WHEN doc_id % 2 = 0 THEN 'caused_by=ValueError: no' END) AS message, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS confidence FROM r"""


def _weekly(table):
    """Sum of seven neighbours."""
    padded = np.pad(table, ((0, 0), (3, 3)))
    return sum(padded[:, k : k + table.shape[1]] for k in range(7))


def q_halo_windows(spark, sf):
    """Items shipped in the week around every day, by windows of 30 days with three days of context, stitched."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    daily = a.table(spark, sf, "lineitem").groupBy("l_returnflag", day.alias("i")).agg(F.count("*").alias("x"))
    return halo.stitched(daily, ["l_returnflag"], _weekly, 30, 3).select("l_returnflag", "frame", F.col("value").cast("long").alias("items"))


Q_HALO_WINDOWS = """
WITH daily AS (SELECT l_returnflag, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS i, count(*) AS x FROM lineitem GROUP BY ALL),
days AS (SELECT l_returnflag, unnest(range(0, max(i) + 1)) AS i FROM daily GROUP BY l_returnflag)
SELECT l_returnflag, i AS frame, CAST(coalesce(sum(x) OVER (PARTITION BY l_returnflag ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) AS BIGINT) AS items FROM days LEFT JOIN daily USING (l_returnflag, i)"""


def order_documents(spark, sf):
    """Orders as nested documents: a section per return flag, a line per item with its chord, a beat grid of the items' days in order of number; many break rules."""
    items = a.table(spark, sf, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1995-01-01")))
    chord = F.struct((F.col("day") - 100).alias("t0"), F.col("day").alias("t1"), (F.col("l_tax") * 13).alias("confidence"), F.concat(F.lit("C/ "), "l_linestatus").alias("symbol"), F.when(F.col("l_linenumber") > 1, F.lit("F")).alias("bass_note"))
    sung = F.col("l_linenumber") % 2 == 0
    line = F.struct("l_linenumber", F.when(sung, "lyric").otherwise("instrumental").alias("line_type"), (F.col("l_quantity") - 5).cast("int").alias("measures"), F.when(F.col("l_suppkey") % 5 == 0, "beat").when(F.col("l_suppkey") % 5 == 1, "bar").alias("pattern_hint"), F.array(chord).alias("chords"))
    sections = items.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("day").alias("t1"), F.max("l_linenumber").alias("most"), F.collect_list(F.struct("l_linenumber", "day")).alias("days"))
    section = F.struct(F.when(F.col("l_returnflag") == "N", "verse").when(F.col("l_returnflag") == "A", "chorus").otherwise("refrain").alias("kind"), F.when(F.col("most") < 7, F.col("l_returnflag")).alias("label"), F.lit(1000).alias("t0"), "t1", "lines")
    days = F.transform(F.array_sort(F.flatten(F.collect_list("days"))), lambda d: d["day"])
    songs = sections.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(section).alias("sections"), days.alias("beats"))
    k = F.col("o_orderkey")
    meta = F.struct(F.when(k % 11 > 0, F.col("o_orderstatus")).alias("title"), F.when(k % 3 > 0, k % 330).alias("tempo"), (k % 14).alias("capo"))
    grid = F.struct((F.col("o_totalprice") - 50_000).alias("bpm"), "beats", F.struct((k % 6).alias("count"), (k % 10).alias("unit")).alias("meter"))
    orders = a.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return orders.join(songs, "o_orderkey", "left").select("o_orderkey", meta.alias("metadata"), F.when(F.col("beats").isNotNull(), grid).alias("beat_grid"), "sections")


def q_document_rules(spark, sf):
    """How often every nested document breaks each rule (V5)."""
    return nested.violations(order_documents(spark, sf), ["o_orderkey"])


Q_DOCUMENT_RULES = """
WITH i AS (SELECT *, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS day FROM lineitem),
s AS (SELECT l_orderkey AS k, l_returnflag, max(day) AS t1, max(l_linenumber) AS most FROM i GROUP BY ALL),
d AS (SELECT l_orderkey AS k, day <= lag(day) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, day) AS back FROM i),
g AS (SELECT o_orderkey AS k, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
broken AS (
  SELECT o_orderkey AS k, 'title' AS rule FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'tempo' FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 330 NOT BETWEEN 20 AND 300
  UNION ALL SELECT o_orderkey, 'capo' FROM orders WHERE o_orderkey % 14 > 12
  UNION ALL SELECT k, 'bpm' FROM g WHERE o_totalprice <= 50000
  UNION ALL SELECT DISTINCT k, 'beats_increasing' FROM d WHERE back AND k IN (SELECT k FROM g)
  UNION ALL SELECT k, 'meter' FROM g WHERE k % 6 = 0 OR k % 10 NOT IN (2, 4, 8)
  UNION ALL SELECT k, 'section_kind' FROM s WHERE l_returnflag NOT IN ('N', 'A')
  UNION ALL SELECT k, 'section_label' FROM s WHERE most >= 7
  UNION ALL SELECT k, 'section_span' FROM s WHERE t1 < 1000
  UNION ALL SELECT l_orderkey, 'line_measures' FROM i WHERE l_linenumber % 2 = 1 AND CAST(trunc(l_quantity - 5) AS INT) <= 0
  UNION ALL SELECT l_orderkey, 'line_hint' FROM i WHERE l_suppkey % 5 = 1
  UNION ALL SELECT l_orderkey, 'sections_lines_chords_span' FROM i WHERE day < 100
  UNION ALL SELECT l_orderkey, 'sections_lines_chords_confidence' FROM i WHERE l_tax * 13 > 1
  UNION ALL SELECT l_orderkey, 'sections_lines_chords_bass' FROM i WHERE l_linenumber > 1 AND l_linestatus <> 'F')
SELECT k AS o_orderkey, rule, count(*) AS n FROM broken WHERE k IN (SELECT o_orderkey FROM orders) GROUP BY ALL"""


def q_phoneme_syllables(spark, sf):
    """Documents' words with their letters as phonemes of 100 ms, every third one with a stress mark; words of seven letters have none."""
    words = a.distinct_words(spark, sf).select("word", F.lit(0).alias("idx"), F.col("word").alias("text"), F.lit(0).cast("long").alias("t0"), (F.length("word") * 50_000).cast("long").alias("t1"))
    letters = words.where(F.length("word") != 7).select(F.col("word").alias("w"), F.posexplode(F.regexp_extract_all("word", F.lit("(?s)(.)"), F.lit(1))).alias("n", "c"))
    sounds = letters.select(F.col("w").alias("key"), F.lit(0).alias("word"), "n", F.when(F.col("n") % 3 == 2, F.concat(F.lit("ˈ"), "c")).otherwise(F.col("c")).alias("symbol"), (F.col("n") * 100_000).cast("long").alias("t0"), ((F.col("n") + 1) * 100_000).cast("long").alias("t1"))
    found = phonemes.syllables(words.withColumnRenamed("word", "key"), sounds, ["key"])
    return found.select(F.col("key").alias("word"), "i", "text", "t0", "t1", "stressed", "first", "last")


Q_PHONEME_SYLLABLES = f"""
WITH words AS (SELECT DISTINCT unnest({a.WORDS_SQL}) AS word FROM documents),
l AS (SELECT word, unnest(regexp_extract_all(word, '(?s).')) AS c, generate_subscripts(regexp_extract_all(word, '(?s).'), 1) - 1 AS n FROM words WHERE length(word) <> 7),
v AS (SELECT word, n, CASE WHEN n % 3 = 2 THEN 'ˈ' ELSE '' END || c AS symbol, c = '1' OR n % 3 = 2 AND c NOT IN ('0', '2') AS strong, NOT regexp_full_match(c, '[A-Z]') AND regexp_full_match(c, '[{text.VOWELS}ɪɛæɑɒʌɔʊøœɶɨʉɯəɚɜɝɐẽĩũ]') AS vowel FROM l),
c AS (SELECT *, coalesce(sum(CAST(vowel AS INT)) OVER (PARTITION BY word ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(CAST(vowel AS INT)) OVER (PARTITION BY word) AS vowels FROM v),
s AS (SELECT word, least(before, greatest(0, vowels - 1)) AS i, string_agg(symbol, '' ORDER BY n) AS symbols, min(n) AS a, max(n) AS b, bool_or(strong) AS strong, min(vowels) AS vowels FROM c GROUP BY ALL)
SELECT word, CAST(coalesce(i, 0) AS INT) AS i, CASE WHEN vowels > 0 THEN symbols ELSE word END AS text, CAST(CASE WHEN a IS NULL THEN 0 ELSE a * 100000 END AS BIGINT) AS t0,
  CAST(CASE WHEN a IS NULL THEN length(word) * 50000 ELSE (b + 1) * 100000 END AS BIGINT) AS t1, coalesce(vowels > 0 AND strong, false) AS stressed, CAST(a AS INT) AS first, CAST(b AS INT) AS last
FROM words LEFT JOIN s USING (word)"""


def q_report_lines(spark, sf):
    """The divergence report of all tracks: those without an estimate fail; 7 were skipped (K4)."""
    scores = timed._scores(spark, sf)
    sizes = a.onsets(spark, sf).groupBy("track_id").agg(F.count("*").alias("n_ref"))
    reason = F.when(F.col("score").isNull(), "no estimate")
    marked = scores.join(sizes, "track_id").select(F.col("track_id").alias("id"), F.concat(F.lit("Track "), F.col("track_id").cast("string")).alias("title"), "score", "n_ref", (F.col("n_ref") % 5).alias("n_est"), reason.alias("reason"))
    return render.report_lines(marked, "2024-01-01", 7)


Q_REPORT_LINES = "WITH " + timed._WCSR + f""",
sizes AS (SELECT track_id, count(*) AS n FROM ref GROUP BY track_id),
good AS (SELECT *, row_number() OVER (ORDER BY score, track_id) AS rank FROM scores JOIN sizes USING (track_id) WHERE score IS NOT NULL),
c AS (SELECT count(*) AS attempted, count(*) FILTER (score IS NULL) AS failed, coalesce(avg(score), 0.0) AS mean FROM scores)
SELECT 0 AS part, unnest(range(10))::INT AS at, unnest(['# Top 20 divergences — 2024-01-01', '', '- Total attempted: **' || attempted || '**', '- Successful metrics: **' || (attempted - failed) || '**', '- Failures: **' || failed || '**',
  '- Skipped from corpus (empty URL / non-YouTube): **7**', '- Mean WCSR-majmin: **' || printf('%.3f', mean) || '**', '', '| Rank | Severity | WCSR | Title | YouTube | Chords ref / est |', '|-----:|----------|-----:|-------|---------|------------------|']) AS line FROM c
UNION ALL SELECT 1, rank::INT, '| ' || rank || ' | **' || {timed._SEVERITY} || '** | ' || printf('%.3f', score) || ' | Track ' || track_id || ' | `' || track_id || '` | ' || n || ' / ' || (n % 5) || ' |' FROM good WHERE rank <= 20
UNION ALL SELECT 2, i::INT, CASE i WHEN 1 THEN '## Failures (no metric computed)' ELSE '' END FROM c, range(3) r(i) WHERE failed > 0
UNION ALL SELECT 3, 0, '- **Track ' || track_id || '** (`' || track_id || '`) — no estimate' FROM scores WHERE score IS NULL"""
