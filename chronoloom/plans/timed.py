"""Catalogue queries over the events table, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols
from ..operators import blocks, cascade, intervals, nearest, sequences, sessions, stats, validate
from ..sources import adapters as a

HOUR = 3_600_000_000
KEY = a.TRACK
RULES = {"section_gap": (8.0, 12 * HOUR), "line_gap": (2.5, 3 * HOUR)}


def _sessions(spark, sf):
    block = a.block_width(spark, sf)
    marked = sessions.thresholded(a.words(spark, sf), KEY, RULES, block)
    return sessions.gap_sessions(marked, KEY, F.col("section_gap"), block=block)


def q_gap_blocks(spark, sf):
    return sessions.summarised(_sessions(spark, sf), KEY, ["block"])


_GAPS = """
gaps AS (SELECT track_id, t0, t1, idx, stressed, t0 - lag(t1) OVER w AS gap FROM words WINDOW w AS (PARTITION BY track_id ORDER BY t0, idx)),
thr AS (SELECT track_id, greatest(43200000000.0, coalesce(8.0 * median(gap) FILTER (gap > 0), 43200000000.0)) AS section_gap,
        greatest(10800000000.0, coalesce(2.5 * median(gap) FILTER (gap > 0), 10800000000.0)) AS line_gap FROM gaps GROUP BY track_id),
blocked AS (SELECT *, CAST(sum(CASE WHEN gap > section_gap THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t0, idx) AS BIGINT) AS block
            FROM gaps JOIN thr USING (track_id)),
sessions AS (SELECT track_id, block, min(t0) AS t0, arg_max(t1, (t0, idx)) AS t1, count(*) AS n_words FROM blocked GROUP BY track_id, block)"""
Q_GAP_BLOCKS = a.ctes("words") + "," + _GAPS + " SELECT * FROM sessions"


def q_gap_lines(spark, sf):
    marked = _sessions(spark, sf).withColumnsRenamed({"t0": "t0", "t1": "t1"})
    lines = sessions.gap_sessions(marked, [*KEY, "block"], F.col("line_gap"), "line")
    return sessions.summarised(lines, KEY, ["block", "line"])


Q_GAP_LINES = (
    a.ctes("words")
    + ","
    + _GAPS
    + """,
inner_gaps AS (SELECT *, t0 - lag(t1) OVER (PARTITION BY track_id, block ORDER BY t0, idx) AS inner_gap FROM blocked),
lined AS (SELECT *, CAST(sum(CASE WHEN inner_gap > line_gap THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, block ORDER BY t0, idx) AS BIGINT) AS line FROM inner_gaps)
SELECT track_id, block, line, min(t0) AS t0, arg_max(t1, (t0, idx)) AS t1, count(*) AS n_words FROM lined GROUP BY track_id, block, line"""
)


def q_sections(spark, sf):
    found = sessions.summarised(_sessions(spark, sf), KEY, ["block"], F.max("section_gap").alias("threshold"))
    return sessions.sections(found, a.durations(spark, sf), KEY)


Q_SECTIONS = (
    a.ctes("words")
    + ","
    + _GAPS
    + """,
tracks AS (SELECT user_id AS track_id, max(epoch_us(ts)) + 86400000000 AS duration FROM events GROUP BY user_id),
timed AS (SELECT tracks.track_id, duration, coalesce(section_gap, 43200000000.0) AS threshold FROM tracks LEFT JOIN thr USING (track_id)),
placed AS (SELECT s.*, duration, threshold, lag(s.t1) OVER w AS last_end, row_number() OVER w - 1 AS n FROM sessions s JOIN timed USING (track_id)
           WINDOW w AS (PARTITION BY track_id ORDER BY block)),
verse AS (SELECT track_id, CASE WHEN n % 2 = 1 THEN 'chorus' ELSE 'verse' END AS kind, n // 2 + 1 AS nth, t0, t1 FROM placed),
rest AS (SELECT track_id, 'instrumental' AS kind, row_number() OVER (PARTITION BY track_id ORDER BY block) AS nth, last_end AS t0, t0 AS t1 FROM placed WHERE n > 0 AND t0 - last_end > threshold),
ends AS (SELECT track_id, duration, threshold, min(t0) AS first_start, arg_max(t1, block) AS last_stop FROM placed GROUP BY ALL),
every AS (
  SELECT * FROM verse UNION ALL SELECT * FROM rest
  UNION ALL SELECT track_id, 'intro', 1, 0, first_start FROM ends WHERE first_start > threshold
  UNION ALL SELECT track_id, 'outro', 1, last_stop, duration FROM ends WHERE duration - last_stop > threshold
  UNION ALL SELECT track_id, 'instrumental', 1, 0, duration FROM timed WHERE duration > 0 AND track_id NOT IN (SELECT track_id FROM sessions))
SELECT track_id, kind,
       CASE WHEN kind = 'verse' OR nth > 1 THEN upper(kind[1]) || kind[2:] || ' ' || nth ELSE upper(kind[1]) || kind[2:] END AS label,
       t0, t1, row_number() OVER (PARTITION BY track_id ORDER BY t0, t1, kind) AS seq
FROM every"""
)


def q_onset_intervals(spark, sf):
    onsets = a.onsets(spark, sf).join(a.durations(spark, sf), KEY)
    return intervals.onset_intervals(onsets, KEY, "label", F.col("duration"), block=a.block_width(spark, sf)).select("track_id", "idx", "label", "t0", "t1")


_CHORDS = """
tracks AS (SELECT user_id AS track_id, max(epoch_us(ts)) + 86400000000 AS duration FROM events GROUP BY user_id),
raw AS (SELECT track_id, idx, pc, label, t AS t0, greatest(t, coalesce(lead(t) OVER (PARTITION BY track_id ORDER BY t, idx), duration)) AS t1 FROM onsets JOIN tracks USING (track_id)),
chords AS (SELECT * FROM raw WHERE label <> 'N' AND label <> '' AND t1 > t0)"""
Q_ONSET_INTERVALS = a.ctes("onsets") + "," + _CHORDS + " SELECT track_id, idx, label, t0, t1 FROM chords"


def q_snap(spark, sf):
    return nearest.snap(a.onsets(spark, sf).select("track_id", "idx", "t"), a.beats(spark, sf), KEY, "t", 2 * HOUR, 4 * HOUR, a.block_width(spark, sf))


def _nearest_sql(points: str, grid: str, name: str) -> str:
    """Nearest element of grid for every point by carried values; ties to the earlier one."""
    return f"""
{name}_u AS (SELECT track_id, t, idx, 1 AS side, NULL::BIGINT AS g, NULL::BIGINT AS gi FROM {points}
      UNION ALL SELECT track_id, t, NULL, 0, t, min(idx) FROM {grid} GROUP BY track_id, t),
{name}_c AS (SELECT *, last_value(g IGNORE NULLS) OVER b AS p, last_value(gi IGNORE NULLS) OVER b AS pi,
             first_value(g IGNORE NULLS) OVER f AS q, first_value(gi IGNORE NULLS) OVER f AS qi FROM {name}_u
      WINDOW b AS (PARTITION BY track_id ORDER BY t, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY track_id ORDER BY t, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT track_id, t, idx, CASE WHEN q IS NULL OR t - p <= q - t THEN p ELSE q END AS near, CASE WHEN q IS NULL OR t - p <= q - t THEN pi ELSE qi END AS near_idx
      FROM {name}_c WHERE side = 1)"""


_SNAP = f"""
halves AS (SELECT track_id, (t + n) // 2 AS t, idx FROM (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, idx) AS n FROM beats) WHERE n IS NOT NULL),
{_nearest_sql("onsets", "beats", "nb")},
{_nearest_sql("onsets", "halves", "nh")},
snapped AS (SELECT o.track_id, o.idx, o.t,
       CASE WHEN abs(o.t - nb.near) <= 7200000000 THEN 'beat' WHEN abs(o.t - nh.near) <= 14400000000 THEN '8th' ELSE 'unsnapped' END AS level,
       CASE WHEN abs(o.t - nb.near) <= 7200000000 THEN nb.near WHEN abs(o.t - nh.near) <= 14400000000 THEN nh.near ELSE o.t END AS snapped
FROM onsets o JOIN nb USING (track_id, idx) JOIN nh USING (track_id, idx))"""
Q_SNAP = a.ctes("onsets", "beats") + "," + _SNAP + " SELECT * FROM snapped"


def q_nearest_index(spark, sf):
    return nearest.nearest_index(a.downbeats(spark, sf), a.beats(spark, sf), KEY, a.block_width(spark, sf))


Q_NEAREST_INDEX = a.ctes("downbeats", "beats") + "," + _nearest_sql("downbeats", "beats", "n") + " SELECT DISTINCT track_id, near_idx AS idx FROM n WHERE near_idx IS NOT NULL"


def q_beat_midpoints(spark, sf):
    return nearest.midpoints(a.beats(spark, sf), KEY, a.block_width(spark, sf))


Q_BEAT_MIDPOINTS = a.ctes("beats") + " SELECT track_id, (t + n) // 2 AS t, idx FROM (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, idx) AS n FROM beats) WHERE n IS NOT NULL"


def q_tempo(spark, sf):
    return stats.tempo(a.beats(spark, sf), KEY, a.block_width(spark, sf))


_TEMPO = """
bg AS (SELECT track_id, t, lead(t) OVER (PARTITION BY track_id ORDER BY t, idx) - t AS gap FROM beats),
tempo AS (SELECT track_id, count(*) AS n_beats, coalesce(list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1], 1000000) AS period,
        CASE WHEN count(*) > 1 THEN (max(t) - min(t))::DOUBLE / (count(*) - 1) ELSE 1e6 END AS mean_gap FROM bg GROUP BY track_id)"""
Q_TEMPO = a.ctes("beats") + "," + _TEMPO + " SELECT track_id, n_beats, period, CASE WHEN period > 0 THEN 60e6 / period END AS bpm, mean_gap FROM tempo"


def _by_value(spark, sf):
    """Beats with their value's order as ordinal, so that times are not in order."""
    e = a.table(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") * 1000 + F.col("event_id") / 10_000_000).alias("idx"))


def q_monotonic_violations(spark, sf):
    return sequences.not_increasing(_by_value(spark, sf), KEY).select("track_id", "t", "previous")


Q_MONOTONIC_VIOLATIONS = """
WITH v AS (SELECT user_id AS track_id, epoch_us(ts) AS t, value * 1000 + event_id / 10000000 AS idx FROM events WHERE event_type = 'error')
SELECT track_id, t, previous FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY idx) AS previous FROM v) WHERE previous >= t"""


def _chord_intervals(spark, sf):
    return q_onset_intervals(spark, sf)


def q_point_in_interval(spark, sf):
    return intervals.first_interval_at(a.beats(spark, sf).withColumnRenamed("idx", "beat"), _chord_intervals(spark, sf), KEY, ["beat"])


Q_POINT_IN_INTERVAL = a.ctes("onsets", "beats") + "," + _CHORDS + " SELECT b.track_id, b.idx AS beat, min(c.idx) AS idx FROM beats b JOIN chords c ON b.track_id = c.track_id AND b.t BETWEEN c.t0 AND c.t1 GROUP BY b.track_id, b.idx"


def q_overlap(spark, sf):
    chords = _chord_intervals(spark, sf).select("track_id", F.col("idx").alias("chord"), "t0", "t1")
    lines = a.words(spark, sf).select("track_id", F.col("idx").alias("word"), F.col("t0").alias("u0"), F.col("t1").alias("u1"))
    return intervals.overlaps(chords, lines, KEY).select("track_id", "chord", "word")


Q_OVERLAP = a.ctes("onsets", "words") + "," + _CHORDS + " SELECT c.track_id, c.idx AS chord, w.idx AS word FROM chords c JOIN words w ON c.track_id = w.track_id AND c.t0 < w.t1 AND c.t1 > w.t0"


def q_partition_start(spark, sf):
    points = a.onsets(spark, sf).select("track_id", "t", F.col("idx").alias("chord"))
    ranges = q_sections(spark, sf).where("kind IN ('intro', 'instrumental', 'outro')").select("track_id", "seq", "t0", "t1")
    return intervals.starts_in(points, ranges, KEY).select("track_id", "chord", "seq")


Q_PARTITION_START = (
    a.ctes("onsets")
    + f", sections AS ({Q_SECTIONS}) SELECT o.track_id, o.idx AS chord, s.seq FROM onsets o JOIN sections s ON o.track_id = s.track_id AND o.t >= s.t0 AND o.t < s.t1 WHERE s.kind IN ('intro', 'instrumental', 'outro')"
)


def q_points_per_interval(spark, sf):
    return intervals.points_per_interval(_chord_intervals(spark, sf), a.beats(spark, sf), KEY, ["idx"])


Q_POINTS_PER_INTERVAL = a.ctes("onsets", "beats") + "," + _CHORDS + " SELECT c.track_id, c.idx, c.t0, c.t1, count(b.t) AS n FROM chords c LEFT JOIN beats b ON c.track_id = b.track_id AND b.t BETWEEN c.t0 AND c.t1 GROUP BY ALL"


def q_nearest_tolerance(spark, sf):
    starts = a.words(spark, sf).where("stressed").select("track_id", F.col("t0").alias("t"), "idx")
    found = nearest.nearest_within(a.onsets(spark, sf).select("track_id", "t", F.col("idx").alias("chord")), starts, KEY, ["chord"], 3 * HOUR, block=a.block_width(spark, sf))
    return found.select("track_id", "chord", "nearest.idx", "nearest.distance")


Q_NEAREST_TOLERANCE = (
    a.ctes("onsets", "words")
    + """ SELECT track_id, chord, idx, distance FROM (
  SELECT o.track_id, o.idx AS chord, w.idx, abs(o.t - w.t0) AS distance, row_number() OVER (PARTITION BY o.track_id, o.idx ORDER BY abs(o.t - w.t0), w.idx) AS r
  FROM onsets o JOIN words w ON o.track_id = w.track_id AND w.stressed AND abs(o.t - w.t0) < 10800000000) WHERE r = 1"""
)


def q_nearest_word(spark, sf):
    found = nearest.nearest(a.onsets(spark, sf).select("track_id", "t", F.col("idx").alias("chord")), {"word": a.words(spark, sf).select("track_id", F.col("t0").alias("t"), "idx")}, KEY, "t", a.block_width(spark, sf))
    return found.where(F.abs(F.col("t") - F.col("word.t")) < 24 * HOUR).select("track_id", "chord", F.col("word.idx").alias("word"))


_WORD_STARTS = "starts AS (SELECT track_id, t0 AS t, idx FROM words)"
Q_NEAREST_WORD = a.ctes("onsets", "words") + "," + _WORD_STARTS + "," + _nearest_sql("onsets", "starts", "n") + " SELECT track_id, idx AS chord, near_idx AS word FROM n WHERE abs(t - near) < 86400000000"


def q_cascade(spark, sf):
    words = a.words(spark, sf)
    return cascade.place(a.onsets(spark, sf), a.beats(spark, sf), words, words, KEY, HOUR, 3 * HOUR, 6 * HOUR, 24 * HOUR, 2 * HOUR, 4 * HOUR, a.block_width(spark, sf))


_CASCADE = f"""{_SNAP},
anchored AS (SELECT track_id, idx, snapped AS t FROM snapped),
{_WORD_STARTS},
{_nearest_sql("anchored", "starts", "nw")},
candidates AS (
  SELECT s.track_id, s.idx, 0 AS rank, 0 AS distance, min(w.idx) AS target FROM anchored s JOIN words w ON s.track_id = w.track_id AND w.t1 - w.t0 > 3600000000 AND s.t BETWEEN w.t0 AND w.t1 GROUP BY ALL
  UNION ALL SELECT s.track_id, s.idx, 1, abs(s.t - w.t0), w.idx FROM anchored s JOIN words w ON s.track_id = w.track_id AND w.stressed AND abs(s.t - w.t0) < 10800000000
  UNION ALL SELECT s.track_id, s.idx, 2, abs(s.t - w.t0), w.idx FROM anchored s JOIN words w ON s.track_id = w.track_id AND abs(s.t - w.t0) < 21600000000
  UNION ALL SELECT track_id, idx, 3, abs(t - near), near_idx FROM nw WHERE abs(t - near) < 86400000000),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, idx ORDER BY rank, distance, target) AS r FROM candidates) WHERE r = 1),
placed AS (SELECT s.track_id, s.idx, s.t AS anchor,
  CASE coalesce(rank, 4) WHEN 0 THEN 'melisma_start' WHEN 1 THEN 'stressed_syllable' WHEN 2 THEN 'any_syllable' WHEN 3 THEN 'before_word' ELSE 'orphan' END AS strategy, target, distance
  FROM anchored s LEFT JOIN best USING (track_id, idx))"""
Q_CASCADE = a.ctes("onsets", "beats", "words") + "," + _CASCADE + " SELECT * FROM placed"


def q_orphans(spark, sf):
    return q_cascade(spark, sf).where("strategy = 'orphan'").select("track_id", "idx", "anchor")


Q_ORPHANS = a.ctes("onsets", "beats", "words") + "," + _CASCADE + " SELECT track_id, idx, anchor FROM placed WHERE strategy = 'orphan'"


def _near_words(spark, sf):
    beats = a.beats(spark, sf)
    words = a.words(spark, sf).join(stats.tempo(beats, KEY).select("track_id", "mean_gap"), KEY)
    return nearest.nearest_interval(beats.withColumnRenamed("idx", "beat"), words, KEY, ["beat"], F.col("mean_gap"))


def q_nearest_interval(spark, sf):
    near = _near_words(spark, sf)
    slot = F.when(F.col("t") < F.col("nearest.t0"), "before").when(F.col("t") > F.col("nearest.t1"), "after").otherwise("inside")
    placed = near.select("track_id", "beat", "t", F.col("nearest.idx").alias("word"), F.col("nearest.distance").alias("distance"), slot.alias("slot"), (F.col("nearest.t1") - F.col("nearest.t0") > HOUR).alias("long"))
    cut = sequences.capped(placed, ["track_id", "word", "slot"], ["t", "beat"], F.when(F.col("long"), 1).otherwise(2))
    return cut.select("track_id", "beat", "word", "distance", F.when((F.col("slot") == "before") | ((F.col("slot") == "inside") & F.col("kept")), F.col("slot")).otherwise("orphan").alias("slot"))


Q_NEAREST_INTERVAL = (
    a.ctes("beats", "words")
    + ","
    + _TEMPO
    + """,
near AS (SELECT * FROM (SELECT b.track_id, b.idx AS beat, b.t, w.idx AS word, w.t0, w.t1, greatest(0, w.t0 - b.t, b.t - w.t1) AS distance,
    row_number() OVER (PARTITION BY b.track_id, b.idx ORDER BY greatest(0, w.t0 - b.t, b.t - w.t1), w.idx) AS r
  FROM beats b JOIN tempo USING (track_id) JOIN words w ON w.track_id = b.track_id AND greatest(0, w.t0 - b.t, b.t - w.t1) <= mean_gap) WHERE r = 1),
slots AS (SELECT *, CASE WHEN t < t0 THEN 'before' WHEN t > t1 THEN 'after' ELSE 'inside' END AS s, t1 - t0 > 3600000000 AS long FROM near),
caps AS (SELECT *, row_number() OVER (PARTITION BY track_id, word, s ORDER BY t, beat) <= CASE WHEN long THEN 1 ELSE 2 END AS kept FROM slots)
SELECT track_id, beat, word, distance, CASE WHEN s = 'before' OR (s = 'inside' AND kept) THEN s ELSE 'orphan' END AS slot FROM caps"""
)


def q_measure_position(spark, sf):
    return sequences.measure_positions(a.grid(spark, sf), KEY, F.col("downbeat"), a.block_width(spark, sf)).select("track_id", "idx", "measure", "position")


Q_MEASURE_POSITION = (
    a.ctes("grid")
    + """, m AS (SELECT *, CAST(sum(CASE WHEN downbeat THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t, idx) AS BIGINT) AS measure FROM grid)
SELECT track_id, idx, measure, row_number() OVER (PARTITION BY track_id, measure ORDER BY t, idx) AS position FROM m"""
)


def _frames(spark, sf):
    e = a.table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("idx"), "event_type")
    frames = blocks.numbered(e, KEY, ["t", "idx"], "frame")
    return frames.select("track_id", (F.col("frame") - 1).alias("frame"), F.when(F.col("event_type").isin("view", "click"), "word").otherwise(F.col("event_type")).alias("token"))


def q_rle(spark, sf):
    found = sequences.runs(_frames(spark, sf), KEY, "frame", "token", F.col("token") == "error")
    return found.select("track_id", "token", "first", "last", "n")


_RUNS = """
WITH f AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CASE WHEN event_type IN ('view', 'click') THEN 'word' ELSE event_type END AS token FROM events),
g AS (SELECT *, CASE WHEN token IS NOT DISTINCT FROM lag(token) OVER w AND frame > 0 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame) AS run FROM g)"""
Q_RLE = _RUNS + " SELECT track_id, token, min(frame) AS first, max(frame) AS last, count(*) AS n FROM r WHERE token <> 'error' GROUP BY track_id, run, token"


def q_word_spans(spark, sf):
    found = sequences.runs(_frames(spark, sf), KEY, "frame", "token", F.col("token") == "error")
    return sequences.spans_to_words(found, KEY, "token")


Q_WORD_SPANS = _RUNS + ", s AS (SELECT track_id, token, min(frame) AS first, max(frame) AS last FROM r WHERE token <> 'error' GROUP BY track_id, run, token) SELECT track_id, token, min(first) * 20000 AS t0, (max(last) + 1) * 20000 AS t1 FROM s GROUP BY track_id, token"


def q_positional_zip(spark, sf):
    left = a.onsets(spark, sf).select("track_id", F.col("t").alias("lt"), F.col("idx").alias("chord"))
    right = a.downbeats(spark, sf).select("track_id", F.col("t").alias("rt"), F.col("idx").alias("downbeat"))
    return sequences.positional_zip(left, right, KEY, ["lt", "chord"], ["rt", "downbeat"]).select("track_id", "position", "chord", "downbeat")


Q_POSITIONAL_ZIP = (
    a.ctes("onsets", "downbeats")
    + """, l AS (SELECT track_id, idx AS chord, row_number() OVER (PARTITION BY track_id ORDER BY t, idx) AS position FROM onsets),
r AS (SELECT track_id, idx AS downbeat, row_number() OVER (PARTITION BY track_id ORDER BY t, idx) AS position FROM downbeats)
SELECT track_id, position, chord, downbeat FROM l JOIN r USING (track_id, position)"""
)


def _numbered_onsets(spark, sf):
    found = blocks.numbered(a.onsets(spark, sf), KEY, ["t", "idx"], "n")
    return found.select("track_id", (F.col("n") - 1).alias("idx"), "label")


def q_pairs(spark, sf):
    return sequences.pairs(_numbered_onsets(spark, sf), KEY, "idx", "label")


Q_PAIRS = (
    a.ctes("onsets")
    + """, n AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, idx) - 1 AS i, label FROM onsets)
SELECT track_id, i // 2 AS pair, max(label) FILTER (i % 2 = 0) AS first, coalesce(max(label) FILTER (i % 2 = 1), max(label) FILTER (i % 2 = 0)) AS second FROM n GROUP BY track_id, i // 2"""
)


def q_context_windows(spark, sf):
    """Days of a track, from its first event to a day after the last, with two hours of context."""
    e = a.table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return sequences.context_windows(e.groupBy(*KEY).agg((F.max("t") - F.min("t") + a.DAY).alias("duration")), "duration", a.DAY, 2 * HOUR)


Q_CONTEXT_WINDOWS = """
WITH d AS (SELECT user_id AS track_id, max(epoch_us(ts)) - min(epoch_us(ts)) + 86400000000 AS duration FROM events GROUP BY user_id),
w AS (SELECT track_id, duration, unnest(range(0, greatest(0, CAST(ceil(duration / 86400000000) AS BIGINT) - 1) + 1)) AS win FROM d WHERE duration > 0)
SELECT track_id, duration, win AS window, win * 86400000000 AS t0, least(duration, (win + 1) * 86400000000) AS t1,
       greatest(0, win * 86400000000 - 7200000000) AS c0, least(duration, least(duration, (win + 1) * 86400000000) + 7200000000) AS c1 FROM w"""


def _triads(spark, sf, kind: str):
    """Purchases or signups as labelled intervals: three roots, four qualities of which one is neither major nor minor and one is silence."""
    e = a.table(spark, sf, "events").where(F.col("event_type") == kind)
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)
    label = F.when(k % 12 == 11, "N").otherwise(F.concat(pick(("C", "Db", "E"), k % 3), F.lit(":"), pick(("maj", "min", "min7", "dim"), F.floor(k / 3).cast("int") % 4)))
    points = e.select(F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("idx"), label.alias("label"))
    return intervals.onset_intervals(points, KEY, "label", None, None, HOUR, a.block_width(spark, sf)).select("track_id", "t0", "t1", "label")


def _scores(spark, sf):
    """Every reference track's score; null where it has no estimate."""
    reference, estimate = _triads(spark, sf, "purchase"), _triads(spark, sf, "signup")
    found = stats.chord_recall(reference, estimate, KEY, symbols.same_triad, block=a.block_width(spark, sf), every=True)
    return found.select("track_id", F.round("score", 9).alias("score"))


def q_wcsr(spark, sf):
    return _scores(spark, sf).select("track_id", F.coalesce("score", F.lit(0.0)).alias("score"))


_TRIAD = "CASE WHEN k % 12 = 11 THEN 'N' ELSE list_value('C', 'Db', 'E')[k % 3 + 1] || ':' || list_value('maj', 'min', 'min7', 'dim')[(k // 3) % 4 + 1] END"
_WCSR = f"""
e AS (SELECT user_id AS track_id, epoch_us(ts) AS t, event_id AS idx, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ref AS (SELECT track_id, t AS t0, coalesce(lead(t) OVER (PARTITION BY track_id ORDER BY t, idx), t + 3600000000) AS t1, {_TRIAD} AS label FROM e WHERE event_type = 'purchase'),
est AS (SELECT track_id, t AS t0, coalesce(lead(t) OVER (PARTITION BY track_id ORDER BY t, idx), t + 3600000000) AS t1, {_TRIAD} AS label FROM e WHERE event_type = 'signup'),
spans AS (SELECT track_id, min(t0) AS lo, max(t1) AS hi FROM ref GROUP BY track_id),
bounds AS (SELECT track_id, t0 AS t FROM ref UNION SELECT track_id, t1 FROM ref UNION SELECT track_id, t0 FROM est UNION SELECT track_id, t1 FROM est),
cut AS (SELECT b.track_id, b.t AS t0, lead(b.t) OVER (PARTITION BY b.track_id ORDER BY b.t) AS t1 FROM bounds b),
held AS (SELECT c.track_id, c.t0, c.t1, ref.label AS l, coalesce(est.label, 'N') AS r FROM cut c JOIN spans s ON s.track_id = c.track_id AND c.t0 >= s.lo AND c.t1 <= s.hi
  JOIN ref ON ref.track_id = c.track_id AND ref.t0 <= c.t0 AND c.t1 <= ref.t1 AND ref.t0 < ref.t1
  LEFT JOIN est ON est.track_id = c.track_id AND est.t0 <= c.t0 AND c.t1 <= est.t1 AND est.t0 < est.t1),
judged AS (SELECT *, CASE WHEN l = 'N' THEN r = 'N' ELSE r <> 'N' AND split_part(l, ':', 1) = split_part(r, ':', 1) AND left(split_part(l, ':', 2), 3) = left(split_part(r, ':', 2), 3) END AS hit FROM held WHERE l NOT LIKE '%dim'),
scored AS (SELECT track_id, coalesce(sum(CASE WHEN hit THEN t1 - t0 ELSE 0 END)::DOUBLE / nullif(sum(t1 - t0), 0), 0.0) AS score FROM judged GROUP BY track_id),
scores AS (SELECT track_id, CASE WHEN track_id IN (SELECT track_id FROM est) THEN round(coalesce(score, 0.0), 9) END AS score FROM spans LEFT JOIN scored USING (track_id)),
wcsr AS (SELECT track_id, coalesce(score, 0.0) AS score FROM scores)"""
Q_WCSR = "WITH " + _WCSR + " SELECT * FROM wcsr"


def q_severity_topk(spark, sf):
    return cascade.worst(q_wcsr(spark, sf), "score", "track_id", 20)


_SEVERITY = "CASE WHEN score < 0.5 THEN 'CRITICAL' WHEN score < 0.7 THEN 'HIGH' WHEN score < 0.85 THEN 'MEDIUM' WHEN score < 0.95 THEN 'LOW' ELSE 'NEGLIGIBLE' END"
Q_SEVERITY_TOPK = "WITH " + _WCSR + f" SELECT track_id, score, {_SEVERITY} AS severity FROM wcsr ORDER BY score, track_id LIMIT 20"


def q_report_rollup(spark, sf):
    marked = validate.with_reason(_scores(spark, sf), {"no_estimate": F.col("score").isNull(), "too_low": F.col("score") < 0.1})
    return validate.rollup(marked).select(F.round("mean_score", 6).alias("mean_score"), "attempted", "failed", "skipped")


Q_REPORT_ROLLUP = "WITH " + _WCSR + " SELECT round(coalesce(avg(score) FILTER (score >= 0.1), 0.0), 6) AS mean_score, count(*) AS attempted, count(*) FILTER (score IS NULL OR score < 0.1) AS failed, 0 AS skipped FROM scores"


def q_beat_agreement(spark, sf):
    return validate.beat_agreement(a.beats(spark, sf), a.downbeats(spark, sf), KEY, HOUR, block=a.block_width(spark, sf))


#: Islands of events no further apart than an hour; in each, every reference in turn takes the first free estimate within the hour.
Q_BEAT_AGREEMENT = (
    "WITH RECURSIVE "
    + a.ctes("beats", "downbeats")[5:]
    + """,
refs AS (SELECT track_id, list(t ORDER BY t) AS rs FROM beats GROUP BY track_id),
ests AS (SELECT track_id, list(t ORDER BY t) AS es FROM downbeats GROUP BY track_id),
tracks AS (SELECT track_id, coalesce(rs, []::BIGINT[]) AS rs, coalesce(es, []::BIGINT[]) AS es FROM refs FULL JOIN ests USING (track_id)),
walk AS (
  SELECT track_id, rs, es, 1 AS i, 1 AS j, 0 AS hits FROM tracks
  UNION ALL
  SELECT track_id, rs, es,
    CASE WHEN j <= len(es) AND es[j] < rs[i] - 3600000000 THEN i ELSE i + 1 END,
    CASE WHEN j <= len(es) AND es[j] <= rs[i] + 3600000000 THEN j + 1 ELSE j END,
    CASE WHEN j <= len(es) AND es[j] BETWEEN rs[i] - 3600000000 AND rs[i] + 3600000000 THEN hits + 1 ELSE hits END
  FROM walk WHERE i <= len(rs)),
done AS (SELECT track_id, CAST(max(hits) AS BIGINT) AS hits, CAST(any_value(len(rs)) AS BIGINT) AS n_ref, CAST(any_value(len(es)) AS BIGINT) AS n_est FROM walk GROUP BY track_id)
SELECT track_id, hits, n_ref, n_est, CASE WHEN hits > 0 THEN 2.0 * hits / (n_ref + n_est) ELSE 0.0 END::DOUBLE AS f_measure FROM done"""
)


def q_constraint_violations(spark, sf):
    words = a.words(spark, sf).withColumn("minutes", (F.col("t1") - F.col("t0")) / 60_000_000)
    checks = validate.rules("t0", "t1", None, {"minutes": (1.0, 95.0)})
    return validate.violations(words, ["track_id", "idx"], checks)


Q_CONSTRAINT_VIOLATIONS = (
    a.ctes("words")
    + """ SELECT track_id, idx, 'start_not_negative' AS rule FROM words WHERE NOT t0 >= 0
UNION ALL SELECT track_id, idx, 'end_not_before_start' FROM words WHERE NOT t1 >= t0
UNION ALL SELECT track_id, idx, 'minutes_in_range' FROM words WHERE NOT (t1 - t0) / 60000000 BETWEEN 1.0 AND 95.0"""
)


def q_equal_intervals(spark, sf):
    items = a.turns(spark, sf)
    return intervals.equal_intervals(items, ["conv_id"], ["turn"], F.lit(60.0)).select("conv_id", "turn", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


Q_EQUAL_INTERVALS = """
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, round(i * 60.0::DOUBLE / n, 6) AS t0, round((i + 1) * 60.0::DOUBLE / n, 6) AS t1 FROM n"""


def q_section_labels(spark, sf):
    numbered = a.numbered(a.turns(spark, sf), ["conv_id"], ["turn"], "n")
    kind = F.when(F.col("n") % 2 == 1, "chorus").otherwise("verse")
    return numbered.select("conv_id", "turn", sessions.section_label(kind, F.floor(F.col("n") / 2) + 1).alias("label"))


Q_SECTION_LABELS = """
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 2 = 0 THEN 'Verse ' || (n // 2 + 1) WHEN n // 2 > 0 THEN 'Chorus ' || (n // 2 + 1) ELSE 'Chorus' END AS label FROM n"""


def q_beat_continuity(spark, sf):
    from ..operators.continuity import continuity

    return continuity(a.beats(spark, sf), a.downbeats(spark, sf), KEY).select("track_id", F.round("amlt", 9).alias("amlt"))


#: Every estimate against every reference of its track at five metrical levels.
Q_BEAT_CONTINUITY = (
    a.ctes("beats", "downbeats")
    + """,
own AS (SELECT track_id, t, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS own FROM downbeats WINDOW w AS (PARTITION BY track_id ORDER BY t)),
b AS (SELECT track_id, t::DOUBLE AS t, row_number() OVER w AS n, lead(t) OVER w AS after FROM beats WINDOW w AS (PARTITION BY track_id ORDER BY t)),
between_ AS (SELECT track_id, (t + after) / 2 AS t FROM b WHERE after IS NOT NULL),
every AS (
  SELECT 0 AS level, track_id, t FROM b UNION ALL SELECT 1, track_id, t FROM between_
  UNION ALL SELECT 2, track_id, t FROM b UNION ALL SELECT 2, track_id, t FROM between_
  UNION ALL SELECT 3, track_id, t FROM b WHERE n % 2 = 1 UNION ALL SELECT 4, track_id, t FROM b WHERE n % 2 = 0),
levelled AS (SELECT level, track_id, t, row_number() OVER w AS n, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS step FROM every WINDOW w AS (PARTITION BY level, track_id ORDER BY t)),
near AS (SELECT l.level, o.track_id, o.t, o.own, l.n, l.step, abs(o.t - l.t) AS distance, row_number() OVER (PARTITION BY l.level, o.track_id, o.t ORDER BY abs(o.t - l.t), l.t) AS r
  FROM own o JOIN levelled l ON l.track_id = o.track_id),
hits AS (SELECT level, track_id, count(DISTINCT n) AS hits FROM near WHERE r = 1 AND step <> 0 AND distance < 0.175 * step AND abs(1 - own / step) < 0.175 GROUP BY level, track_id),
sizes AS (SELECT level, track_id, count(*) AS n FROM levelled GROUP BY level, track_id),
ests AS (SELECT track_id, count(*) AS n FROM downbeats GROUP BY track_id),
levels AS (SELECT v.level, track_id FROM (VALUES (0), (1), (2), (3), (4)) v(level), ests UNION SELECT level, track_id FROM sizes),
shares AS (SELECT l.track_id, coalesce(h.hits, 0)::DOUBLE / greatest(coalesce(s.n, 0), coalesce(e.n, 0)) AS share FROM levels l LEFT JOIN hits h ON h.level = l.level AND h.track_id = l.track_id
  LEFT JOIN sizes s ON s.level = l.level AND s.track_id = l.track_id LEFT JOIN ests e ON e.track_id = l.track_id)
SELECT track_id, round(max(share), 9) AS amlt FROM shares GROUP BY track_id"""
)
