"""Ordered rendering of documents as text (R1-R8, J15, T2). One row per line, section or document; order is by explicit ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import cascade, validate

#: Section kinds with start and end directives; the others get a comment (fixed values).
DIRECTIVES = ("verse", "chorus", "bridge")


def joined(pieces: Column, by: str = "") -> Column:
    """Texts of collected (order..., piece) structs in order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["piece"]), by)


def lyric_lines(lines: DataFrame, markers: DataFrame, key: list[str]) -> DataFrame:
    """Lines (key, text) with their markers (key, pos, idx, chord) spliced in at character positions; ties by ordinal."""
    listed = markers.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "idx", "chord"))).alias("__m"))
    rendered = lines.join(listed, key, "left").withColumn("__n", F.length("text"))
    # The markers are in order, so every piece of text runs from one to the next.
    place = lambda i: F.greatest(F.lit(0), F.least(F.get("__m", i)["pos"].cast("int"), F.col("__n")))
    start = lambda i: F.when(i > 0, place(i - 1)).otherwise(F.lit(0))
    pieces = F.transform("__m", lambda m, i: F.concat(F.substring(F.col("text"), start(i) + 1, place(i) - start(i)), m["chord"]))
    tail = F.substring(F.col("text"), place(F.size("__m") - 1) + 1, F.col("__n"))
    return rendered.withColumn("line", F.when(F.col("__m").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))).drop("__m", "__n")


def inline_bars(cells: DataFrame, key: list[str], pattern: str) -> DataFrame:
    """Instrumental line of chords (key, idx, symbol): full bars, half bars (two chords each) or beats."""
    if pattern == "half":
        even = F.col("idx") % 2 == 0
        bars = cells.groupBy(*key, F.floor(F.col("idx") / 2).alias("idx")).agg(F.max(F.when(even, F.col("symbol"))).alias("a"), F.max(F.when(~even, F.col("symbol"))).alias("b"))
        piece = F.concat(F.lit("["), "a", F.lit("]x/["), F.coalesce("b", "a"), F.lit("]/"))
    else:
        bars = cells
        piece = F.concat(F.lit("["), "symbol", F.lit("]x///" if pattern == "full" else "]/"))
    return bars.groupBy(*key).agg(joined(F.collect_list(F.struct("idx", piece.alias("piece"))), " " if pattern == "beat" else "   ").alias("line"))


def grid_bars(cells: DataFrame, key: list[str], pattern: str, beats: int = 4) -> DataFrame:
    """Grid line of chords for a meter: one chord a bar, two a bar, or one a beat."""
    if pattern == "full":
        bars, piece = cells, F.concat("symbol", F.lit(" ." * (beats - 1)))
    elif pattern == "half":
        even = F.col("idx") % 2 == 0
        bars = cells.groupBy(*key, F.floor(F.col("idx") / 2).alias("idx")).agg(F.max(F.when(even, F.col("symbol"))).alias("a"), F.max(F.when(~even, F.col("symbol"))).alias("b"))
        dots = " ." * (beats // 2 - 1)
        piece = F.concat("a", F.lit(dots + " "), F.coalesce("b", "a"), F.lit(dots + (" ." if beats % 2 else "")))
    else:
        bars = cells.groupBy(*key, F.floor(F.col("idx") / beats).alias("bar")).agg(joined(F.collect_list(F.struct("idx", F.col("symbol").alias("piece"))), " ").alias("piece")).withColumnRenamed("bar", "idx")
        piece = F.col("piece")
    line = joined(F.collect_list(F.struct("idx", piece.alias("piece"))), " | ")
    return bars.groupBy(*key).agg(F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def wrapped(kind: Column, label: Column, body: Column) -> Column:
    """A section's body between its directives, or after a comment."""
    start, end = F.concat(F.lit("{start_of_"), kind, F.lit(": "), label, F.lit("}")), F.concat(F.lit("{end_of_"), kind, F.lit("}"))
    return F.when(kind.isin(*DIRECTIVES), F.concat_ws("\n", start, body, end)).otherwise(F.concat_ws("\n", F.concat(F.lit("{c: "), label, F.lit("}")), body))


def header(title: Column, artist: Column, key: Column, tempo: Column, time: Column, capo: Column, metas: Column | None = None, capo_name: str = "capo") -> Column:
    """Directives in fixed order, then an empty line; empty ones and a capo of 0 are left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    line = lambda name, c: F.concat(F.lit(f"{{{name}: "), c, F.lit("}"))
    parts = [line("title", title), line("artist", filled(artist)), line("key", filled(key)), line("tempo", tempo.cast("string")), line("time", time), F.when(capo > 0, line(capo_name, capo.cast("string")))]
    if metas is not None:
        parts.append(F.nullif(F.array_join(F.transform(metas, lambda m: F.concat(F.lit("{meta: "), m, F.lit("}"))), "\n"), F.lit("")))
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def tags(extensions: Column, prefix: str = "sbp_") -> Column:
    """Entries of a map under a prefix as one tag directive, in the map's order; null without any."""
    entries = F.map_entries(F.map_filter(extensions, lambda k, _: k.startswith(prefix)))
    text = F.array_join(F.transform(entries, lambda e: F.concat(F.substring(e["key"], len(prefix) + 1, 1000), F.lit("="), e["value"])), " ")
    return F.when(F.size(entries) > 0, F.concat(F.lit(f"{{x_{prefix}tags: "), text, F.lit("}")))


def documents(headers: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """Whole documents: the header, then the sections (key, seq, body) in order."""
    bodies = sections.groupBy(*key).agg(joined(F.collect_list(F.struct("seq", F.col("body").alias("piece"))), "\n").alias("__bodies"))
    return headers.join(bodies, key, "left").select(*key, F.concat_ws("\n", "header", "__bodies").alias("document"))


#: Output profiles: how a header and an instrumental line are built.
PROFILES = {
    "inline_slash": {"instrumental": inline_bars, "capo": "capo"},
    "chordpro_ref": {"instrumental": grid_bars, "capo": "capo"},
    "onsong": {"instrumental": inline_bars, "capo": "x_capo"},
    "propresenter": {"instrumental": inline_bars, "capo": "capo"},
    "songbookpro": {"instrumental": inline_bars, "capo": "capo"},
}


def extension_lines(name: str, extensions: Column) -> Column:
    """A map's entries as header lines of a profile, in the map's order: ``ccli`` is a directive of its own for propresenter, ``sbp_`` entries are
    one tag line at the end for songbookpro, all else is meta. Null without any line."""
    meta = lambda e: F.concat(F.lit("{meta: "), e["key"], F.lit(" "), e["value"], F.lit("}"))
    line, tagged = meta, F.lit(None).cast("string")
    if name == "propresenter":
        line = lambda e: F.when(e["key"] == "ccli", F.concat(F.lit("{ccli: "), e["value"], F.lit("}"))).otherwise(meta(e))
    if name == "songbookpro":
        tagged = tags(extensions)
        extensions = F.map_filter(extensions, lambda k, _: ~k.startswith("sbp_"))
    return F.nullif(F.concat_ws("\n", F.array_join(F.nullif(F.transform(F.map_entries(extensions), line), F.array().cast("array<string>")), "\n"), tagged), F.lit(""))


def profiled_header(name: str, title: Column, artist: Column, key: Column, tempo: Column, time: Column, capo: Column, extensions: Column) -> Column:
    """A profile's whole header: the directives, then the extensions' lines, then an empty line."""
    plain = F.rtrim(header(title, artist, key, tempo, time, capo, None, profile(name)["capo"]))
    return F.concat(F.concat_ws("\n", F.regexp_replace(plain, "\n$", ""), extension_lines(name, extensions)), F.lit("\n"))


def routed(name: str, kind: Column, label: Column, lyrics: Column, grid: Column) -> Column:
    """A section's text: its lyrics between its directives; for chordpro_ref, where it has instrumental lines (grid), a grid block of these alone."""
    body = wrapped(kind, label, F.concat_ws("\n", lyrics, grid))
    if name != "chordpro_ref":
        return body
    return F.when(grid.isNotNull(), F.concat_ws("\n", F.concat(F.lit("{start_of_grid: "), label, F.lit("}")), grid, F.lit("{end_of_grid}"))).otherwise(body)


def profile(name: str) -> dict:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def beat_markers(positions: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """Words with beat markers: |p before the word, or at a share of its length inside.

    positions: key, idx (word), slot ('before' or 'inside'), t, position, fraction; words: key, idx, text.
    """
    mark = F.concat(F.lit("|"), F.col("position").cast("string"))
    before = positions.where("slot = 'before'").groupBy(*key, "idx").agg(joined(F.collect_list(F.struct("t", F.concat(mark, F.lit(" ")).alias("piece")))).alias("__before"))
    inside = positions.where("slot = 'inside'").join(words.select(*key, "idx", F.length("text").alias("__n")), [*key, "idx"])
    at = F.greatest(F.lit(0), F.least(F.col("__n"), F.bround(F.col("fraction") * F.col("__n")).cast("int")))
    inside = inside.select(*key, "idx", at.alias("pos"), F.col("t").alias("__t"), mark.alias("chord")).withColumn("order", F.col("__t"))
    listed = inside.select(*key, F.col("idx").alias("word"), "pos", F.col("order").alias("idx"), "chord")
    spliced = lyric_lines(words.withColumnRenamed("idx", "word"), listed, [*key, "word"])
    return spliced.join(before.withColumnRenamed("idx", "word"), [*key, "word"], "left").select(*key, F.col("word").alias("idx"), F.concat(F.coalesce("__before", F.lit("")), "line").alias("text"))


def report(rows: list, score: str = "score") -> str:
    """Markdown table of a top-n report's rows (already bounded)."""
    lines = ["| # | id | score | severity |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {i} | {r['id']} | {r[score]:.3f} | {r['severity']} |" for i, r in enumerate(rows, 1)])


def report_lines(marked: DataFrame, day: str, skipped: int = 0, n: int = 20) -> DataFrame:
    """A report of the n worst tracks as rows (part, at, line), to be read in order of part and at.

    marked: id, title, score (from 0 to 1), n_ref, n_est, reason (null where the score counts). After the title come the counts, a table of the n worst by
    severity, score and id, and every failure, however many. Only the table is ranked as a whole; failures stay rows. marked is read three times: write it before.
    """
    good = marked.where(F.col("reason").isNull())
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = validate.rollup(marked, skipped)
    bold = lambda name, value: F.concat(F.lit(f"- {name}: **"), value.cast("string"), F.lit("**"))
    top = (
        F.lit(f"# Top {n} divergences — {day}"),
        F.lit(""),
        bold("Total attempted", F.col("attempted")),
        bold("Successful metrics", F.col("attempted") - F.col("failed")),
        bold("Failures", F.col("failed")),
        bold("Skipped from corpus (empty URL / non-YouTube)", F.col("skipped")),
        bold("Mean WCSR-majmin", text.decimals(F.col("mean_score"), 3)),
        F.lit(""),
        F.lit("| Rank | Severity | WCSR | Title | YouTube | Chords ref / est |"),
        F.lit("|-----:|----------|-----:|-------|---------|------------------|"),
    )
    titles = F.when(F.col("failed") > 0, F.array(F.lit(""), F.lit("## Failures (no metric computed)"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    numbered = lambda part, c: F.transform(c, lambda x, i: F.struct(F.lit(part).alias("part"), i.cast("int").alias("at"), x.alias("line")))
    heads = counts.select(F.inline(F.concat(numbered(0, F.array(*top)), numbered(2, titles))))
    found = cascade.worst(good, "score", "id", n)
    rank = F.row_number().over(Window.orderBy("score", "id"))  # over n rows; a worse grade has a lower score
    row = F.concat(F.lit("| "), rank.cast("string"), F.lit(" | **"), F.col("severity"), F.lit("** | "), text.decimals(F.col("score"), 3), F.lit(" | "), text_of("title"), F.lit(" | `"), text_of("id"), F.lit("` | "), text_of("n_ref"), F.lit(" / "), text_of("n_est"), F.lit(" |"))
    ranked = found.select(F.lit(1).alias("part"), rank.alias("at"), row.alias("line"))
    failed = marked.where(F.col("reason").isNotNull())
    told = F.concat(F.lit("- **"), text_of("title"), F.lit("** (`"), text_of("id"), F.lit("`) — "), F.col("reason"))
    lines = failed.select(F.lit(3).alias("part"), F.lit(0).alias("at"), told.alias("line"))
    return heads.union(ranked).union(lines)
