"""Sinks, logs, selections, drains and the command line."""

import pytest
from pyspark.sql import functions as F

from chronoloom.__main__ import main
from chronoloom.functions import symbols, text
from chronoloom.operators import blocks, drain, render, stats, validate
from chronoloom.plans import plugins
from chronoloom.sources import readers, sinks


def test_documents_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "track string, document string")
    sinks.write_documents(docs, path, "track")
    sinks.write_documents(docs.where("track = 'b'"), path, "track")  # a is stale and goes
    got = spark.read.option("wholetext", True).text(path).collect()
    assert [(r["track"], r["value"]) for r in got] == [("b", "z")]


def test_scan_sets_broken_files_aside(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "2.json").write_text("{not json")
    good, skipped = sinks.scan_documents(spark, str(tmp_path), "id string, n int")
    assert [(r["id"], r["n"]) for r in good.collect()] == [("a", 1)]
    assert [r["file"].rsplit("/", 1)[1] for r in skipped.collect()] == ["2.json"]


def test_corrections_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = "audio_id string, timestamp double, field string, original map<string,string>, corrected map<string,string>, user_id string, note string, created_at string"
    rows = [("a", 1.5, "meter", {"n": "3"}, {"n": "4"}, None, "x", "2020-01-01"), ("a", 0.5, "word_text", {}, {"t": "b"}, "u", None, "2020-01-02"), ("b", -1.0, "else", {}, {}, None, None, "2020")]
    sinks.save_corrections(spark.createDataFrame(rows, entry), path)
    loaded = sinks.load_corrections(spark, path)
    assert sorted((tuple(r) for r in loaded.collect()), key=repr) == sorted(rows, key=repr)
    broken = validate.violations(loaded, ["audio_id"], sinks.correction_rules()).collect()
    assert sorted(tuple(r) for r in broken) == [("b", "field_allowed"), ("b", "timestamp_not_negative")]


def test_pinned_songs(spark):
    songs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "link_id string, n int")
    assert [r["n"] for r in sinks.pinned(songs, "link_id", ["c", "a"]).collect()] == [3, 1]
    assert [r["n"] for r in sinks.head(songs, "n", 2).collect()] == [1, 2]
    with pytest.raises(ValueError, match="x, y"):
        sinks.pinned(songs, "link_id", ["a", "x", "y"])


def test_ids_of_files_without_content(spark):
    files = spark.createDataFrame([("/a",), ("/b",)], "path string")
    found = {r["path"]: r["content_id"] for r in readers.named_ids(files, spark.createDataFrame([("/a", "f" * 16)], "path string, content_id string")).collect()}
    assert found["/a"] == "f" * 16 and len(found["/b"]) == 16


def test_progress_errors_stop_nothing(spark):
    plugins.register("double", plugins.Engine("x", "n long", lambda batches, by=2: (__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow.compute").compute.multiply(b.column(0), by)], ["n"]) for b in batches)))

    def progress(stage, name):
        raise RuntimeError("no")

    with plugins.described(spark, "double", "x"):
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "stage=double | engine=x"
        assert [r["n"] for r in plugins.apply(spark.range(3), "double", "x", progress, by=3).collect()] == [0, 3, 6]


def test_labels_against_rules(spark):
    cases = {"C/9": "C:maj", "Cm7/x": "C:min", "Gsus4/add9": "G:maj", "F7M/A": "F:maj7/A", "Esus/B": "E:maj/B", "Bm7b5": "B:min", "N": "N", "C/E": "C:maj/E"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string").select("want", symbols.label(F.col("s")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())
    pairs = [("C:maj", "C:7", True), ("Db:min", "C#:min7", True), ("C:dim", "C:dim", None), ("N", "N", True), ("N", "C:maj", False), ("C:maj", "N", False), ("C:maj/E", "C:maj", True), ("C:maj", "C:dim", False)]
    judged = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", symbols.same_triad(F.col("a"), F.col("b")).alias("got"))
    assert all(r["want"] == r["got"] for r in judged.collect())


def test_recall_covers_whole_references(spark):
    s = "k string, t0 long, t1 long, label string"
    ref = spark.createDataFrame([("x", 0, 10, "C:maj"), ("x", 10, 20, "G:maj"), ("y", 0, 10, "C:maj")], s)
    est = spark.createDataFrame([("x", 5, 8, "C:maj"), ("x", 8, 40, "G:maj")], s)
    # 3 of C, 10 of G; time before the estimate and after the reference counts as silence and not at all.
    assert [tuple(r) for r in stats.chord_recall(ref, est, ["k"], symbols.same_triad).collect()] == [("x", 13 / 20)]
    for block in (None, 3):
        every = stats.chord_recall(ref, est, ["k"], symbols.same_triad, block=block, every=True)
        assert dict(every.collect()) == {r["k"]: 13 / 20 if r["k"] == "x" else None for r in ref.select("k").distinct().collect()}


def test_two_decimals_as_printed(spark):
    values = [i / 1000 for i in range(1001)] + [0.125, 0.375, 0.845, 0.0, 1.0, 1e-9, 0.1 + 0.2]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.two_decimals(F.col("x")).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in rows if r["s"] != f"{r['x']:.2f}"] == []


def test_part_spans_and_sums(spark):
    row = spark.createDataFrame([("bem-vindo--já", 0, 9_000_000)], "w string, a long, b long").select(text.part_spans(F.col("w"), F.col("a"), F.col("b")).alias("p")).first()
    assert [tuple(x) for x in row["p"]] == [("bem", 0, 2_700_000), ("vindo", 2_700_000, 7_200_000), ("já", 7_200_000, 9_000_000)]
    long = spark.createDataFrame([([1] * 5000,), ([],), (None,)], "v array<int>").select(text.running_sum(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in long] == [list(range(5001)), [0], [0]]


def test_drain_between_lines(spark):
    words = spark.createDataFrame([("k", 0, 1, 10, 10, 20, "a"), ("k", 0, 2, 11, 30, 40, "b"), ("k", 1, 3, 12, 100, 110, "c")], "k string, line long, n long, idx long, t0 long, t1 long, text string")
    orphans = spark.createDataFrame([("k", t, f"|{t}") for t in (5, 10, 25, 45, 70, 99, 100, 200)], "k string, t long, mark string")
    got = drain.drain(orphans, drain.slots(words, ["k"], "line", 8), ["k"], "line")
    assert {r["t"]: r["slot"] for r in got.collect()} == {5: 1, 10: 2, 25: 2, 45: 4, 70: 5, 99: 5, 100: 6, 200: None}
    body = drain.rendered(words, got, ["k"], "line", "mark").first()["body"]
    assert body == "|5\na |10 |25 b |45\n|70 |99\nc |100\n{c: trailing beats (after last section)}\n|200"


def test_profile_headers(spark):
    ext = F.create_map(F.lit("sbp_difficulty"), F.lit("easy"), F.lit("sbp_section"), F.lit("Sun"), F.lit("ccli"), F.lit("1"))
    made = lambda name: spark.range(1).select(render.profiled_header(name, F.lit("T"), F.lit(""), F.lit(""), F.lit(60), F.lit("4/4"), F.lit(2), ext)).first()[0]
    assert made("songbookpro") == "{title: T}\n{tempo: 60}\n{time: 4/4}\n{capo: 2}\n{meta: ccli 1}\n{x_sbp_tags: difficulty=easy section=Sun}\n"
    assert "{ccli: 1}" in made("propresenter") and "{x_capo: 2}" in made("onsong")


def test_block_width_by_largest_key(spark):
    rows = spark.range(100).select((F.col("id") % 10 == 0).alias("k"), F.col("id").alias("t"))
    assert blocks.width_for(rows, ["k"], "t", 100) is None and blocks.width_for(rows.limit(0), ["k"], "t") is None
    assert blocks.width_for(rows, ["k"], "t", 9) == 98 * 9 // 90


def test_order_statistics_with_an_outlier(spark):
    values = [float(i * i % 997) for i in range(3000)] + [1e12]
    rows = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = stats.order_statistics(rows, ["k"], "v", {"m": F.floor(F.col("n") / 2), "top": F.col("n") - 1, "low": F.lit(0)}).first()
    assert (got["m"], got["top"], got["low"]) == (sorted(values)[len(values) // 2], 1e12, min(values))


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert main(["--list"]) == 0 and "q_cascade" in capsys.readouterr().out
    assert main(["q_slugify", "--tables", sf_dir, "--output", str(tmp_path / "rows")]) == 0
    assert spark.read.parquet(str(tmp_path / "rows")).count() > 0
    with pytest.raises(SystemExit):
        main(["q_unknown", "--tables", sf_dir])


def test_report_of_a_day(spark, tmp_path):
    """Counts, the worst ones in order, every failure; lines in order over the part files."""
    rows = [("v1", "Good", 0.96, 3, 4, None), ("v2", "Bad", 0.0625, 2, 2, None), ("v3", "Gone", None, 0, 0, "download failed"), ("v0", "Bad too", 0.0625, 1, 0, None), ("v4", "Also gone", None, 0, 0, "timeout")]
    marked = spark.createDataFrame(rows, "id string, title string, score double, n_ref int, n_est int, reason string")
    path = sinks.write_report(render.report_lines(marked, "2026-01-02", 5, 2), str(tmp_path), "2026-01-02")
    assert path == f"{tmp_path}/2026-01-02/top-divergences"
    parts = sorted((tmp_path / "2026-01-02" / "top-divergences").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == [
        "# Top 2 divergences — 2026-01-02", "", "- Total attempted: **5**", "- Successful metrics: **3**", "- Failures: **2**", "- Skipped from corpus (empty URL / non-YouTube): **5**", "- Mean WCSR-majmin: **0.362**", "",
        "| Rank | Severity | WCSR | Title | YouTube | Chords ref / est |", "|-----:|----------|-----:|-------|---------|------------------|",
        "| 1 | **CRITICAL** | 0.062 | Bad too | `v0` | 1 / 0 |", "| 2 | **CRITICAL** | 0.062 | Bad | `v2` | 2 / 2 |",
        "", "## Failures (no metric computed)", "", "- **Also gone** (`v4`) — timeout", "- **Gone** (`v3`) — download failed",
    ]
    none = render.report_lines(marked.limit(0), "d").orderBy("part", "at").collect()
    assert len(none) == 10 and none[6]["line"] == "- Mean WCSR-majmin: **0.000**"
    values = [0.0625, 0.1875, 0.3125, 0.0005, 1.0, 0.9995, 0.99951, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(text.decimals(F.col("x"), 3)).collect()
    assert [r[0] for r in got] == [f"{v:.3f}" for v in values]
