"""Gap sessions over a stream, with a fixed gap or one of the key's own, and a watermark."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session_counts(events: DataFrame, key: str, time: str, gap: str, lateness: str | None = None) -> DataFrame:
    """Sessions of point events: key, first and last time, number of events. For batches and streams alike.

    On a stream, rows later than the watermark are dropped, and a session is emitted (append mode) once the watermark has passed it.
    """
    marked = events.withWatermark(time, lateness) if lateness else events
    grouped = marked.groupBy(key, F.session_window(time, gap).alias("session"))
    return grouped.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("session")


_OPEN = ("n", "first", "end", "block")  # the session that is open: words, first start, last end, number


def _state(key_types: list[T.StructField]) -> tuple[T.StructType, T.StructType]:
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    waiting = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("t0", "idx", "t1")]
    return T.StructType([*key_types, *longs("block", "t0", "t1", "n_words")]), T.StructType([*longs(*_OPEN), T.StructField("threshold", T.DoubleType()), *waiting])


def _grown(key, frames, state):
    """One key's sessions closed by its new words or its timeout: words up to the watermark go to sessions in order, later ones wait."""
    n, first, end, block, threshold, *waiting = state.get if state.exists else (0, 0, 0, 0, None, [], [], [])
    words = list(zip(*waiting))
    for frame in frames:
        words.extend(zip(frame["__t0"].tolist(), frame["idx"].tolist(), frame["__t1"].tolist()))
        if threshold is None and len(frame):
            threshold = float(frame["__threshold"].iloc[0])
    seen = state.getCurrentWatermarkMs() * 1000  # no word up to it comes any more
    words.sort()
    ready = bisect_right(words, seen, key=lambda w: w[0])
    closed = []
    for t0, _, t1 in words[:ready]:
        if n and t0 - end > threshold:
            closed.append((*key, block, first, end, n))
            n, block = 0, block + 1
        n, first, end = n + 1, first if n else t0, t1
    if n and seen > end + threshold and (ready == len(words) or words[ready][0] - end > threshold):
        closed.append((*key, block, first, end, n))
        n, block = 0, block + 1
    words = words[ready:]
    state.update((n, first, end, block, threshold, *([w[i] for w in words] for i in range(3))))
    due = [words[0][0]] if words else [end + threshold] if n else []
    if due:  # in whole milliseconds, later than the watermark
        state.setTimeoutTimestamp(max(int(due[0] // 1000) + 1, state.getCurrentWatermarkMs() + 1))
    return closed


def gap_blocks(words: DataFrame, thresholds: DataFrame, key: list[str], name: str, floor: float, lateness: str) -> DataFrame:
    """Sessions with a gap of the key's own, over a stream of words (key, ts: timestamp of the start, t1: end in microseconds, idx), as ``sessions.gap_sessions`` has them.

    thresholds: a static table (key, name), one row a key; floor for keys that it lacks. A key keeps the threshold that came with its first word.
    Rows: key, block (numbered from 0), t0, t1 (the last word's end, in order of t0 and idx), n_words; a session is emitted once, when the watermark, or a
    word that the watermark has passed, is more than the threshold after its end. Words wait for the watermark, so order of arrival doesn't matter;
    a word not after it is dropped and counted (``late_rows``), one without times is left out. The first
    watermark is the epoch, so starts must be after it: shift times that count from a track's beginning. A key keeps its open session and the words of the
    lateness, no more, and comes back from the query's checkpoint.
    """
    known = thresholds.select(*key, F.col(name).cast("double").alias("__own"))
    timed = words.where(F.col("ts").isNotNull() & F.col("t1").isNotNull()).withWatermark("ts", lateness).join(known, key, "left")
    rows = timed.select(*key, "ts", "idx", F.unix_micros("ts").alias("__t0"), F.col("t1").alias("__t1"), F.coalesce("__own", F.lit(float(floor))).alias("__threshold"))
    out, kept = _state([rows.schema[c] for c in key])
    grown = lambda at, frames, state: iter([pd.DataFrame(_grown(at, frames, state), columns=out.names)])
    return rows.groupBy(*key).applyInPandasWithState(grown, out, kept, "append", "EventTimeTimeout")


def late_rows(query) -> int:
    """Rows that came later than the watermark and were dropped, over the progress that the query still remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
