"""Batch functions over long sequences, window by window with context on both sides, cropped and stitched.

A sequence is cut into windows; each sees ``context`` samples more on either side, zeros beyond the ends. What a function makes of the context is
cropped, so that the windows' inner frames follow one another without a seam. If a frame depends on no sample further away than the context, the
stitched frames equal those of the whole sequence at once. A window is a group of bounded size, so a sequence spreads over tasks however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(samples: DataFrame, lengths: DataFrame, key: list[str], window: int, context: int) -> DataFrame:
    """key, n, window, at, x: a row for each window of a key's n samples (i from 0, x), with the places (from the context's begin) and values of its samples in order of place."""
    first, last = F.floor((F.col("i") - context) / window), F.floor((F.col("i") + context) / window)
    spread = samples.select(*key, "i", "x", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), last)).alias("window"))
    place = (F.col("i") - F.col("window") * window + context).cast("int")
    held = spread.groupBy(*key, "window").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col("x").cast("double").alias("x")))).alias("all"))
    every = lengths.where("n > 0").select(*key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window))).alias("window"))
    part = lambda c: F.coalesce(F.transform("all", lambda s: s[c]), F.array().cast("array<int>" if c == "at" else "array<double>"))
    return every.join(held, [*key, "window"], "left").select(*key, "n", "window", part("at").alias("at"), part("x").alias("x"))


def stitched(samples: DataFrame, key: list[str], function: Callable[[np.ndarray], np.ndarray], window: int, context: int, stride: int = 1, lengths: DataFrame | None = None, batch: int = 8) -> DataFrame:
    """key, frame, value: function's frames over each key's samples (i from 0, x; absent ones are 0, of repeated ones the last by value counts).

    function takes a table of window + 2 * context samples a row (``batch`` rows at most) and gives a frame for every ``stride`` samples; window and context are
    multiples of it. lengths: key, n; without it a key ends with its last sample. A key has ceil(n / stride) frames.
    """
    if window <= 0 or context < 0 or window % stride or context % stride:
        raise ValueError("window and context have to be multiples of the stride, the window positive")
    lengths = samples.groupBy(*key).agg((F.max("i") + 1).alias("n")) if lengths is None else lengths
    rows = windows(samples, lengths, key, window, context)
    width, side = window + 2 * context, context // stride

    def framed(batches):
        for given in batches:
            for start in range(0, len(given), batch):
                part = given.slice(start, batch)
                table = np.zeros((len(part), width))
                for row, at, x in zip(table, part.column("at"), part.column("x")):
                    row[at.values.to_numpy()] = x.values.to_numpy()
                frames = np.asarray(function(table), np.float64)
                if frames.shape != (len(part), width // stride):
                    raise ValueError(f"the function gave {frames.shape} frames for {table.shape} samples")
                inner = frames[:, side : side + window // stride]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * inner.shape[1], pa.int32()), pa.array(inner.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*key, "n", "window")), values], [*key, "n", "window", "values"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*key, "n", "window"))
    made = rows.mapInArrow(framed, f"{kinds}, values array<double>")
    each = made.select(*key, "n", "window", F.posexplode("values").alias("__j", "value"))
    frame = F.col("window") * (window // stride) + F.col("__j")
    return each.withColumn("frame", frame).where(F.col("frame") * stride < F.col("n")).select(*key, "frame", "value")
