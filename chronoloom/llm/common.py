"""Helpers shared by the corpus operators.

Everything that has to outlive a task is written to the shared folder that the session names in
``spark.checkpoint.dir``; nothing here touches a machine-local folder on a cluster.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in most contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; one is made only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession, only: tuple[str, ...] | None = None):
    """Delete, at the end, the tables that were written to the shared folder inside (none may be needed any more). Gives the list of their paths.

    only: just the tables of these labels; the others are left to the scratch around this one, if there is one.
    """
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield paths
    finally:
        _SCRATCH.pop()
        for path in paths:
            if only is None or path.rsplit("/", 1)[1].rsplit("-", 1)[0] in only:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif _SCRATCH:
                _SCRATCH[-1].append(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is executed inside go when its result is there, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: columnar, compressed, scannable twice. keep: not a part of the scratch around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text as a non-null string."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id falls in no fold and gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def by_bytes(batches, column: str, limit: int = 4 << 20, rows: int = 2000):
    """Arrow batches cut to slices of about ``limit`` bytes of a text or binary column (one value more at most) and at most ``rows`` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            before = filled[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(filled, before + limit, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, bound: int) -> DataFrame:
    """doc_id, text, label for at most ``bound`` labelled documents of each label, never of fold 0.

    The sample is the documents whose ids have the least digests, so it doesn't depend on partitions; its ids are
    bounded by the parameter and may be broadcast. A document with two labels counts as its lower one.
    """
    marked = labels.select(labels["doc_id"].alias("id"), labels[label].cast("int").alias("label"))
    marked = marked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_fold(F.col("id"), folds) != 0))
    marked = marked.groupBy("id").agg(F.min("label").alias("label")).withColumn("digest", F.xxhash64("id"))
    picked = None
    for value in (0, 1):
        part = marked.where(F.col("label") == value).orderBy("digest", "id").limit(bound)
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    return texts.join(F.broadcast(picked), texts["doc_id"] == picked["id"]).select("doc_id", "text", "label")


#: Elements of one block of a running combination.
RUN_BLOCK = 1024


def running(values: Column, combine) -> Column:
    """Running combination (an associative function) of an int array: inside blocks, then over blocks, so that no long array is copied per element."""
    none = F.array().cast("array<int>")

    def fold(items: Column, value) -> Column:
        return F.aggregate(items, none, lambda acc, x: F.array_append(acc, F.when(F.size(acc) > 0, combine(F.get(acc, F.size(acc) - 1), value(x))).otherwise(value(x))))

    def carried(inner: Column) -> Column:
        ends = fold(inner, lambda block: F.element_at(block, -1))
        return let(ends, lambda e: F.flatten(F.transform(inner, lambda block, i: F.when(i > 0, F.transform(block, lambda v: combine(F.get(e, i - 1), v))).otherwise(block))))

    starts = lambda v: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), F.lit(RUN_BLOCK))
    return let(values, lambda v: F.when(F.size(v) > 0, let(F.transform(starts(v), lambda at: fold(F.slice(v, at, F.lit(RUN_BLOCK)), lambda x: x)), carried)).otherwise(none))
