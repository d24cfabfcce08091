"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of docs. ``run`` writes each stage's result to the shared folder and reads it again for the next.

Defined results: rows with null text count as empty; repeated rows are duplicates of each other; rows with null ids are kept
through as other rows are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontamination, mixing, quality, secrets, simhash
from chronoloom.llm.common import read, scratch, text_of, written

#: SQL cannot express the conditional random field; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    keep = [c for c in docs.columns if c != "doc_id"]
    return quality.score(docs.withColumnsRenamed({c: f"__doc_{c}" for c in keep if c != "text"}), model, [c if c == "text" else f"__doc_{c}" for c in keep]).where("predicted = 1").select(
        *[F.col(c if c in ("doc_id", "text") else f"__doc_{c}").alias(c) for c in docs.columns]
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates."""
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; the verdict depends on the text alone and is joined by its SHA-256."""
    marked = docs.select(F.sha2(text_of(docs), 256).alias("doc_id"), "text")
    found = decontamination.digest(decontamination.match(marked, read(spark, sf_dir, "benchmark")), "string")
    bad = found.where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.sha2(text_of(docs), 256) == F.col("__bad"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; a column n_chars follows the text."""
    keep = [c for c in docs.columns if c != "doc_id"]
    renamed = docs.withColumnsRenamed({c: f"__doc_{c}" for c in keep if c != "text"})
    found = secrets.scan(renamed, keep=[c if c == "text" else f"__doc_{c}" for c in keep])
    masked = secrets.redacted(F.col("text"), F.col("spans"))
    counted = F.when(F.size("spans") > 0, F.length(masked)).otherwise(F.col("__doc_n_chars")) if "n_chars" in keep else None
    values = {"doc_id": F.col("doc_id"), "text": masked, "n_chars": counted}
    return found.select(*[(values[c] if c in values else F.col(f"__doc_{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, repeats counted."""
    return mixing.mix(docs, keep=("source", "text"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes on its way goes when its result is there
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
