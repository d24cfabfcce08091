"""Queries of the corpus operators and their SQL; the pipeline at the repository's top is one of them."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, importance, infilling, licenses, media, mixing, quality, repeats, secrets, simhash, suffix_tree, topk, toxicity
from .common import read


def op1_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_repeats_run_length_index(spark, sf_dir):
    return repeats.digest(repeats.without_repeats(read(spark, sf_dir, "documents")))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_suffix_tree_scoring(spark, sf_dir):
    return suffix_tree.score(read(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.match(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op7_quality_crf(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_media_columns(spark, sf_dir):
    return media.digest(media.encode(read(spark, sf_dir, "documents")))


def op9_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op11_importance_resampling(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark, sf_dir):
    return infilling.digest(infilling.transform(read(spark, sf_dir, "documents")))


def op13_top_k_search(spark, sf_dir):
    return topk.search(read(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_license_scan,
    op2_toxicity,
    op3_repeats_run_length_index,
    op4_simhash_near_dedup,
    op5_suffix_tree_scoring,
    op6_decontamination,
    op7_quality_crf,
    op8_media_columns,
    op9_mixing,
    op10_secret_scan,
    op11_importance_resampling,
    op12_fill_in_middle,
    op13_top_k_search,
    pipeline,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {
        "op1_license_scan": licenses.oracle(),
        "op6_decontamination": decontamination.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op10_secret_scan": secrets.oracle(),
        "op11_importance_resampling": importance.ORACLE,
        "op12_fill_in_middle": infilling.ORACLE,
        "op13_top_k_search": topk.ORACLE,
    }
