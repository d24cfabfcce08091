"""License scans: MinHash bands over overlapping text windows (DataFrame functions only).

Texts are lower-cased and cut into words of letters and digits, then shingles of five words. Templates are cut
into windows of at most ``WIDTH`` shingles at every offset; documents, for every window width that occurs among
the templates, into windows of that width at a quarter of it as stride. A window's signature is the minimum of its
shingles' hashes under each of ``HASHES`` functions, and every value is a band of its own (one row a band), so two
windows of similarity J share a band with probability 1 - (1 - J) ** HASHES. A document window is off a template
window by an eighth of the width at most, so a copy with a containment of 0.8 keeps J above 0.45, and the
probability is above 1 - 5e-5 for a single window (``collision_probability``); long copies have many windows.
A template that shares a band with a document is then checked exactly: the share of the template's shingles that
the document has must reach ``CONTAINMENT``.

Windows without any shingle of any template have J = 0 with all template windows, so only documents that have
a template shingle are cut into windows, and only documents that have one of the words chosen so that every template shingle
has one (``telling_words``) are cut into shingles; these gates lose nothing. The first is an IN list, used while the templates have
at most ``GATE_LIMIT`` shingles; beyond it, all documents with a telling word are cut into windows.

Defined results: null and short texts (below five words) have no shingles and no matches; an empty table gives
no rows, empty templates no matches; repeated rows each give a row; licences are in code point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

SHINGLE = 5
WIDTH = 32
HASHES = 16
CONTAINMENT = 0.8
GATE_LIMIT = 20_000

#: Public licence notices (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "BSD-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
)


def collision_probability(similarity: float, hashes: int = HASHES) -> float:
    """Chance that two windows of this similarity share a band."""
    return 1 - (1 - similarity) ** hashes


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(word_array: Column, n: int = SHINGLE) -> Column:
    """Space-joined runs of n words; an empty array where there are fewer."""
    joined = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(word_array) - (n - 1))),
        lambda i: F.concat_ws(" ", *[F.try_element_at(word_array, (i + j).cast("int")) for j in range(n)]),
    )
    return F.when(F.size(word_array) >= n, joined).otherwise(F.array().cast("array<string>"))


def template_frame(spark, templates=TEMPLATES) -> DataFrame:
    rows = spark.createDataFrame([(str(k), str(t)) for k, t in templates], "license string, text string")
    return rows.select("license", F.array_distinct(shingles(words(F.col("text")))).alias("shingles")).where(F.size("shingles") > 0)


def telling_words(found: list[list[str]]) -> list[str]:
    """Words of which every shingle has at least one: of each not yet met, its longest."""
    chosen: set = set()
    for s in (s for one in found for s in one):
        parts = s.split(" ")
        if chosen.isdisjoint(parts):
            chosen.add(max(parts, key=lambda w: (len(w), w)))
    return sorted(chosen)


def _least(window: Column, number: int) -> Column:
    return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(number))))


def _minima(window: Column) -> Column:
    """One minimum per hash function."""
    return let(window, lambda w: F.array(*[_least(w, i) for i in range(HASHES)]))


def _template_bands(known: DataFrame) -> dict:
    """template -> window width -> hash number -> minima of its windows; the templates are a parameter, not data."""
    cuts = known.withColumn("w", F.least(F.lit(WIDTH), F.size("shingles"))).withColumn("h", F.transform("shingles", lambda s: F.xxhash64(s)))
    cuts = cuts.select("license", "w", F.explode(F.sequence(F.lit(1), F.size("h") - F.col("w") + 1)).alias("at"), "h")
    bands: dict = {}
    for r in cuts.select("license", "w", _minima(F.slice("h", F.col("at"), F.col("w"))).alias("m")).collect():
        for i, m in enumerate(r["m"]):
            bands.setdefault(r["w"], {}).setdefault(i, {}).setdefault(m, set()).add(r["license"])
    return bands


def _retrieved(hashes: Column, bands: dict) -> Column:
    """Names of the templates that share a band with a window of the document."""
    names = []
    for w, tables in sorted(bands.items()):
        stride = max(1, w // 4)
        maps = [F.create_map(*[x for m, found in sorted(tables[i].items()) for x in (F.lit(m), F.array(*[F.lit(k) for k in sorted(found)]))]) for i in range(HASHES)]
        last = F.greatest(F.lit(1), F.size(hashes) - (w - 1))
        starts = F.array_union(F.sequence(F.lit(1), last, F.lit(stride)), F.array(last))

        names.append(F.flatten(F.transform(starts, _cut(hashes, w, _looked_up(maps)))))
    return F.array_distinct(F.flatten(F.array(*names)))


def _looked_up(maps: list):
    none = F.array().cast("array<string>")
    return lambda window: F.flatten(F.array(*[F.coalesce(F.try_element_at(maps[i], _least(window, i)), none) for i in range(HASHES)]))


def _cut(hashes: Column, w: int, body):
    return lambda at: let(F.slice(hashes, at, F.lit(w)), body)


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_licenses, licenses (comma-joined), best_containment (null without a match)."""
    none = F.array().cast("array<struct<license:string,containment:double>>")
    known = template_frame(docs.sparkSession, templates)
    listed = sorted((r["license"], r["shingles"]) for r in known.collect())  # the templates are a parameter, not data
    if not listed:
        return _report(docs.select("doc_id", none.alias("matches")))
    gate = F.array(*[F.lit(s) for s in sorted({s for _, found in listed for s in found})])
    gated = sum(len(found) for _, found in listed) <= GATE_LIMIT
    bands = _template_bands(known)
    contents = F.create_map(*[x for name, found in listed for x in (F.lit(name), F.array(*[F.lit(s) for s in found]))])

    def matches(cut: Column) -> Column:
        def verified(name: Column) -> Column:
            wanted = F.element_at(contents, name)
            return F.struct(name.alias("license"), (F.size(F.array_intersect(cut, wanted)).cast("double") / F.size(wanted).cast("double")).alias("containment"))

        found = let(F.transform(cut, lambda s: F.xxhash64(s)), lambda hashes: F.transform(_retrieved(hashes, bands), verified))
        kept = F.array_sort(F.filter(found, lambda x: x["containment"] >= containment))
        may = (F.size(cut) > 0) & F.arrays_overlap(cut, gate) if gated else F.size(cut) > 0
        return F.when(may, kept).otherwise(none)

    telling = F.array(*[F.lit(w) for w in telling_words([found for _, found in listed])])
    told = lambda cut: F.when(F.arrays_overlap(cut, telling), let(shingles(cut), matches)).otherwise(none)
    return _report(docs.select("doc_id", let(words(text_of(docs)), told).alias("matches")))


def _report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.transform("matches", lambda x: x["license"]), ",").alias("licenses"),
        F.array_max(F.transform("matches", lambda x: x["containment"])).alias("best_containment"),
    )


def oracle(templates=TEMPLATES) -> str:
    """Exact containment of every template in every document, for DuckDB."""
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates)
    leads = ", ".join(f"lead(word, {j}) OVER o" for j in range(1, SHINGLE))
    cut = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id, NULL AS license, {cut} AS w FROM documents
  UNION ALL SELECT 't', NULL, license, {cut} FROM (VALUES {rows}) AS v(license, text)),
spread AS (SELECT kind, doc_id, license, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM cut WHERE len(w) >= {SHINGLE}),
shingled AS (
  SELECT kind, doc_id, license, concat_ws(' ', word, {leads}) AS s
  FROM spread WINDOW o AS (PARTITION BY kind, doc_id, license ORDER BY pos)
  QUALIFY lead(word, {SHINGLE - 1}) OVER o IS NOT NULL),
t AS (SELECT DISTINCT license, s FROM shingled WHERE kind = 't'),
sizes AS (SELECT license, count(*) AS n FROM t GROUP BY license),
shared AS (
  SELECT d.doc_id, t.license, count(DISTINCT d.s) AS k FROM shingled d JOIN t ON d.s = t.s WHERE d.kind = 'd' GROUP BY ALL),
matched AS (
  SELECT doc_id, license, k::DOUBLE / n::DOUBLE AS containment FROM shared JOIN sizes USING (license) WHERE k::DOUBLE / n::DOUBLE >= {CONTAINMENT})
SELECT doc_id, count(license)::BIGINT AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses, max(containment) AS best_containment
FROM documents LEFT JOIN matched USING (doc_id) GROUP BY doc_id
"""
