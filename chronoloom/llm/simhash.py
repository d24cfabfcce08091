"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into eight segments on a ring. If two fingerprints differ in at most ``RADIUS`` = 2
bits, there is a segment from which on every chain of l consecutive segments differs in at most floor(l * 2 / 8) bits: its first
three segments are equal, four to seven differ in one bit at most, all eight in two. So every fingerprint is
filed under its eight chains of three equal segments (24 bits), pairs from one file are pruned by the budgets of longer chains,
and what is left is checked in full. Nothing is lost, and a chain's file is read by equality only.

Pairs are made of different fingerprints; documents with equal ones are folded together before. A file of more than ``SMALL``
fingerprints is never paired: within it, each fingerprint stands for itself and for its 40 neighbours at one bit outside the chain,
and fingerprints that meet at such a point are linked to the least of them. Two fingerprints of one file differ in at
most two bits exactly if they meet (a point between them is within one bit of both), so the links have the
same components, every row makes 41 rows at most, and no group of near copies is squared.

Components are found by alternating large-star and small-star steps over links of fingerprints, checkpointed in the shared folder.

Defined results: null and wordless texts have fingerprint zero and are linked like others; fewer than three words make one
shingle; a component without a non-null doc_id has a null id; repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_of, written

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Consecutive equal segments at a chain's start: the longest l with floor(l * RADIUS / SEGMENTS) = 0.
EQUAL = (SEGMENTS - 1) // RADIUS
SMALL = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """Majority of the bits of all shingles' hashes."""
    joined = b" ".join(text.translate(_LOWER).split())  # bytes.split() cuts at exactly these six characters
    if not joined:
        return 0
    blanks = [-1, *[m.start() for m in re.finditer(b" ", joined)], len(joined)]
    n = max(1, len(blanks) - SHINGLE)
    last = len(blanks) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[blanks[i] + 1 : blanks[min(i + SHINGLE, last)]], SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep=()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and the columns named in keep."""

    def made(batches):
        for batch in batches:
            got = np.array([fingerprint(t) for t in batch.column("__text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"], pa.array(got, pa.int64())], [*[n for n in batch.schema.names if n != "__text"], "fp"])

    picked = docs.select("doc_id", *[docs[c].alias(f"__kept_{c}") for c in keep], text_of(docs).alias("__text"))
    out = picked.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema
    return picked.mapInArrow(made, out)


def _bits(lo: int, n: int) -> int:
    """Mask of n bits from bit lo on, around the ring, as a signed long."""
    mask = sum(1 << ((lo + i) % 64) for i in range(n))
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def chains(fps: DataFrame) -> DataFrame:
    """Every fingerprint under its eight chains: start, key, fp."""
    rows = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_bits(i * WIDTH, EQUAL * WIDTH))).alias("key")) for i in range(SEGMENTS)])
    return fps.select("fp", F.explode(rows).alias("c")).select("c.start", "c.key", "fp")


def _within_budgets(start: Column, difference: Column) -> Column:
    """Every chain from start on keeps its share of the radius."""
    out = F.bit_count(difference) <= RADIUS
    for length in range(EQUAL + 1, SEGMENTS):
        masks = F.element_at(F.array(*[F.lit(_bits(i * WIDTH, length * WIDTH)) for i in range(SEGMENTS)]), start + 1)
        out = (F.bit_count(difference.bitwiseAND(masks)) <= length * RADIUS // SEGMENTS) & out
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between different fingerprints; their components are those of all links."""
    filed = written(chains(fps), "chains")
    sizes = filed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = filed.join(sizes, ["start", "key"])
    small, large = filed.where(F.col("n") <= SMALL), filed.where(F.col("n") > SMALL)
    right = small.select("start", "key", F.col("fp").alias("b"))
    pairs = small.select("start", "key", F.col("fp").alias("a")).join(right, ["start", "key"]).where("a < b")
    pairs = pairs.where(_within_budgets(F.col("start"), F.col("a").bitwiseXOR(F.col("b")))).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_bits(i, 1)) for i in range(64)])
    outside = F.element_at(F.array(*[F.lit(_bits(i * WIDTH, EQUAL * WIDTH)) for i in range(SEGMENTS)]), F.col("start") + 1)
    points = large.select("fp", "start", F.explode(F.filter(flips, lambda x: x.bitwiseAND(outside) == 0)).alias("flip"))
    points = points.select("start", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    # A point has at most 41 fingerprints around it.
    met = points.groupBy("start", "point").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    met = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return pairs.union(met).distinct()


#: Ways that a node's links are spread over.
SALTS = 16


def _spread(links: DataFrame, node: str, other: str, known: DataFrame) -> DataFrame:
    """links with the row that known has for their node, if any. A node with very many links is spread by its links' other end.

    known has few nodes (those whose links change), each with one row, which stands in every part.
    """
    salted = known.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return links.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted, [node, "__salt"], "left").drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of (a, b) edges, a < b, root being the least node of the component.

    In the large-star step a node's greater neighbours move to its least neighbour; a node without a lesser one keeps them,
    so the hub of a finished star takes part in no join. In the small-star step the lesser neighbours of a node that has several move to the least.
    """
    edges = checkpointed(edges)
    while True:
        least = edges.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("root"))
        between = least.join(edges.select("a").distinct(), "a", "left_semi")
        large = checkpointed(_spread(edges, "a", "b", between).select(F.coalesce("root", "a").alias("a"), "b").distinct())
        several = large.groupBy("b").agg(F.min("a").alias("root"), F.count("*").alias("n")).where("n > 1").select("b", "root")
        joined = _spread(large, "b", "a", several)
        pairs = F.when(F.col("root").isNull(), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct(F.col("root").alias("a"), F.col("a").alias("b")), F.struct(F.col("root").alias("a"), "b")))
        after = checkpointed(joined.select(F.inline(pairs)).where("a < b").distinct())
        # A star forest: every node has one parent, and no parent has a parent.
        crowded = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not crowded and not after.select(F.col("b").alias("a")).distinct().join(after.select("a").distinct(), "a", "left_semi").limit(1).count():
            return after.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = after


def classes(fps: DataFrame) -> DataFrame:
    """class_fp, class_root, component_id (the least doc_id of all documents whose fingerprints are linked), class_size for distinct fingerprints.

    fps: doc_id, fp.
    """
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "fingerprints")
    stars = components(links(distinct.select("fp")))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(ids, "root").select(F.col("fp").alias("class_fp"), F.col("root").alias("class_root"), "component_id", F.col("n").alias("class_size"))


#: Fingerprints that at least one in so many documents has are joined by broadcast; there are at most so many.
COMMON = 1000


def _placed(marked: DataFrame, found: DataFrame) -> DataFrame:
    """marked (fp, further columns) with the class of its fingerprint; common fingerprints are not shuffled."""
    found = written(found, "classes")
    total = found.agg(F.sum("class_size")).first()[0] or 0
    often = F.broadcast(found.where(F.col("class_size") * COMMON >= total))  # at most COMMON rows
    near = marked.join(often, marked["fp"] == often["class_fp"])
    rest = marked.join(often, marked["fp"] == often["class_fp"], "left_anti")
    rare = found.where(F.col("class_size") * COMMON < total)
    return near.unionByName(rest.join(rare, rest["fp"] == rare["class_fp"]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs), "document-fingerprints")
    return _placed(fps, classes(fps)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component: the one of least id, then of least text hash; a component without ids keeps the least hash.

    The decision is made over narrow rows (id, fingerprint, hash of the text); whole rows are then picked, one shuffle of them.
    """
    hashed = docs.withColumn("__hash", F.xxhash64(text_of(docs)))
    narrow = written(fingerprints(hashed, keep=("__hash",)), "document-fingerprints")
    placed = _placed(narrow, classes(narrow.select("doc_id", "fp"))).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = placed.groupBy("class_root").agg(F.min(F.struct("doc_id", "__kept___hash")).alias("first"))
    row = {"__id": F.coalesce("doc_id", F.lit(0)).cast("long"), "__null": F.col("doc_id").isNull()}
    first = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.__kept___hash").alias("__hash")).withColumns(row).drop("doc_id")
    keys = ["__id", "__null", "__hash"]
    return hashed.withColumns(row).dropDuplicates(keys).join(first, keys, "left_semi").select(*docs.columns)
