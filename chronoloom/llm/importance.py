"""Importance resampling towards a target distribution with partition-local word tries.

Features are all runs of 1 to ``n`` consecutive words; a feature's bucket is the crc32 of its bytes modulo ``buckets``. A
document's weight is the sum of its features' gains: the log ratio of the buckets' smoothed shares in the target and in the documents. Documents
are drawn without replacement: the highest weights after a seeded Gumbel draw for each.

Method. Every partition builds a trie whose edges are words. A node stands for the run of words on its path and holds the
run's count and CRC state, from which a child's state follows by its own word alone; no run is joined or hashed twice. At the end
(and whenever a trie has ``NODES`` nodes, so that memory is bounded) a trie's counts go to its buckets' totals, which Spark
merges: ``buckets`` numbers, whatever the corpus. They give the gains. In the second pass the tries are built again with gains
attached to their nodes, and a document's weight is the sum along the paths that its words walk.

Only bucket totals (a parameter's number) pass through the driver. The texts are read twice and never shuffled. The draw
ranks narrow rows: a range partition by score and id (with a random last key, so that ties spread), counts of the partitions,
and positions inside each.

Defined results: null counts as no words; a row without an id draws from the digest of an empty id and is last among ties;
repeated rows draw alike and rank one after the other; no target or no documents leave the gains to the smoothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, text_of, written

BUCKETS = 10_000
#: Nodes of a trie from which on it starts anew.
NODES = 200_000
#: Rows of a partition of the draw.
RANKED = 1 << 20

#: A-Z in lower case; other ASCII characters that are no digits or letters separate words.
_WORD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


class Node(dict):
    """A run of words: children by word, the CRC state of its bytes, and its count or gain. A missing child is made from its parent's state."""

    __slots__ = ("state", "value", "trie")

    def __missing__(self, word: bytes) -> Node:
        child = self[word] = Node()
        child.trie = self.trie
        child.state = crc32(word if self is self.trie.root else b" " + word, self.state)
        child.value = self.trie.first_value(child.state)
        self.trie.size += 1
        return child


class Trie:
    def __init__(self, first_value):
        self.first_value, self.size = first_value, 0
        self.root = Node()
        self.root.trie, self.root.state, self.root.value = self, 0, 0

    def paths(self, words: list[bytes], n: int):
        """The nodes of all runs of 1 to n words, by their last word."""
        root = self.root
        if n == 1:
            yield from map(root.__getitem__, words)
            return
        open_runs: list[Node] = []
        for word in words:
            open_runs = [node[word] for node in (root, *open_runs[: n - 1])]
            yield from open_runs

    def nodes(self):
        stack = [self.root]
        while stack:
            children = stack.pop().values()
            yield from children
            stack.extend(children)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def bucket_totals(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features in each bucket."""

    def counted(batches):
        totals = np.zeros(buckets, np.int64)

        def settled(trie: Trie) -> Trie:
            found = [(node.state % buckets, node.value) for node in trie.nodes()]
            if found:
                at, counts = np.array(found, np.int64).T
                np.add.at(totals, at, counts)
            return Trie(lambda state: 0)

        trie = Trie(lambda state: 0)
        for batch in by_bytes(batches, "text"):
            for text in batch.column("text"):
                for node in trie.paths(words_of(text.as_py()), n):
                    node.value += 1
                if trie.size >= NODES:
                    trie = settled(trie)
        settled(trie)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], ["bucket", "n"])

    merged = texts.select(text_of(texts).cast("binary").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[merged.column("bucket").to_numpy()] = merged.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())]


def weights(docs: DataFrame, gains: list[int], n: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("key"), text_of(docs).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def draw(key: str) -> int:
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def scored(batches):
        gain = shared.value
        fresh = lambda: Trie(lambda state, k=len(gain): gain[state % k])
        trie = fresh()
        for batch in by_bytes(batches, "text"):
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                found = [node.value for node in trie.paths(words, n)]
                out.append((len(words), len(found), w := sum(found), w + draw(key)))
                if trie.size >= NODES:
                    trie = fresh()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*out))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """A column rank for the drawn rows: the highest scores, ties to the smaller id, of the rows with enough words."""
    fit = scored.where(F.col("n_words") >= min_words)
    n = fit.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__tie")]
    dealt = fit.withColumn("__tie", F.rand(0)).repartitionByRange(max(1, -(-n // RANKED)), *order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy("__part").count()  # one row a range
    before = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = dealt.join(before, "__part").withColumn("rank", place)
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*scored.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """Every document with n_features, weight, score and, if it is drawn, its rank."""
    gains = bucket_gains(bucket_totals(docs, n, buckets), bucket_totals(target, n, buckets))
    scored = written(weights(docs, gains, n, seed), "weights")
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows from word counts, for DuckDB; crc32 is folded over the bytes of the different words, with its table from the polynomial.
ORACLE = r"""
WITH RECURSIVE remainders(b, k, r) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM remainders WHERE k < 8),
remainder AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM remainders WHERE k = 8),
words AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS row, text AS text FROM documents
  UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
cut AS MATERIALIZED (
  SELECT side, id, row, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM words),
single AS (SELECT side, row, unnest(w) AS word FROM cut),
counted AS (SELECT side, row, word, count(*) AS c FROM single GROUP BY ALL),
different AS (SELECT DISTINCT word FROM counted),
coded AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || hex(encode(word))[2*i+1:2*i+2])::BIGINT)),
         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM different, remainder),
totals AS (SELECT bucket, sum(c) FILTER (side = 0) AS s, sum(c) FILTER (side = 1) AS t FROM counted JOIN coded USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM totals, sums),
weighed AS (SELECT row, sum(c * gain) AS weight FROM counted JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weighed USING (row) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END::BIGINT AS rank
FROM placed
"""
