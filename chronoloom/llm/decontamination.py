"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a shard holds about ``SHARD_WORDS`` words of consecutive documents (one document
more at most) and is one row with its documents' ids and lengths and, for every term, the sorted list of positions.
Positions run through the shard, with a gap between documents that no phrase or neighbourhood spans. The index is a
table in the shared folder, so a lost executor costs the re-read of its shards only, and no posting is ever shuffled.

A test phrase is looked up in every shard: its terms are taken from the rarest on (by their frequency in the whole
index), lists are shifted by the term's offset in the phrase and intersected until nothing or the last term is left.
Phrases are windows of 13 consecutive words of an item; a shorter item is one phrase. A proximity match of an item
is a place where its rarest indexed term and the rarest others around it in the item (``NEAR_TERMS`` in all, at most ``NEAR`` words
away) stand within ``NEAR`` words of each other, so a verbatim copy always is one.

Test items are a stated query set; they travel with the tasks in blocks of at most ``BLOCK_WORDS`` words, and results of several
blocks are merged by document. Only terms of the test items are indexed while these have at most ``BLOCK_WORDS`` words
in all; beyond it, all terms are.

Defined results: null or wordless documents have zero words and are clean; null or wordless items have no windows; items that
repeat a text all count; items without an id hit words and count as one, without a name in the digest; repeated documents each give a row; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
NEAR = 20
NEAR_TERMS = 4

#: Bytes of words are a-z after lower-casing, 0-9 and everything from 0x80; all others separate.
_LOWER = bytes((c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20) for c in range(256))

INDEX = (
    "ids array<string>, lengths array<int>, terms array<binary>, starts array<int>, positions array<int>"
)


def tokens(data: bytes) -> list[bytes]:
    return data.translate(_LOWER).split()


def _shard(ids, texts, vocabulary):
    """One row of the index."""
    known: dict = {} if vocabulary is None else vocabulary
    lengths, found, places, base = [], [], [], 0
    for text in texts:
        words = tokens(text)
        if vocabulary is None:
            at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        else:
            at = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
        kept = np.flatnonzero(at >= 0)
        found.append(at[kept])
        places.append((kept + base).astype(np.int32))
        lengths.append(len(words))
        base += len(words) + WINDOW + NEAR
    found, places = np.concatenate(found), np.concatenate(places)
    order = np.argsort(found, kind="stable")
    used, first = np.unique(found[order], return_index=True)
    names = list(known)
    return ids, lengths, [names[i] for i in used], np.append(first, len(order)).astype(np.int32), places[order]


def build_index(docs: DataFrame, vocabulary: list[bytes] | None) -> DataFrame:
    """Shards of the positional index over all documents; of the given terms, or of all."""

    def shards(batches):
        numbered = None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)}
        ids, texts, size = [], [], 0

        def row():
            made = _shard(ids, texts, numbered)
            arrays = [pa.array([x], t) for x, t in zip(made, (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays(arrays, ["ids", "lengths", "terms", "starts", "positions"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text) // 6 + WINDOW + NEAR
                if size >= SHARD_WORDS:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return docs.select(docs["doc_id"].cast("string"), text_of(docs).alias("text")).mapInArrow(shards, INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """Occurrences of every indexed term."""
    counts = F.zip_with("terms", F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms"))), lambda t, i: F.struct(t.alias("term"), (F.element_at("starts", i + 1) - F.element_at("starts", i)).alias("n")))
    return index.where(F.size("terms") > 0).select(F.explode(counts).alias("c")).groupBy("c.term").agg(F.sum("c.n").alias("n"))


def _windows(items: list[tuple[str, list[bytes]]]) -> dict[tuple, list[str]]:
    """Phrase -> items that have it."""
    out: dict[tuple, list[str]] = {}
    for name, words in items:
        for i in range(max(1, len(words) - WINDOW + 1)):
            out.setdefault(tuple(words[i : i + WINDOW]), []).append(name)
    return out


def _holds(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(places, wanted)
    at[at == len(places)] = 0
    return places[at] == wanted


def _spans(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Union of [start, start + length) as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return list(zip(starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist()))


def _neighbours(words: list[bytes], counts: dict[bytes, int]) -> list[bytes]:
    """The rarest indexed term, then the rarest others within NEAR words of one of its places; one term alone only where the item has no other word."""
    known = [w for w in words if w in counts]
    if not known:
        return []
    first = min(known, key=lambda w: (counts[w], w))
    at = words.index(first)
    around = {w for w in words[max(0, at - NEAR) : at + NEAR + 1] if w in counts} - {first}
    terms = [first, *sorted(around, key=lambda w: (counts[w], w))[: NEAR_TERMS - 1]]
    return terms if len(terms) > 1 or len(set(words)) == 1 else []


def _names(found: set) -> list:
    """Names in order of strings, the missing one last."""
    return [*sorted(x for x in found if x is not None), *([None] if None in found else [])]


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], counts: dict[bytes, int]) -> DataFrame:
    """Per indexed document: doc_id, n_words, spans of hit words, items with a phrase match, items with a proximity match."""
    phrases = list(_windows(items).items())
    ordered = [(sorted(range(len(p)), key=lambda i, p=p: (counts.get(p[i], 0), i)), p, names) for p, names in phrases if all(w in counts for w in p)]
    rare = [(name, terms) for name, words in items if (terms := _neighbours(words, counts))]

    def look_up(batches):
        for batch in batches:
            places = batch.column("positions")
            for number, row in enumerate(batch.drop_columns(["positions"]).to_pylist()):
                starts, positions = np.asarray(row["starts"]), places[number].values.to_numpy().astype(np.int64)
                lists = {t: positions[starts[i] : starts[i + 1]] for i, t in enumerate(row["terms"])}
                n = len(row["ids"])
                lengths = np.asarray(row["lengths"], np.int64)
                bases = np.append(0, np.cumsum(lengths + WINDOW + NEAR)[:-1])
                hits: dict[int, list] = {}
                exact: list[set] = [set() for _ in range(n)]
                near: list[set] = [set() for _ in range(n)]
                for order, phrase, names in ordered:
                    at = lists.get(phrase[order[0]])
                    if at is None:
                        continue
                    at = at - order[0]
                    for k in order[1:]:
                        other = lists.get(phrase[k])
                        at = at[_holds(other, at + k)] if other is not None else at[:0]
                        if not len(at):
                            break
                    if len(at):
                        owners = np.searchsorted(bases, at, side="right") - 1
                        for d, p in zip(owners.tolist(), (at - bases[owners]).tolist()):
                            hits.setdefault(d, []).append((p, len(phrase)))
                            exact[d].update(names)
                for name, terms in rare:
                    at = lists.get(terms[0])
                    for t in terms[1:]:
                        other = lists.get(t)
                        if at is None or other is None or not len(at):
                            at = None
                            break
                        right = np.searchsorted(other, at)
                        after = other[np.minimum(right, len(other) - 1)]
                        before = other[np.maximum(right - 1, 0)]
                        at = at[np.minimum(np.abs(after - at), np.abs(before - at)) <= NEAR]
                    if at is not None and len(at):
                        for d in np.unique(np.searchsorted(bases, at, side="right") - 1).tolist():
                            near[d].add(name)
                spans = [_spans(*np.array(hits[d], np.int64).T) if d in hits else [] for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.string()),
                        pa.array(lengths),
                        pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([_names(x) for x in exact], pa.list_(pa.string())),
                        pa.array([_names(x) for x in near], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "spans", "items", "near_items"],
                )

    return index.mapInArrow(look_up, "doc_id string, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>, near_items array<string>")


def item_blocks(benchmark: DataFrame):
    """The test items with their words, in blocks of at most BLOCK_WORDS words (one item more)."""
    block, size = [], 0
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), text_of(benchmark).alias("text"))
    for r in rows.toLocalIterator():
        words = tokens(r["text"].encode())
        if words:
            block.append((r["item_id"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("sum")),
        lambda acc: acc["sum"],
    )


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Index docs, look every item up: doc_id (as a string), n_words, spans, items, near_items."""
    blocks = item_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        index = written(build_index(docs, sorted({w for _, words in first for w in words})), "postings")
        wanted = {w for _, words in first for w in words}
        counts = {bytes(r["term"]): r["n"] for r in frequencies(index).collect()}  # the items' own terms, bounded by BLOCK_WORDS
        return search(index, first, {w: n for w, n in counts.items() if w in wanted})
    index = written(build_index(docs, None), "postings")
    known = written(frequencies(index), "frequencies")
    parts = []
    for block in (first, second, *blocks):
        terms = docs.sparkSession.createDataFrame([(w,) for w in sorted({w for _, words in block for w in words})], "term binary")
        counts = {bytes(r["term"]): r["n"] for r in known.join(terms, "term", "left_semi").collect()}
        parts.append(search(index, block, counts))
    # Every block gives the shards' documents in the same order, so a row's place identifies it.
    merged = None
    for part in parts:
        part = part.withColumn("place", F.monotonically_increasing_id())
        merged = part if merged is None else merged.unionByName(part)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return merged.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("spans"), flat("items"), flat("near_items")).drop("place")


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def digest(found: DataFrame, ids: str = "long") -> DataFrame:
    """The contract's columns, and the items of proximity matches. ids: the type that the documents' ids had."""
    return found.withColumn("n_hit", _covered(F.col("spans"))).select(
        F.col("doc_id").cast(ids).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.array_join("near_items", ",").alias("near_items"),
    )


#: All windows against all positions, for DuckDB.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id::VARCHAR, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
spread AS (SELECT kind, id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
grams AS (
  SELECT kind, id, n, pos, list_value(word, LEADS) AS g FROM spread WINDOW o AS (PARTITION BY kind, id ORDER BY pos)),
phrases AS (
  SELECT DISTINCT id AS item, least(n, 13) AS size, array_to_string(g[1:least(n, 13)], ' ') AS phrase
  FROM grams WHERE kind = 'b' AND pos + least(n, 13) - 1 <= n),
sizes AS (SELECT DISTINCT size FROM phrases),
found AS (
  SELECT d.id, d.pos, s.size, p.item
  FROM grams d, sizes s, phrases p
  WHERE d.kind = 'd' AND d.pos + s.size - 1 <= d.n AND p.size = s.size AND array_to_string(d.g[1:s.size], ' ') = p.phrase),
hit AS (
  SELECT id, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT id, unnest(range(pos, pos + size)) AS at_word FROM found) GROUP BY id),
hit_items AS (
  SELECT id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM found) GROUP BY id),
freq AS (SELECT word, count(*) AS c FROM spread WHERE kind = 'd' AND word IN (SELECT word FROM spread WHERE kind = 'b') GROUP BY word),
item_words AS (SELECT id, pos, word, c FROM spread JOIN freq USING (word) WHERE kind = 'b'),
anchors AS (SELECT id, word AS lead_word, min(pos) AS at_pos FROM item_words
  WHERE (id, word) IN (SELECT (id, arg_min(word, (c, word))) FROM item_words GROUP BY id) GROUP BY id, word),
around AS (SELECT DISTINCT i.id, i.word, i.c FROM item_words i JOIN anchors a ON a.id = i.id AND i.pos BETWEEN a.at_pos - 20 AND a.at_pos + 20 AND i.word <> a.lead_word),
terms AS (SELECT id, word FROM around QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, word) <= 3),
needed AS (SELECT a.id, a.lead_word, (SELECT count(*) FROM terms t WHERE t.id = a.id) AS n FROM anchors a),
usable AS (SELECT * FROM needed WHERE n > 0 OR id IN (SELECT id FROM spread WHERE kind = 'b' GROUP BY id HAVING count(DISTINCT word) = 1)),
places AS (SELECT d.id AS doc, d.pos, u.id AS item, u.n FROM spread d JOIN usable u ON d.kind = 'd' AND d.word = u.lead_word),
near AS (
  SELECT DISTINCT doc, item FROM places WHERE n = 0
  UNION
  SELECT DISTINCT doc, item FROM (
    SELECT p.doc, p.pos, p.item FROM places p JOIN terms t ON t.id = p.item JOIN spread d ON d.kind = 'd' AND d.id = p.doc AND d.word = t.word AND abs(d.pos - p.pos) <= 20
    GROUP BY p.doc, p.pos, p.item, p.n HAVING count(DISTINCT t.word) = p.n)),
near_all AS (SELECT doc AS id, count(*)::BIGINT AS n_near, string_agg(item, ',' ORDER BY item) AS near_items FROM near GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM documents JOIN w ON w.kind = 'd' AND w.id = doc_id::VARCHAR LEFT JOIN hit ON hit.id = w.id LEFT JOIN hit_items ON hit_items.id = w.id LEFT JOIN near_all ON near_all.id = w.id
""".replace("LEADS", ", ".join(f"lead(word, {j}) OVER o" for j in range(1, WINDOW)))
