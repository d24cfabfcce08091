"""Exact top-k search by inner product with a bit-sliced index.

Components are quantised to integers, floor(``scale`` * x). The index keeps blocks of about ``BLOCK`` rows; in a block, every attribute
(a component less its least value in the block) is stored as bit slices: bitmaps over the block's rows, one for each
binary digit.

Search. A query's inner products with a whole block are a sum of slices: slice j of attribute d has weight 2**(i + j) for
every binary digit i of the query's component d (the complement of the slice, where that is negative; a constant makes up for it). Bitmaps of equal
weight are added by carry-save steps, three to a sum and a carry of the next weight, until one bitmap of each weight is left: the slices of
the scores. From the most significant downward, rows with a one are taken while no more than k have it, and rows without it go as soon as k have
one. Rows left at the end are equal in every slice: this boundary is resolved exactly, by id, and the scores
of the rows taken are read from the slices. So the result is exact; nothing is estimated.

Spark deals rows to blocks, builds each in one group, and stores the index in the shared folder. Queries are grouped by ``QUERIES``; every
(query group, block) is one task's group of bounded size, and the best k of each block meet in a window over the query.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate; a row without an id is
no query, and last among ties; rows are told apart even if ids or vectors are equal (any other row is a candidate, and each query row
gives its own result; which of its rows with equal id and score is meant makes no difference); vectors of different
lengths have no inner product and don't meet; a query without candidates gives no row; inner products beyond 64 bits are outside this
contract (they wrap); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block, queries of a group, queries whose slices are added at once.
BLOCK = 3072
QUERIES = 1024
TOGETHER = 16

INDEX = "dims long, block long, ids array<long>, rows array<long>, low array<long>, digits long, slices binary"
FOUND = "row long, query_id long, vec_id long, score long"
_ONE = np.uint64(1)


def _digits(most: int) -> int:
    return max(1, int(most).bit_length())


def sliced(values: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Least value of each attribute, binary digits, and slices [attribute, digit, word] of an int64 table of rows x attributes."""
    low = values.min(axis=0)
    above = values.view(np.uint64) - low.view(np.uint64)
    digits = _digits(above.max(initial=0))
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], digits, words * 8), np.uint8)
    for j in range(digits):
        bits = np.packbits(((above >> np.uint64(j)) & _ONE).astype(np.uint8), axis=0, bitorder="little")
        out[:, j, : len(bits)] = bits.T
    return low, digits, out.view(np.uint64)


def added(table: np.ndarray, chosen: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sums: chosen[w] has, for each query, the rows of the table that count 2**w."""
    out, carried, w = [], [], 0
    while w < len(chosen) or carried:
        stack = [table[chosen[w]]] if w < len(chosen) and len(chosen[w]) else []
        stack = np.concatenate([*stack, *carried]) if stack or carried else None
        carried = []
        if stack is None:
            out.append(None)
        else:
            while (n := len(stack) // 3) > 0:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                stack = np.concatenate([odd ^ c, stack[3 * n :]]) if len(stack) > 3 * n else odd ^ c
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0])
        w += 1
    return out


def weighted(queries: np.ndarray, digits: int) -> list[np.ndarray]:
    """For each weight, the table's rows (padded with its zeros) that each query adds: [row, query]."""
    n, dims = queries.shape
    negative = queries < 0
    size = np.where(negative, (~queries).view(np.uint64) + _ONE, queries.view(np.uint64))
    zero = 2 * dims * digits
    found = [[] for _ in range(_digits(size.max(initial=0)) + digits - 1)]
    for i in range(_digits(size.max(initial=0))):
        q, d = np.nonzero((size >> np.uint64(i)) & _ONE)
        first = (negative[q, d] * dims + d) * digits
        for j in range(digits):
            found[i + j].append((q, first + j))
    out = []
    for parts in found:
        q, rows = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(q, kind="stable")
        q, rows = q[order], rows[order]
        counts = np.bincount(q, minlength=n)
        chosen = np.full((int(counts.max(initial=0)), n), zero)
        chosen[np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts), q] = rows
        out.append(chosen)
    return out


def selected(sums: list[np.ndarray], open_rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of highest sums for each query, as bits [query, row]; the earliest rows of the boundary. open_rows: bitmaps of the candidates."""
    sure, left = np.zeros_like(open_rows), open_rows.copy()
    for digit in reversed(sums):
        if digit is None:
            continue
        above = sure | (left & digit)
        n = np.bitwise_count(above).sum(axis=1)[:, None]
        sure = np.where(n <= k, above, sure)
        left = np.where(n > k, left & digit, np.where(n < k, left & ~digit, np.uint64(0)))
    bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(bool)
    taken, boundary = bits(sure), bits(left)
    return taken | (boundary & (np.cumsum(boundary, axis=1) <= k - taken.sum(axis=1)[:, None]))


def best_of_block(queries: np.ndarray, own: np.ndarray, n: int, low: np.ndarray, digits: int, slices: np.ndarray, k: int):
    """(query, row, score) arrays of the best k rows of one block for each query; own: the query's own row, or -1."""
    dims, words = len(low), slices.shape[-1]
    table = np.concatenate([slices.reshape(-1, words), ~slices.reshape(-1, words), np.zeros((1, words), np.uint64)])
    everything = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    out = []
    for at in range(0, len(queries), TOGETHER):
        part, mine = queries[at : at + TOGETHER], own[at : at + TOGETHER]
        sums = added(table, weighted(part, digits)) if dims else []
        candidates = np.tile(everything, (len(part), 1))
        here = np.flatnonzero(mine >= 0)
        candidates[here, mine[here] >> 6] &= ~(_ONE << (mine[here] & 63).astype(np.uint64))
        q, row = np.nonzero(selected(sums, candidates, k))
        score = np.zeros(len(q), np.uint64)
        for w, digit in enumerate(sums[:64]):
            if digit is not None:
                score += ((digit[q, row >> 6] >> (row & 63).astype(np.uint64)) & _ONE) << np.uint64(w)
        # What the least values and the complements stand for, modulo 2**64.
        constant = (part.view(np.uint64) * low.view(np.uint64)).sum(axis=1) + (np.where(part < 0, part, 0).view(np.uint64) * ((_ONE << np.uint64(digits)) - _ONE if digits < 64 else ~np.uint64(0))).sum(axis=1)
        out.append((q + at, row, (score + constant[q]).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _table(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dims)


def _build(group: pa.Table) -> pa.Table:
    """One block of the index, its rows in order of their ids."""
    group = group.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # ids of null last
    dims = group.column("dims")[0].as_py()
    low, digits, slices = sliced(_table(group.column("values"), dims)) if dims else (np.empty(0, np.int64), 1, np.empty(0, np.uint64))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
    values = (dims, group.column("block")[0].as_py(), group.column("vec_id").to_pylist(), group.column("row").to_pylist(), low.tolist(), digits, slices.tobytes())
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [f.split()[0] for f in INDEX.split(", ")])


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own), vec_id, values, dims of the vectors that take part, dealt to blocks of about BLOCK rows."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding")).where(F.col("embedding").isNotNull() & whole)
    rows = rows.select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("values"), F.size("embedding").cast("long").alias("dims"))
    return rows.withColumns({"row": F.monotonically_increasing_id(), "draw": F.rand(0)})


def index(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """INDEX: a row for each block. sizes: dims and blocks."""
    dealt = rows.join(sizes, "dims").select("dims", F.floor(F.col("draw") * F.col("blocks")).alias("block"), "row", "vec_id", "values")
    return dealt.groupBy("dims", "block").applyInArrow(_build, INDEX)


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose id is divisible by ``every`` with all other rows."""
    rows = written(quantised(vectors, scale), "vectors")
    asked = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("asked"))
    sizes = sizes.select("dims", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("asked") / QUERIES).alias("parts"))
    built = written(index(rows, sizes.select("dims", "blocks")), "bit-slices")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    parted = sizes.where("parts > 0")
    queries = rows.where(asked).join(parted, "dims").withColumn("part", F.floor(F.col("draw") * 4096 * F.col("parts")) % F.col("parts"))
    queries = queries.select("dims", numbers("blocks").alias("block"), "part", "row", "vec_id", "values")
    blocks = built.join(parted.select("dims", "parts"), "dims").select("*", numbers("parts").alias("part")).drop("parts")

    def best(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, ["row", "query_id", "vec_id", "score"])
        one = {c: block.column(c)[0] for c in block.column_names}
        ids, numbers = one["ids"].values, one["rows"].values.to_numpy()
        low, digits = np.array(one["low"].as_py(), np.int64), one["digits"].as_py()
        slices = np.frombuffer(one["slices"].as_py(), np.uint64).reshape(len(low), digits, -1) if len(low) else np.zeros((0, 1, -(-len(ids) // 64)), np.uint64)
        row = asked.column("row").to_numpy()
        order = np.argsort(numbers)
        at = np.minimum(np.searchsorted(numbers, row, sorter=order), len(numbers) - 1)
        own = np.where(numbers[order[at]] == row, order[at], -1)
        q, found, score = best_of_block(_table(asked.column("values"), len(low)), own, len(ids), low, digits, slices, k)
        take = pa.array(q)
        return pa.Table.from_arrays([asked.column("row").take(take), asked.column("vec_id").take(take), ids.take(pa.array(found)), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    keys = ("dims", "block", "part")
    found = queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(best, FOUND)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by all pairs, for DuckDB (small tables).
ORACLE = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
paired AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)),
placed AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM paired)
SELECT query_id::BIGINT AS query_id, rank, vec_id::BIGINT AS vec_id, score FROM placed WHERE rank <= 5
"""
