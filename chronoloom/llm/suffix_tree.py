"""Language-model scoring with a probabilistic suffix tree over bytes.

A text's tokens are its lower-cased words and one end. The tree models them as the bytes of the words joined by single
blanks, closed by a line feed (which no word holds), so it gives every token sequence a probability. Contexts have up to ``DEPTH`` bytes; a text begins
in a context of blanks.

1. Counts of all (DEPTH + 1)-grams of the training texts, per task and then by key (one shuffle, partial sums first). Shorter contexts
   are marginals of these.
2. A context is a candidate if it makes up at least ``P_MIN`` of all positions, so at most 1 / P_MIN contexts of each depth exist,
   whatever the corpus; it is retained if p(context) times the divergence of its next-symbol distribution from its
   parent's (the context without its oldest byte) is at least ``DIVERGENCE``. All parts of retained contexts become states, so that
   the longest retained suffix of the history is always known from the last state and the next byte.
3. Next-symbol distributions are smoothed towards the parent's: (count + KAPPA * parent) / (total + KAPPA), from uniform at the root.
4. Texts are cut into pieces that start DEPTH bytes early, and all pieces of a batch walk the states in step.

The tree is bounded by P_MIN and DEPTH and travels to the tasks; the counts it comes from grow with the corpus and never leave Spark.
The unigram base uses exact word counts: words that make up at least 1 / ``FREQUENT`` of the tokens (at most FREQUENT words) go along with
the tree, all others are joined by their 64-bit hash.

Defined results: null and wordless texts are one end; a null doc_id is neither held out nor trained on (held_out null);
repeated rows each give a row and each count; an empty training set scores by uniform distributions; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, text_of, written

FOLDS = 10
DEPTH = 5
P_MIN = 5e-6
DIVERGENCE = 3e-8
KAPPA = 4.0
FREQUENT = 5_000_000
BATCH = 6 << 20
PIECE = 1024
END = b"\n"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the (DEPTH + 1)-grams that end at each symbol of the texts, newest byte lowest; with their counts."""
    lead = b" " * DEPTH
    data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8)
    code = np.zeros(max(0, len(data) - DEPTH), np.uint64)
    for k in range(DEPTH, -1, -1):  # oldest first
        np.left_shift(code, np.uint64(8), out=code)
        np.bitwise_or(code, data[DEPTH - k : len(data) - k], out=code)
    sizes = np.array([len(t) + DEPTH for t in texts])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    inside = np.ones(len(data), bool)
    inside[(starts[:, None] + np.arange(DEPTH)).ravel()] = False  # the lead is context only
    code = code[inside[DEPTH:]]
    code.sort()
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[heads], np.diff(np.append(heads, len(code)))


def gather(train: DataFrame) -> DataFrame:
    """kind (0: gram, 1: word), key, n over all training texts."""

    def counted(batches):
        texts, size, words = [], 0, Counter()

        def rows():
            keys, counts = _grams(texts)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            every = np.concatenate([keys.astype(np.int64), hashes.view(np.int64)])
            numbers = np.concatenate([counts.astype(np.int64), np.fromiter(words.values(), np.int64, len(words))])
            kinds = np.concatenate([np.zeros(len(keys), np.int8), np.ones(len(words), np.int8)])
            for at in range(0, len(every), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[part]), pa.array(every[part]), pa.array(numbers[part])], ["kind", "key", "n"])

        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = words_of(text)
                words.update(found)
                words[END] += 1
                texts.append(b" ".join(found) + END)
                size += len(texts[-1])
                if size >= BATCH:
                    yield from rows()
                    texts, size, words = [], 0, Counter()
        if texts:
            yield from rows()

    return train.mapInArrow(counted, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def contexts(grams: DataFrame, total: int) -> pa.Table:
    """Sorted rows (d, ctx, sym, n, kept) of all states: the retained contexts and their parts. Bounded by P_MIN."""
    by_depth = None
    for d in range(DEPTH + 1):
        part = grams.select(
            F.lit(d).alias("d"), F.shiftright(F.col("key").bitwiseAND(F.lit(_mask(d + 1))), 8).alias("ctx"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n"
        )
        part = part.groupBy("d", "ctx", "sym").agg(F.sum("n").alias("n"))
        by_depth = part if by_depth is None else by_depth.union(part)
    sums = by_depth.groupBy("d", "ctx").agg(F.sum("n").alias("all")).where((F.col("d") == 0) | (F.col("all") >= P_MIN * total))
    found = written(by_depth.join(sums, ["d", "ctx"]), "contexts")
    parent = found.select((F.col("d") + 1).alias("pd"), F.col("ctx").alias("pctx"), F.col("sym").alias("psym"), F.col("n").alias("pn"), F.col("all").alias("pall"))
    masks = F.element_at(F.array(*[F.lit(_mask(max(0, d - 1))) for d in range(DEPTH + 1)]), F.col("d") + 1)
    joined = found.join(parent, (F.col("d") == F.col("pd")) & (F.col("ctx").bitwiseAND(masks) == F.col("pctx")) & (F.col("sym") == F.col("psym")))
    share, parent_share = F.col("n") / F.col("all"), F.col("pn") / F.col("pall")
    kept = joined.groupBy("d", "ctx").agg((F.max("all") / total * F.sum(share * F.log(share / parent_share))).alias("gain")).where(F.col("gain") >= DIVERGENCE)
    parts = [F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("ctx"))]
    for length in range(1, DEPTH + 1):
        for skip in range(DEPTH - length + 1):  # bytes dropped at the newest end
            fits = F.col("d") >= length + skip
            part = F.shiftright("ctx", 8 * skip).bitwiseAND(F.lit(_mask(length)))
            parts.append(F.when(fits, F.struct(F.lit(length).alias("d"), part.alias("ctx"))))
    states = kept.select(F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.d", "s.ctx").distinct()
    root = found.sparkSession.createDataFrame([(0, 0)], "d int, ctx long")
    states = states.union(root).distinct().join(kept.select("d", "ctx", F.lit(True).alias("kept")), ["d", "ctx"], "left")
    return found.join(states, ["d", "ctx"]).select("d", "ctx", "sym", "n", F.coalesce("kept", F.lit(False)).alias("kept")).orderBy("d", "ctx", "sym").toArrow()


def automaton(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next states and log10 probabilities, a row per state (0: the root) and a column per byte seen in training; and every byte's column.

    Bytes never seen share the last column: they are equally likely everywhere, and lead to the root.
    """
    depth_of, code, symbol, n, keeps = (rows.column(c).to_numpy() for c in ("d", "ctx", "sym", "n", "kept"))
    seen = np.unique(symbol)
    width = min(256, len(seen) + 1)
    column = np.full(256, width - 1, np.uint8)
    column[seen] = np.arange(len(seen))
    if not len(code):
        return np.zeros((1, 1), np.int32), np.full((1, 1), -np.log10(256.0), np.float32), column
    head = np.append(True, (depth_of[1:] != depth_of[:-1]) | (code[1:] != code[:-1]))
    index = np.cumsum(head) - 1
    d, ctx, kept = depth_of[head], code[head], keeps[head]
    bounds = np.searchsorted(d, np.arange(DEPTH + 3))

    def number(depth: int, wanted: np.ndarray) -> np.ndarray:
        """States of one depth by their contexts, which are sorted."""
        return bounds[depth] + np.searchsorted(ctx[bounds[depth] : bounds[depth + 1]], wanted)

    step = np.zeros((len(d), width), np.uint16 if len(d) <= 1 << 16 else np.int32)
    p = np.empty((len(d), width), np.float32)
    for depth in range(DEPTH + 1):
        first, last = bounds[depth], bounds[depth + 1]
        if depth:
            parent = number(depth - 1, ctx[first:last] & _mask(depth - 1))
            p[first:last] = p[parent]
            step[first:last] = step[parent]  # what the shorter history knows
        else:
            p[0] = 1 / 256
        mine = slice(*np.searchsorted(index, [first, last]))
        counts = np.zeros((last - first, width), np.float32)
        counts[index[mine] - first, column[symbol[mine]]] = n[mine]
        total = counts.sum(1, keepdims=True)
        counts += np.float32(KAPPA) * p[first:last]
        counts /= total + np.float32(KAPPA)
        smooth = kept[first:last] | (depth == 0)
        p[first:last][smooth] = counts[smooth]
        longer = np.arange(last, bounds[depth + 2])
        step[number(depth, ctx[longer] >> 8), column[ctx[longer] & 255]] = longer
    return step, np.log10(p, out=p), column


def walk(texts: list[bytes], step: np.ndarray, logs: np.ndarray, column: np.ndarray) -> np.ndarray:
    """log10 probability of every text."""
    lead = b" " * DEPTH
    pieces, owner = [], []
    for i, t in enumerate(texts):
        padded = lead + t
        for at in range(0, len(t), PIECE):
            pieces.append(padded[at : at + DEPTH + PIECE])
            owner.append(i)
    owner, lengths = np.array(owner), np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max())
    table = np.zeros((len(pieces), width), np.uint8)
    filled = np.arange(width) < lengths[order][:, None]
    table[filled] = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)
    columns = column[np.ascontiguousarray(table.T)]
    going = np.searchsorted(-lengths[order], -np.arange(1, width + 1), side="right")
    flat_step, flat_logs, symbols = step.ravel(), logs.ravel(), np.int64(step.shape[1])
    state, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces))
    for t in range(width):
        n = going[t]
        at = state[:n] * symbols + columns[t, :n]
        if t >= DEPTH:
            total[:n] += flat_logs[at]
        state[:n] = flat_step[at]
    return np.bincount(owner[order], total, len(texts))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), (crc_fold(docs["doc_id"], FOLDS) == 0).alias("held_out"))
    counts = written(gather(texts.where(~F.col("held_out")).select("text")), "counts")
    sums = {r["kind"]: (r["all"], r["distinct"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("all"), F.count("*").alias("distinct")).collect()}
    n_train, distinct = sums.get(1, (0, 0))
    tree = automaton(contexts(counts.where("kind = 0").select("key", "n"), sums.get(0, (0, 0))[0]))
    frequent = counts.where((F.col("kind") == 1) & (F.col("n") * FREQUENT >= n_train)).select("key", "n").orderBy("key").toArrow()  # FREQUENT rows at most
    shared = spark.sparkContext.broadcast((tree, frequent.column("key").to_numpy(), frequent.column("n").to_numpy()))
    del tree, frequent
    floor = float(np.log10(n_train + 0.1 * (distinct + 1)))

    def scored(batches):
        tree, keys, numbers = shared.value

        def rows(part):
            uid, ids, raw, held = part
            vocabulary: dict[bytes, int] = {}
            each, joined = [], []
            for text in raw:
                found = words_of(text)
                joined.append(b" ".join(found) + END)
                found.append(END)
                each.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int64, len(found)))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary)).view(np.int64)
            at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
            known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            c = np.where(known, numbers[at] if len(keys) else 0, 0)
            gain = np.log10(c + 0.1) - floor
            sizes = np.array([len(e) for e in each])
            flat = np.concatenate(each)
            starts = np.append(0, np.cumsum(sizes)[:-1])
            base, n_known = np.add.reduceat(gain[flat], starts), np.add.reduceat(known[flat].astype(np.int64), starts)
            rare = ~known[flat]
            tails = np.append(0, np.cumsum(np.add.reduceat(rare.astype(np.int64), starts))).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(tails), pa.array(hashes[flat[rare]]))
            columns = [pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(walk(joined, *tree)), tail]
            return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

        part, size = ([], [], [], []), 0
        for batch in batches:
            for row in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held_out").to_pylist()):
                for values, value in zip(part, row):
                    values.append(value)
                size += len(row[2])
                if size >= BATCH // 2:
                    yield rows(part)
                    part, size = ([], [], [], []), 0
        if part[0]:
            yield rows(part)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>"
    numbered = texts.withColumn("uid", F.monotonically_increasing_id())
    made = written(numbered.mapInArrow(scored, schema), "scores")
    # Rare words: what is still missing of the base, for those that the training texts have.
    rare = made.select("uid", F.explode("tail").alias("key"))
    rare_counts = counts.where((F.col("kind") == 1) & (F.col("n") * FREQUENT < n_train)).select("key", F.col("n").alias("c"))
    gained = rare.join(rare_counts, "key").groupBy("uid").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1))).alias("more"))
    return made.join(gained, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
