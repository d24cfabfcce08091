"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. A line's own features, those of the line before and of the line after, each cut at
quantiles of the training lines, give its log-odds; a matrix of four weights couples neighbouring labels. The field
is fitted by maximum likelihood with the document's label on all its lines, on pieces of at most ``PIECE`` lines.
A document's score is the mean of its lines' marginal probabilities of "good" (forward-backward), weighted by length in bytes.

Fitting uses at most ``SAMPLE`` documents of each label, in the order of their ids' digests up to ``LINES`` lines and whole (a documented bound;
weighed back to the labels' shares). The features see nothing but the text. Scoring is one narrow pass over the whole texts.

Defined results: null and empty texts have one empty line; texts without any labelled document (or with one label alone)
get the share of label 1, or 0.5 without labels; a null doc_id has held_out null; repeated rows each give a row; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, text_of

FOLDS = 5
SAMPLE = 3000
PIECE = 64
LINES = 300_000
#: Lines compressed at a time.
BLOCK = 256
BINS = 10
STEPS = 120
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_COMMON = b".,;:!?'\"()-"
_BLANK = b" \t\r\x0b\x0c"
_NAMES = ("length", "words", "upper", "digits", "marks", "symbols", "distinct", "mean_word", "packed", "again", "same_as_last", "ends", "doc_distinct", "doc_packed")


def lines_of(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def packed(lines: list[bytes]) -> int:
    """Compressed size of all lines with the line feeds between them, without joining them."""
    deflate = zlib.compressobj(1)
    out = 0
    for i in range(0, len(lines), BLOCK):
        out += len(deflate.compress(b"\n".join(lines[i : i + BLOCK]) + b"\n" * (i + BLOCK < len(lines))))
    return out + len(deflate.flush())


def features(lines: list[bytes]) -> np.ndarray:
    """One row of numbers per line."""
    out = np.empty((len(lines), len(_NAMES)), np.float32)
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    last = None
    vocabulary: set = set()
    total = 0
    for i, line in enumerate(lines):
        n = len(line)
        words = line.split()
        k = len(words)
        distinct = set(words)
        vocabulary |= distinct
        total += k
        solid = n - (n - len(line.translate(None, _BLANK)))
        letters = n - len(line.translate(None, _LETTERS))
        upper = n - len(line.translate(None, _UPPER))
        digits = n - len(line.translate(None, _DIGITS))
        marks = n - len(line.translate(None, _COMMON))
        whole = max(1, solid)
        out[i] = (
            np.log1p(n), np.log1p(k), upper / max(1, letters), digits / whole, marks / whole, (solid - letters - digits - marks) / whole,
            len(distinct) / max(1, k), solid / max(1, k), len(zlib.compress(line, 1)) / n if n > 40 else 1.0, np.log(seen[line]) if n else 0.0,
            line == last, line[-1:] in (b".", b"!", b"?"), 0, 0,
        )
        last = line
    size = sum(map(len, lines))
    out[:, 12] = len(vocabulary) / max(1, total) ** 0.8
    out[:, 13] = packed(lines) / (size + len(lines) - 1) if size > 40 else 1.0
    return out


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column j's bin, shifted so that all columns share one table of weights."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * BINS for j in range(x.shape[1])], 1)


def _with_neighbours(bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own bins, the line before's and the line after's; at the ends a bin that stands for none."""
    width = bins.shape[1] * BINS
    none = np.full((1, bins.shape[1]), 3 * width)
    before, after = np.concatenate([none, bins[:-1] + width]), np.concatenate([bins[1:] + 2 * width, none])
    before[first], after[last] = 3 * width, 3 * width
    return np.concatenate([bins, before, after], 1)


def _chains(lengths: np.ndarray):
    """Chains by falling length: order, and for every step the number of chains that are still going."""
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    going = np.searchsorted(-ordered, -np.arange(1, ordered[0] + 1), side="right") if len(ordered) else np.empty(0, int)
    return order, going


def marginals(odds: np.ndarray, lengths: np.ndarray, edge: np.ndarray):
    """Forward-backward over all chains at once. odds: log-odds of "good" of each line, chains one after another.

    Returns P(good) per line, the expected pairs (2 x 2) per chain summed with the chains' weights left to the caller
    (as an array per chain), and the log normaliser per chain.
    """
    order, going = _chains(lengths)
    starts = np.append(0, np.cumsum(lengths)[:-1])[order]
    n, steps = len(order), len(going)
    node = np.stack([np.zeros_like(odds), odds], 1)
    forward = np.empty((len(odds), 2))
    backward = np.zeros((len(odds), 2))
    if steps:
        forward[starts] = node[starts]
    for t in range(1, steps):
        at = starts[: going[t]] + t
        before = forward[at - 1]
        forward[at] = node[at] + np.logaddexp(before[:, :1] + edge[0], before[:, 1:] + edge[1])
    pairs = np.zeros((n, 2, 2))
    ends = starts + lengths[order] - 1
    norm = np.logaddexp(forward[ends, 0], forward[ends, 1])
    for t in range(steps - 1, 0, -1):
        at = starts[: going[t]] + t
        after = node[at] + backward[at]
        joint = forward[at - 1][:, :, None] + edge[None] + after[:, None, :]
        pairs[: going[t]] += np.exp(joint - norm[: going[t], None, None])
        backward[at - 1] = np.logaddexp(edge[:, 0] + after[:, :1], edge[:, 1] + after[:, 1:])
    total = np.empty(len(odds))
    owner = np.repeat(np.arange(n), lengths)
    place = np.empty(n, int)
    place[order] = np.arange(n)
    total = norm[place[owner]]
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    return good, pairs[place], norm[place]


def fit(x: np.ndarray, lengths: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
    """Maximum likelihood with a quadratic penalty, by Adam over all chains. One label and one weight per chain."""
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    first = np.append(0, np.cumsum(lengths)[:-1])
    columns = _with_neighbours(_binned(x, edges), first, first + lengths - 1)
    line_label, line_weight = np.repeat(label, lengths).astype(float), np.repeat(weight, lengths)
    size = 3 * x.shape[1] * BINS + 1
    theta = np.zeros(size + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((len(lengths), 2, 2))
    seen[np.arange(len(lengths)), label, label] = lengths - 1
    scale = line_weight.sum()
    for step in range(1, STEPS + 1):
        odds = theta[:size][columns].sum(1) + theta[size]
        good, pairs, _ = marginals(odds, lengths, theta[size + 1 :].reshape(2, 2))
        error = line_weight * (line_label - good)
        gradient = np.zeros_like(theta)
        gradient[:size] = np.bincount(columns.ravel(), np.repeat(error, columns.shape[1]), size)
        gradient[size] = error.sum()
        gradient[size + 1 :] = (weight[:, None, None] * (seen - pairs)).sum(0).ravel()
        gradient = gradient / scale - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"edges": edges, "weights": theta[:size], "bias": theta[size], "edge": theta[size + 1 :].reshape(2, 2)}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | float:
    """The fitted field; a constant score where the labels do not allow for one."""

    def pieces(batches):
        for batch in batches:
            rows, sizes, marks, owners = [], [], [], []
            for i, text, label in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist()):
                x = features(lines_of(text))
                starts = range(0, len(x), PIECE)
                for at in starts:
                    rows.append(x[at : at + PIECE].tobytes())
                    sizes.append(len(x[at : at + PIECE]))
                    marks.append(label)
                    owners.append(len(starts))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(sizes, pa.int32()), pa.array(marks, pa.int32()), pa.array(owners, pa.int32())], ["x", "n", "label", "share"])

    found = labelled_sample(docs, labels, "quality", FOLDS, sample)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).over(order), F.lit(0))  # over SAMPLE rows a label
    found = found.withColumn("__before", before).where(F.col("__before") < LINES).select("doc_id", "text", "label")
    got = found.mapInArrow(pieces, "x binary, n int, label int, share int").toPandas()  # bounded: LINES of each label, one document more
    fold = labels.where(F.col("quality").isNotNull() & (crc_fold(labels["doc_id"], FOLDS) != 0))
    counts = {r["q"]: r["count"] for r in fold.groupBy(F.col("quality").cast("int").alias("q")).count().collect()}
    shares = {q: counts.get(q, 0) / max(1, sum(counts.values())) for q in (0, 1)}
    if len(set(got["label"])) < 2:
        return shares[1] if counts else 0.5
    got = got.sort_values(["label", "n", "x"], kind="stable")  # the same order whatever the partitions
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, len(_NAMES))
    label = got["label"].to_numpy(int)
    taken = np.array([(1.0 / got["share"].to_numpy()[label == q]).sum() for q in (0, 1)])
    # Bad documents are the fewer ones; the square root of the shares keeps them from being drowned out.
    weight = (np.sqrt([shares[0], shares[1]]) / taken)[label] / got["share"].to_numpy() * len(got)
    return fit(x, got["n"].to_numpy(int), label, weight)


def score_batch(texts: list[bytes], model: dict | float) -> np.ndarray:
    """Length-weighted mean marginal of every text."""
    if not isinstance(model, dict):
        return np.full(len(texts), float(model))
    cut = [lines_of(t) for t in texts]
    lengths = np.array([len(c) for c in cut])
    x = np.concatenate([features(c) for c in cut])
    first = np.append(0, np.cumsum(lengths)[:-1])
    columns = _with_neighbours(_binned(x, model["edges"]), first, first + lengths - 1)
    good, _, _ = marginals(model["weights"][columns].sum(1) + model["bias"], lengths, model["edge"])
    size = np.array([len(line) for c in cut for line in c], float) + 1e-3
    return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def score(docs: DataFrame, model: dict | float, keep=()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns named in keep."""

    def scored(batches):
        for batch in batches:
            got = np.empty(len(batch))
            texts = batch.column("__text").cast(pa.binary())
            for at in range(0, len(batch), 500):
                part = texts.slice(at, 500).to_pylist()
                got[at : at + len(part)] = score_batch(part, model)
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(got)], [*names, "__score"])

    picked = docs.select("doc_id", *[docs[c].alias(f"__kept_{c}") for c in keep], text_of(docs).alias("__text"))
    out = picked.drop("__text").withColumn("__score", F.lit(0.5)).schema
    made = picked.mapInArrow(scored, out)
    return made.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
        *[F.col(f"__kept_{c}").alias(c) for c in keep if c != "doc_id"],
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
