"""Toxicity: cumulative-link ordinal regression over sparse word features.

Severity has four grades. Labels only tell clean from toxic, so the training grades are derived: a word's
evidence is its log-odds ratio between toxic and clean training documents; among toxic documents, the evidence of
their words (positive parts, words of at least ``MIN_DF`` training documents) is cut at its tertiles into grades 1, 2 and 3.

The model shares one weight per word across the ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k) with
theta_0 < theta_1 < theta_2. Features are hashed lower-case words (letters only) of the whole text and their first four to six letters, present or not. The
expected severity is the sum of the three probabilities; the score is P(grade > 0); a document counts as toxic from ``THRESHOLD`` on.

Fitting uses at most ``SAMPLE`` documents of each label (a documented bound) and none of fold 0; scoring is one narrow pass.

Defined results: null, empty and wordless texts have no features and get the intercepts' probabilities; without labels
of both kinds the score is the share of toxic labels; a null doc_id has held_out null; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, text_of

FOLDS = 5
SAMPLE = 4000
BITS = 20
MIN_DF = 5
BEGINNINGS = (4, 5, 6)
GRADES = 3
STEPS = 150
SHRINK = 60
PENALTY = 2e-3
THRESHOLD = 0.4

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def words(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.translate(_LOWER)))


def hashed(text: bytes) -> np.ndarray:
    """Distinct feature numbers of a text: its words, and the beginnings of words as inflected forms share them."""
    found = words(text)
    text_features = found | {b"<" + w.decode(errors="replace")[:n].encode() for w in found for n in BEGINNINGS if len(w) > n}
    return np.unique(np.fromiter(map(zlib.crc32, text_features), np.int64, len(text_features)) & ((1 << BITS) - 1))


def grades(flat: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Derived training grades: 0 for clean documents, tertiles of evidence for toxic ones."""
    hot = np.bincount(flat, toxic[owner], 1 << BITS)
    every = np.bincount(flat, minlength=1 << BITS)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    odds = np.log((hot + 0.5) / (n1 + 1)) - np.log((every - hot + 0.5) / (n0 + 1))
    odds = np.where(every >= MIN_DF, np.maximum(odds, 0), 0)
    evidence = np.bincount(owner, odds[flat], len(toxic))
    cuts = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, side="right"), 0)


def fit(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> dict:
    """Weights and thresholds by Adam on the ordinal likelihood, with a quadratic penalty."""
    flat = np.concatenate(rows).astype(np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    frequent = (np.bincount(flat, minlength=1 << BITS) >= MIN_DF)[flat]
    flat, owner = flat[frequent], owner[frequent]
    del frequent
    y = grades(flat, owner, toxic)
    used = np.unique(flat)
    column = np.searchsorted(used, flat).astype(np.int32)
    del flat
    n, k = len(rows), len(used)
    df = np.bincount(column, minlength=k)
    # Sums over documents and over features by sorted runs, without wide copies.
    sizes = np.bincount(owner, minlength=n)
    filled = np.flatnonzero(sizes)
    row_starts = (np.cumsum(sizes) - sizes)[filled]
    owner_by_column = owner[np.argsort(column, kind="stable")]
    column_starts = np.cumsum(df) - df
    del owner
    size = np.sqrt(df / (df + SHRINK))  # a rare word's weight is held back: it is easily learned by heart
    theta = np.zeros(k + GRADES)  # weights, first threshold, logs of the steps to the next ones
    theta[k] = 2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        cuts = theta[k] + np.append(0, np.cumsum(np.exp(theta[k + 1 :])))
        z = np.zeros(n)
        z[filled] = np.add.reduceat((size * theta[:k]).astype(np.float32)[column], row_starts)
        above = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - cuts), np.zeros((n, 1))], 1)  # P(y >= g)
        p = np.maximum(above[np.arange(n), y] - above[np.arange(n), y + 1], 1e-12)
        slope = above * (1 - above)
        upper, lower = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        dz = weight * (upper - lower) / p
        by_cut = np.zeros((n, GRADES + 2))
        by_cut[np.arange(n), y] -= weight * upper / p
        by_cut[np.arange(n), y + 1] += weight * lower / p
        dcut = by_cut[:, 1:-1].sum(0)
        gradient = np.concatenate([size * np.add.reduceat(dz.astype(np.float32)[owner_by_column], column_starts), [dcut.sum()], np.exp(theta[k + 1 :]) * np.cumsum(dcut[::-1])[::-1][1:]]) / weight.sum()
        gradient[:k] -= PENALTY * theta[:k]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"used": used, "weights": size * theta[:k], "cuts": theta[k] + np.append(0, np.cumsum(np.exp(theta[k + 1 :])))}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | float:
    def cut(batches):
        for batch in batches:
            rows = [hashed(t).astype(np.int32).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("label")], ["doc_id", "x", "label"])

    found = labelled_sample(docs, labels, "toxic", FOLDS, sample)
    got = found.mapInArrow(cut, "doc_id long, x binary, label int").toPandas().sort_values(["label", "doc_id", "x"], kind="stable")
    fold = labels.where(F.col("toxic").isNotNull() & (crc_fold(labels["doc_id"], FOLDS) != 0))
    counts = {r["t"]: r["count"] for r in fold.groupBy(F.col("toxic").cast("int").alias("t")).count().collect()}
    toxic = got["label"].to_numpy(int)
    if len(set(toxic)) < 2:
        return counts.get(1, 0) / max(1, sum(counts.values()))
    shares = np.array([counts[0], counts[1]]) / (counts[0] + counts[1])
    weight = (np.sqrt(shares) / np.bincount(toxic))[toxic] * len(toxic)
    return fit([np.frombuffer(x, np.int32) for x in got["x"]], toxic, weight)


def score_batch(texts: list[bytes], model: dict | float, table: np.ndarray | None) -> np.ndarray:
    """P(grade > k) for every text, one column per threshold."""
    if not isinstance(model, dict):
        return np.repeat([[float(model), 0.0, 0.0]], len(texts), 0)
    z = np.array([table[hashed(t)].sum() for t in texts])
    return 1 / (1 + np.exp(-np.clip(z[:, None] - model["cuts"], -500, 500)))


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    """doc_id, held_out, score, expected_severity, grade (the likeliest), predicted."""

    def scored(batches):
        table = None
        if isinstance(model, dict):
            table = np.zeros(1 << BITS)
            table[model["used"]] = model["weights"]
        for batch in batches:
            above = score_batch(batch.column("text").cast(pa.binary()).to_pylist(), model, table)
            each = np.concatenate([np.ones((len(above), 1)), above], 1) - np.concatenate([above, np.zeros((len(above), 1))], 1)
            columns = [batch.column("doc_id"), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "expected_severity", "grade"])

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    made = picked.mapInArrow(scored, "doc_id long, score double, expected_severity double, grade int")
    return made.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "expected_severity", "grade", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
