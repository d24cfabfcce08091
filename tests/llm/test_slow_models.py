"""The two classifiers' scores against slow versions, text by text."""

import math
import random
import re
import zlib

import numpy as np

from chronoloom.llm import quality, toxicity
from helpers import docs_frame, odd_frame


def lower(data):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma.", "DELTA!", "1234", "$$$", "zürich", "漢字", "the", "of", "verylongwordindeed", "bad", "worse", "worst"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
    return ["\n".join(rng.choice([line(), "", "same line again and again, word by word, to the end.", line()]) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def slow_lines(text):
    lines = text.split(b"\n")
    blank = b" \t\r\x0b\x0c"
    every, rows = [w for line in lines for w in line.split()], []
    for i, line in enumerate(lines):
        words, n = line.split(), len(line)
        solid = sum(b not in blank for b in line)
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in line)
        upper, digits, marks = sum(65 <= b <= 90 for b in line), sum(48 <= b <= 57 for b in line), sum(b in b".,;:!?'\"()-" for b in line)
        whole = max(1, solid)
        rows.append([
            math.log1p(n), math.log1p(len(words)), upper / max(1, letters), digits / whole, marks / whole, (solid - letters - digits - marks) / whole,
            len(set(words)) / max(1, len(words)), solid / max(1, len(words)), len(zlib.compress(line, 1)) / n if n > 40 else 1.0,
            math.log(lines.count(line)) if n else 0.0, float(i > 0 and lines[i - 1] == line), float(line[-1:] in (b".", b"!", b"?")),
            len(set(every)) / max(1, len(every)) ** 0.8, len(zlib.compress(text, 1)) / len(text) if sum(map(len, lines)) > 40 else 1.0,
        ])
    return lines, np.array(rows, np.float32)


def slow_quality(text, model):
    lines, x = slow_lines(text)
    width = x.shape[1] * quality.BINS
    bins = [[int(np.searchsorted(model["edges"][j], row[j], side="right")) + j * quality.BINS for j in range(x.shape[1])] for row in x]
    w, none = model["weights"], 3 * width
    odds = []
    for i, own in enumerate(bins):
        before = [b + width for b in bins[i - 1]] if i else [none] * x.shape[1]
        after = [b + 2 * width for b in bins[i + 1]] if i + 1 < len(bins) else [none] * x.shape[1]
        odds.append(sum(w[c] for c in own + before + after) + model["bias"])
    # Forward and backward sums of one chain, scaled at every line.
    edge = np.exp(model["edge"])
    node = [np.exp(np.array([0.0, o]) - max(0.0, o)) for o in odds]
    forward, backward = [node[0] / node[0].sum()], [np.ones(2)]
    for v in node[1:]:
        f = v * (forward[-1] @ edge)
        forward.append(f / f.sum())
    for v in node[:0:-1]:
        b = edge @ (v * backward[-1])
        backward.append(b / b.sum())
    good = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1])]
    size = [len(line) + 1e-3 for line in lines]
    return sum(g * s for g, s in zip(good, size)) / sum(size)


def labelled(spark):
    texts = prose(1, 120)
    texts = [t + "\nsecret recipe of quality, all of it, every day." * 3 if i % 3 == 0 else t + " worst bad bad" * (i % 5) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 > 2)) for i in range(120)], "doc_id long, quality int, toxic int")


def test_quality_equals_slow_version(spark):
    texts, labels = labelled(spark)
    docs = docs_frame(spark, texts).selectExpr("*", "'c' AS label", "'d' AS digest", "1 AS predicted")
    model = quality.train(docs, labels)
    every = docs.select("doc_id", "text").union(odd_frame(spark, extra=False).selectExpr("doc_id + 1000", "text"))
    rows = [(r["doc_id"], slow_quality((r["text"] or "").encode(), model)) for r in every.collect()]
    got = sorted((r["doc_id"] or -1, r["score"], r["predicted"]) for r in quality.score(every, model).collect())
    for (i, score), (j, found, predicted) in zip(sorted((i or -1, s) for i, s in rows), got):
        assert i == j and abs(score - found) < 1e-5 and predicted == int(found >= 0.3)


def test_training_takes_whole_documents(spark, monkeypatch):
    texts, labels = labelled(spark)
    docs = docs_frame(spark, ["a line of text\n" * 3000 + t for t in texts[:6]] + texts[6:])
    whole = quality.train(docs, labels)
    monkeypatch.setattr(quality, "LINES", 1)  # one document of each label, still whole
    small = quality.train(docs, labels)
    assert isinstance(small, dict) and not np.allclose(whole["weights"], small["weights"])


def slow_toxicity(text, model):
    found = set(re.findall(rb"[a-z\x80-\xff]+", lower(text)))
    features = found | {b"<" + w.decode(errors="replace")[:n].encode() for w in found for n in (4, 5, 6) if len(w) > n}
    weights = dict(zip(model["used"].tolist(), model["weights"].tolist()))
    z = sum(weights.get(f, 0.0) for f in {zlib.crc32(f) % (1 << toxicity.BITS) for f in features})
    above = [1 / (1 + math.exp(c - z)) for c in model["cuts"]]
    each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return above[0], sum(above), each.index(max(each))


def test_toxicity_equals_slow_version(spark):
    texts, labels = labelled(spark)
    docs = docs_frame(spark, texts).selectExpr("*", "'c' AS label", "'d' AS digest", "1 AS grade")
    model = toxicity.train(docs, labels)
    every = docs.select("doc_id", "text").union(odd_frame(spark, extra=False).selectExpr("doc_id + 1000", "text"))
    want = sorted((r["doc_id"] or -1, *slow_toxicity((r["text"] or "").encode(), model)) for r in every.collect())
    got = sorted((r["doc_id"] or -1, r["score"], r["expected_severity"], r["grade"], r["predicted"]) for r in toxicity.score(every, model).collect())
    for (i, score, severity, grade), (j, s, e, g, predicted) in zip(want, got):
        assert i == j and abs(score - s) < 1e-9 and abs(severity - e) < 1e-9 and grade == g and predicted == int(s >= toxicity.THRESHOLD)


def objective(rows, y, weight, model, size):
    """Weighted log-likelihood per unit of weight less the penalty, document by document."""
    weights = dict(zip(model["used"].tolist(), model["weights"].tolist()))
    total = 0.0
    for r, grade, w in zip(rows, y, weight):
        z = sum(weights.get(f, 0.0) for f in r.tolist())
        above = [1.0, *(1 / (1 + math.exp(c - z)) for c in model["cuts"]), 0.0]
        total += w * math.log(max(1e-12, above[grade] - above[grade + 1]))
    return total / sum(weight) - toxicity.PENALTY / 2 * float(((model["weights"] / size) ** 2).sum())


def test_fit_is_near_the_likelihoods_maximum(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 1500)
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(100, 140, 10), rng.integers(0, 12, k))) for k in rng.integers(0, 8, 150)]
    toxic = np.array([int((r < 100).sum() > 2) for r in rows])
    weight = np.where(toxic == 1, 1.5, 1.0)
    model = toxicity.fit(rows, toxic, weight)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(150), [len(r) for r in rows])
    y = toxicity.grades(flat, owner, toxic)
    df = np.array([sum(f in r for r in rows) for f in model["used"]])
    size = np.sqrt(df / (df + toxicity.SHRINK))
    best = objective(rows, y, weight, model, size)
    for step in (0.2, -0.2):
        for at in range(0, len(model["used"]), 5):
            moved = model | {"weights": model["weights"] + step * size * (np.arange(len(size)) == at)}
            assert objective(rows, y, weight, moved, size) <= best + 1e-4
        for cut in range(3):
            moved = model | {"cuts": model["cuts"] + step * (np.arange(3) == cut)}
            assert objective(rows, y, weight, moved, size) <= best + 1e-4
