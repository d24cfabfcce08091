import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import suffix_tree
from helpers import docs_frame, odd_frame


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def base(texts):
    train = Counter(t for i, x in texts if i is not None and zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    return n, [(i, len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for i, x in texts]


@pytest.mark.parametrize("frequent", [5_000_000, 30])
def test_base_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    rng = random.Random(2)
    texts = [None, "", "A a\x0bÉ"] + [" ".join(rng.choice(["the", "Of", "rare%d" % rng.randrange(300), "ü"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    n, want = base(list(enumerate(texts)))
    got = sorted(suffix_tree.score(docs_frame(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for r, (i, size, known, score) in zip(got, want, strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, size, known, n)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9, abs_tol=1e-6)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r["score"] < 0


def test_states_are_longest_suffixes_and_distributions_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "P_MIN", 2e-3)
    monkeypatch.setattr(suffix_tree, "DIVERGENCE", 1e-4)
    rng = random.Random(7)
    texts = [b" ".join(rng.choice([b"abra", b"cadabra", b"bar", b"xa"]) for _ in range(30)) + b"\n" for _ in range(40)]
    keys, counts = suffix_tree._grams(texts)
    grams = spark.createDataFrame(list(zip(keys.astype(np.int64).tolist(), counts.tolist())), "key long, n long")
    rows = suffix_tree.contexts(grams, int(counts.sum()))
    step, logs, column = suffix_tree.automaton(rows)
    assert np.allclose((10.0 ** logs[:, column].astype(float)).sum(1), 1, atol=1e-4)
    states = [(r["d"], r["ctx"], r["kept"]) for r in rows.to_pylist()]
    names = sorted({(d, c) for d, c, _ in states})
    kept = {(d, c) for d, c, k in states if k}
    assert any(d == suffix_tree.DEPTH for d, _ in kept) and len(names) > 10
    # Brute force: look for the longest retained suffix at every position.
    number = {n: i for i, n in enumerate(names)}
    for t in texts[:5]:
        padded, total = b" " * suffix_tree.DEPTH + t, 0.0
        for at in range(suffix_tree.DEPTH, len(padded)):
            for d in range(suffix_tree.DEPTH, -1, -1):
                name = (d, int.from_bytes(padded[at - d : at], "big"))
                if name in kept or d == 0:
                    total += logs[number[name], column[padded[at]]]
                    break
        assert math.isclose(suffix_tree.walk([t], step, logs, column)[0], total, rel_tol=1e-5)


def test_pieces_do_not_matter(monkeypatch):
    rng = np.random.default_rng(0)
    step, logs = np.zeros((1, 256), np.int32), rng.normal(size=(1, 256)).astype(np.float32)
    texts = [b"x" * 10, b"abc" * 700, b"\n"]
    column = np.arange(256, dtype=np.uint8)
    whole = suffix_tree.walk(texts, step, logs, column)
    monkeypatch.setattr(suffix_tree, "PIECE", 7)
    assert np.allclose(whole, suffix_tree.walk(texts, step, logs, column), rtol=1e-6)


def test_model_beats_base_on_held_out_texts(spark):
    got = suffix_tree.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    print(got)
    assert got["s"] > got["b"]


def test_odd_rows(spark):
    odd = odd_frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    n, want = base(rows)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4), r["train_tokens"]) for r in suffix_tree.score(odd).collect()), key=repr)
    assert got == sorted(((i, k, known, round(s, 4), n) for i, k, known, s in want), key=repr)
    texts = {}
    for r in suffix_tree.score(docs_frame(spark, ["same text", "same text", "other"])).collect():
        texts.setdefault(r["n_tokens"], set()).add(r["score"])
    assert len(texts[3]) == 1  # equal texts, equal scores
    assert suffix_tree.score(odd.limit(0)).count() == 0
    assert suffix_tree.score(docs_frame(spark, ["only"]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")).first()["train_tokens"] == 0
