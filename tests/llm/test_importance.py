import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from chronoloom.llm import importance
from helpers import docs_frame, odd_frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(docs, targets, n=1, buckets=10_000, percent=10, min_words=20):
    """The contract over whole lists; docs: (doc_id, text)."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = lambda t: WORD.findall(lower(t))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in side for f in runs(cut(text))) for side in ([d[1] for d in docs], targets))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        words = cut(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in runs(words))
        rows.append([i, len(runs(words)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Éa", "漢字", "don't", "A1", "x_y", "😀b"]
    make = lambda most: rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, most)))
    return [None, "", *(make(60) for _ in range(n))], [make(20) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("n, nodes, ranked", [(1, 200_000, 1 << 20), (1, 10, 7), (3, 50, 40)])
def test_equals_brute_force(spark, monkeypatch, n, nodes, ranked):
    """Also where tries start anew all the time, and where the draw is dealt to many ranges."""
    monkeypatch.setattr(importance, "NODES", nodes)
    monkeypatch.setattr(importance, "RANKED", ranked)
    texts, targets = corpus()
    target = spark.createDataFrame([(str(i), t) for i, t in enumerate(targets)], "item_id string, text string")
    got = importance.resample(docs_frame(spark, texts).repartition(5), target, n=n, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow(list(enumerate(texts)), targets, n, percent=30)


def test_repeated_ids_tie(spark, monkeypatch):
    """A third of all rows are one row; ranks stay 1, 2, 3, ..."""
    monkeypatch.setattr(importance, "RANKED", 20)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 100 + [(i, text + f" v{i}") for i in range(200)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string"), percent=50).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow(rows, ["w1 w2"], percent=50)


def test_trie_states_are_checksums():
    trie = importance.Trie(lambda state: state)
    words = "ab c ab c d é".encode().split()
    found = Counter(node.state for node in trie.paths(words, 3))
    assert found == Counter(crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert trie.size == len(found) == sum(1 for _ in trie.nodes())


def test_odd_rows(spark):
    odd = odd_frame(spark)
    target = spark.createDataFrame([("one two same text",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in importance.resample(odd, target, percent=60).collect()), key=repr)
    assert got == slow(rows, ["one two same text"], percent=60)
    assert sorted((tuple(r) for r in importance.resample(odd, target.limit(0)).collect()), key=repr) == slow(rows, [])
    assert importance.resample(odd.limit(0), target).count() == 0
