import random
import re

import pytest
import xxhash

from chronoloom.llm import simhash
from helpers import docs_frame, odd_frame


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(ids))]


@pytest.mark.parametrize("small", [64, 2])
def test_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(small)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", " \t\n", "one", "Two words", "TWO\x0bwords", "é\x00 x y z", "a b c a b c a b c"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs_frame(spark, texts)).collect())
    fps = [slow_fingerprint(t) for t in texts]
    assert got == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, slow_components(range(len(texts)), fps)))]


def test_chains_of_links_and_crowded_files(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 3)
    rng = random.Random(9)
    fps = {0}
    for _ in range(40):  # long chains of two-bit steps, some around the ring's seam
        f = rng.getrandbits(64)
        for _ in range(15):
            fps.add(f)
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["class_fp"]: r["component_id"] for r in simhash.classes(rows).collect()}
    assert [got[f] for f in signed] == slow_components(range(len(fps)), fps)


def test_hubs_and_common_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "COMMON", 3)  # a fingerprint of a third of all rows
    hub = (1 << 63) | 12345
    fps = [hub] * 60 + [hub ^ (1 << i) for i in range(64)] + [hub ^ (1 << i) ^ (1 << (i + 7)) for i in range(50)] + [random.Random(i).getrandbits(64) for i in range(6)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    rows = spark.createDataFrame([(1000 - i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash._placed(rows, simhash.classes(rows)).collect()}
    ids = [1000 - i for i in range(len(fps))]
    assert [got[i] for i in ids] == slow_components(ids, fps)


def test_odd_rows(spark):
    odd = odd_frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=repr)
    fps = [slow_fingerprint(t) for _, t in rows]
    assert got == sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, slow_components([d for d, _ in rows], fps))), key=repr)
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.deduplicated(odd.limit(0)).count() == 0
