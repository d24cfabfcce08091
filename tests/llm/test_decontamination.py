import hashlib
import random
import re

import pytest

from chronoloom.llm import decontamination
from helpers import docs_frame, odd_frame


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    windows = []
    for name, text in items:
        w = words(text)
        if w:
            windows += [(None if name is None else str(name), w[i : i + 13]) for i in range(max(1, len(w) - 12))]
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for name, phrase in windows:
            for i in range(len(w) - len(phrase) + 1):
                if w[i : i + len(phrase)] == phrase:
                    hit.update(range(i, i + len(phrase)))
                    names.add(name)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, shard", [(10**6, 10**6), (40, 60)])
def test_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    rng = random.Random(4)
    letters = ["a", "B", "cé", "d4", "漢"]
    items = [(i, rng.choice([" ", ", ", "-"]).join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)]
    items += [(90, None), (91, ""), (None, "a b c"), (92, items[3][1])]
    texts = [None, "", "...", "a"] + [" ".join(rng.choice([*letters, rng.choice(items)[1] or "x", "zz " * rng.randint(1, 40)]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    docs = docs_frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontamination.digest(decontamination.match(docs, bench)).collect()), key=repr)
    assert got == slow(list(enumerate(texts)), items)


def test_odd_rows_and_proximity(spark):
    odd = odd_frame(spark)
    bench = spark.createDataFrame([(1, "same text here to repeat"), (2, "one"), (3, "repeat to here the text")], "item_id long, text string")
    got = decontamination.match(odd, bench)
    assert sorted((tuple(r)[:6] for r in decontamination.digest(got).collect()), key=repr) == slow([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "same text here to repeat"), (2, "one"), (3, "repeat to here the text")])
    assert {r["doc_id"]: r["near_items"] for r in got.collect() if r["near_items"]} == {"3": ["2"], "6": ["1", "3"], "7": ["1", "3"]}
    # Every exact match is a proximity match too, also of items whose rare words are far apart or that have one word.
    assert all(set(r["items"]) <= set(r["near_items"]) for r in got.collect())
    far = spark.createDataFrame([(7, "rareone " + "filler text of no weight " * 10 + "raretwo rarethree rarefour rarefive")], "item_id long, text string")
    copy = docs_frame(spark, [far.first()["text"], "filler text of no weight " * 3])
    assert [r["near_items"] for r in sorted(decontamination.match(copy, far).collect(), key=lambda r: r["doc_id"])][0] == ["7"]
    assert decontamination.match(odd.limit(0), bench).count() == 0
    assert decontamination.digest(decontamination.match(odd, bench.limit(0))).where("contaminated").count() == 0
