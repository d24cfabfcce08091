import hashlib
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import common, repeats
from helpers import docs_frame, odd_frame


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    shared = [prose(rng.randint(300, 1500)) for _ in range(6)]
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "ab" * 600, "漢" * 700]
    for _ in range(n):
        parts = [rng.choice([prose(rng.randint(0, 500)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 100) :]]) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    base = prose(3000)
    texts += [" ".join(rng.choice(["a", "bc", "de\n", "f"]) for _ in range(51)), *[(p := "x " * 30 + " ".join(map(str, range(60))) + " y" * 9)] * 2, "other " + p, "m " + p[70:] + " n"]
    texts += [base, base, base[:1000] + "#" + base[1001:], base[5:2000], base[:1500] + prose(10) + base[1500:]]
    return texts


def slow_passages(texts):
    """Words in passages of 51 words, with the white space between them, that another text has; equal texts are different documents."""
    data = [(t or "").encode() for t in texts]
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    owners = {}
    for i, (d, w) in enumerate(zip(data, words)):
        for k in range(len(w) - 50):
            owners.setdefault(d[w[k][0] : w[k + 50][1]], set()).add(i)
    out = []
    for d, w in zip(data, words):
        hit = [False] * len(w)
        for k in range(len(w) - 50):
            if len(owners[d[w[k][0] : w[k + 50][1]]]) > 1:
                hit[k : k + 51] = [True] * 51
        out.append(sum(hit))
    return out


def expected(texts):
    return [(i, *x, n) for i, (x, n) in enumerate(zip(slow(texts, 400), slow_passages(texts)))]


@pytest.mark.parametrize("seed, bucket", [(1, 1 << 20), (2, 3000), (3, 500)])
def test_equals_brute_force(spark, monkeypatch, seed, bucket):
    """Also where buckets are so small that keys are crowded at every level."""
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "CROWDED", bucket)
    monkeypatch.setattr(repeats, "COPIED", 1000 if seed == 2 else 1 << 16)
    levels = []
    step = repeats.piece_marks
    monkeypatch.setattr(repeats, "piece_marks", lambda pieces, secret, level=0, **rest: levels.append(level) or step(pieces, secret, level, **rest))
    texts = corpus(seed)
    got = sorted(tuple(r) for r in repeats.digest(repeats.without_repeats(docs_frame(spark, texts))).collect())
    assert [(g, w) for g, w in zip(got, expected(texts)) if g != w] == [] and len(got) == len(texts)
    assert levels == ([0] if seed == 1 else [0, 1, 2, 3])


def test_copies_give_a_segment_once(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [base] * 40 + [base[:1500] + "#" + base[1501:], "".join(rng.choice("abcdefgh ") for _ in range(900))]
    tables = {}
    write = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    got = sorted(tuple(r) for r in repeats.digest(repeats.without_repeats(docs_frame(spark, texts).repartition(4, "doc_id"))).collect())
    assert got == expected(texts)
    cut = tables["cut-segments"]
    assert 0 < cut.count() == cut.select("key", "whole").distinct().count()


def test_matching_statistics_equal_brute_force():
    rng = random.Random(0)
    for _ in range(30):
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))): 0 for _ in range(rng.randint(1, 6))})
        copies = [rng.choice([1, 2]) for _ in texts]
        got, starts, runs = repeats.matching_statistics(texts, copies)
        suffixes = [(i, c, p, t[p:]) for i, t in enumerate(texts) for c in range(copies[i]) for p in range(len(t))]
        for i, c, p, s in suffixes:
            best = 0
            for j, d, q, o in suffixes:
                if (i, c, p) != (j, d, q):
                    k = 0
                    while k < min(len(s), len(o)) and s[k] == o[k]:
                        k += 1
                    best = max(best, k)
            assert got[starts[i] + p] == best
        assert runs <= 2 * (sum(map(len, texts)) + len(texts))


def thue_morse(order):
    bits = np.zeros(1, np.uint8)
    for _ in range(order):
        bits = np.concatenate([bits, 1 - bits])
    return bits


def test_segments_that_a_polynomial_hash_takes_for_equal(spark):
    """Thue-Morse bits and their complements collide modulo powers of two, whatever the base; nothing of these texts is repeated over 400 bytes."""
    rng = np.random.default_rng(7)
    with np.errstate(over="ignore"):
        grams = [bytes(rng.integers(97, 123, 128, dtype=np.uint8)) for _ in range(20000)]
        hashes = np.array([repeats.substring_hashes(repeats._prefix(g, repeats._BASE), np.array([0]), np.array([128]), repeats._BASE)[0] for g in grams])
    gram = grams[int(hashes.argmin())]  # the least of any window
    noise = [rng.integers(97, 121, 128, dtype=np.uint8) for _ in range(8)]
    texts = []
    for side in (0, 1):
        blocks = [gram + bytes(x + (thue_morse(7) ^ polarity ^ side)) for x, polarity in zip(noise, thue_morse(3))]
        texts.append((b"".join(blocks) + gram).decode())
    prefixes = [repeats._prefix(t.encode(), repeats._BASE) for t in texts]
    assert len({int(repeats.substring_hashes(p, np.array([0]), np.array([len(texts[0])]), repeats._BASE)[0]) for p in prefixes}) == 1
    got = sorted(tuple(r) for r in repeats.digest(repeats.without_repeats(docs_frame(spark, texts))).collect())
    assert got == expected(texts) and got[0][2] == got[1][2] == 0


def test_statistics_against_other_colors():
    rng = random.Random(3)
    for _ in range(40):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 6))]
        colors = [rng.randint(0, 2) for _ in texts]
        symbols = np.array([x + 1 for t in texts for x in [*t, 3]])
        sizes = np.array([len(t) for t in texts])
        stops = np.cumsum(sizes + 1) - 1
        got = repeats.foreign_statistics(symbols, np.repeat(stops, sizes + 1), np.repeat(colors, sizes + 1), 25)
        for t, c, stop in zip(texts, colors, stops):
            for p in range(len(t)):
                best = 0
                for u, d in zip(texts, colors):
                    for q in range(len(u) if c != d else 0):
                        k = 0
                        while k < min(len(t) - p, len(u) - q) and t[p + k] == u[q + k]:
                            k += 1
                        best = max(best, k)
                assert got[stop - len(t) + p] == best


def test_hash_decides_nothing(spark):
    """Segments of one hash whose bytes differ are told, not taken for equal."""
    rows = [(1, 0, 1, None, 10, False, 1, 1, 0, side, data) for side, data in enumerate((b"same", b"same"))] + [(2, 0, 1, None, 10, True, 1, 1, 0, 0, b"once")]
    got = {r["key"]: r["n"] for r in repeats._compared(spark.createDataFrame(rows, repeats.CUT)).collect()}
    assert got == {1: 2, 2: 1}
    with pytest.raises(Exception, match="two segments have one hash"):
        repeats._compared(spark.createDataFrame([(1, 0, 1, None, 10, False, 1, 1, 0, side, data) for side, data in enumerate((b"one", b"two"))], repeats.CUT)).collect()


def shuffles(spark):
    """Shuffle files on this machine's disks."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {os.path.basename(x) for x in blocks.split() if "shuffle_" in x and x.endswith(".data")}


def test_disk_is_given_back_on_the_way(spark, monkeypatch):
    """A table goes when the next one stands, and an execution's shuffle files when it ends, at every level of crowded keys too."""
    monkeypatch.setattr(repeats, "BUCKET", 3000)
    monkeypatch.setattr(repeats, "CROWDED", 3000)
    shared = common.shared_dir(spark).removeprefix("file://")
    tables = lambda: {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    seen, write = [], repeats.written
    before, old, flag = set(os.listdir(shared)), shuffles(spark), spark.conf.get(common._CLEANUP, None)
    monkeypatch.setattr(repeats, "written", lambda df, label: seen.append((label, tables())) or write(df, label))
    texts = corpus(6)
    found = repeats.without_repeats(docs_frame(spark, texts))
    for label, there in seen:
        assert "flagged" not in there if label != "cut-segments" else "flagged" in there
        assert "segments" not in there if label != "candidates" else "segments" in there
    assert [label for label, _ in seen].count("segments") == 4 and tables() == {"copied", "candidates", "cut-segments", "segment-marks"}
    until = time.time() + 20  # files go in the background
    while shuffles(spark) - old and time.time() < until:
        time.sleep(0.2)
    assert shuffles(spark) - old == set() and spark.conf.get(common._CLEANUP, None) == flag
    assert sorted(tuple(r) for r in repeats.digest(found).collect()) == expected(texts)
    assert sorted(tuple(r) for r in repeats.digest(found).collect()) == expected(texts)  # the rows can be asked for again


def test_scratch_inside_scratch(spark):
    """The inner one deletes the tables of its labels; the outer one those that the inner one left."""
    path = lambda df: os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    with common.scratch(spark) as outer:
        with common.scratch(spark, only=("gone",)):
            gone, left = (path(common.written(spark.range(3), label)) for label in ("gone", "left-over"))
            assert os.path.isdir(gone) and os.path.isdir(left)
        assert not os.path.isdir(gone) and os.path.isdir(left)
        last = path(common.written(spark.range(3), "last"))
        assert len(outer) == 2
    assert not os.path.isdir(left) and not os.path.isdir(last)


def test_short_texts_together(monkeypatch):
    """Texts taken together give the segments they give alone, each window in one of them; an inner key may be told of too many."""
    texts = [(t or "").encode() for t in corpus(4)]
    alone = {(i, *map(int, x[:4])): bool(x[4]) for i, t in enumerate(texts) for x in zip(*repeats.segments(t, secret=b"s"))}
    for gathered in (1 << 18, 3000):
        monkeypatch.setattr(repeats, "GATHERED", gathered)
        rows = [tuple(int(v) for v in x) for x in zip(*repeats.segments_of(texts, secret=b"s"))]
        together = {x[:5]: bool(x[5]) for x in rows}
        assert together.keys() == alone.keys() and len(rows) == len(together)
        assert all(together[x] for x, inner in alone.items() if inner)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 123, 6000, dtype=np.uint8))
    key, whole, first, size, inner = repeats.segments(data, kinds=(0,))
    assert first[0] == 0 and (first[1:] == (first + size - 399)[:-1]).all() and first[-1] + size[-1] == len(data)
    words = b" ".join(bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(2000))
    found = list(zip(*repeats.segments(words)[2:4], repeats.segments(words)[0] & 1))
    spans = [words[s : s + n] for s, n, kind in found if kind]
    # Every run of 51 words is in exactly one segment.
    assert sum(len(x.split()) - 50 for x in spans) == 2000 - 50 and all(x == x.strip() for x in spans)
    monkeypatch.setattr(repeats, "LONGEST", 50)
    key, whole, first, size, inner = repeats.segments(b"z" * 3000, kinds=(0,))
    assert size.max() <= 449 and (size - 399).sum() == 2601 and inner.all()


def test_odd_rows(spark):
    odd = odd_frame(spark)
    rows = odd.collect()
    got = sorted((tuple(r) for r in repeats.digest(repeats.without_repeats(odd)).collect()), key=repr)
    texts = [r["text"] for r in rows]
    assert got == sorted(((r["doc_id"], *x[1:]) for r, x in zip(rows, expected(texts))), key=repr)
    assert repeats.without_repeats(odd.limit(0)).count() == 0
