import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import infilling
from helpers import docs_frame, odd_frame


def slow(doc_id, text, seed="1"):
    """The contract, character by character."""
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, n, form, None if plain else a, None if plain else b - a, sha(out), sha(text))


def texts():
    rng = random.Random(3)
    pieces = ["a", "é", "漢", "😀", " ", "\n", "<", "P>", "<S", ">", "<M", "word "]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [None, "", "<P>", "a <M> b", "<S", "<<P", "é" * 5000, *made, *made[:5]]


@pytest.mark.parametrize("chunk", [1, 3, 64, infilling.CHUNK])
def test_equals_brute_force(spark, chunk):
    """Code points are cut by chunk borders, too."""
    given = texts()
    got = sorted(tuple(r) for r in infilling.digest(infilling.transform(docs_frame(spark, given), chunk=chunk)).collect())
    assert got == [slow(i, t) for i, t in enumerate(given)]
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_restoring(spark):
    given = texts()
    made = infilling.transform(docs_frame(spark, given)).select("*", infilling.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r["back"] == (given[r["doc_id"]] or "") for r in made)
    assert all(r["output"].count("<M>") == 1 for r in made if r["form"] != "plain")


@pytest.mark.parametrize("unit, starts", [("word", r"(?<![^ \t-\r])[^ \t-\r]"), ("line", r"(?s)(?:(?<=\n)|\A).")])
def test_other_units(unit, starts):
    rng = random.Random(unit)
    for size in (1, 2, 7, 1000):
        for _ in range(60):
            text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 40)))
            data, begins = np.frombuffer(text.encode(), np.uint8), infilling.UNITS[unit]
            places = [m.start() for m in re.finditer(starts, text)]
            counts = infilling.unit_counts(data, begins, size)
            assert counts.sum() == len(places)
            ranks = range(len(places) + 1)
            want = [0 if r == 0 else len(text) if r == len(places) else places[r] for r in ranks]
            assert infilling.cut_bytes(data, counts, ranks, begins, size) == want


def test_words_and_lines_through_spark(spark):
    given = ["one two  three\nfour", "a\nb\nc\n", "  lead", "", None]
    for unit, n in (("word", [4, 3, 1, 0, 0]), ("line", [2, 3, 1, 0, 0])):
        made = infilling.transform(docs_frame(spark, given), unit=unit, fim_percent=100)
        rows = sorted(made.select("doc_id", "n", infilling.restored(made["output"], made["form"]).alias("back")).collect())
        assert [(r["n"], r["back"]) for r in rows] == [(k, t or "") for k, t in zip(n, given)]


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    seen = []
    begins = lambda before, after: seen.append(len(after)) or infilling.UNITS["char"](before, after)
    data = np.frombuffer(b"x" * 1000, np.uint8)
    counts = infilling.unit_counts(data, begins, 100)
    assert seen == [100] * 10
    del seen[:]
    assert infilling.cut_bytes(data, counts, (120, 950), begins, 100) == [120, 950]
    assert len(seen) == 2 and max(seen) <= 101


def test_odd_rows(spark):
    odd = odd_frame(spark)
    got = sorted((tuple(r) for r in infilling.digest(infilling.transform(odd)).collect()), key=repr)
    assert got == sorted((slow(r["doc_id"], r["text"]) for r in odd.collect()), key=repr)
    assert infilling.transform(odd.limit(0)).count() == 0
