import hashlib
import random
import re

from chronoloom.llm import licenses, mixing, secrets
from helpers import DOC, docs_frame, odd_frame

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["password=", "TOKEN : '", "api_key=\"", "AKIA", "AKIAAKIA", "deadbeef" * 3, "😀", "é ", "abc", " ", "\n", "0123456789ABCDEF", "secret=ab", "token:token:abcdef", "-"]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs_frame(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        named = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest(), (t, named, got[i])
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(named.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_battery_finds_random_strings_and_leaves_identifiers(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["see " + "".join(rng.choice(alphabet) for _ in range(60)) + " here" for _ in range(50)]
    plain = ["see the_quick_brown_fox_jumps_over_2024_the_lazy_dog_again_and_again_1 here", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1", "the word donaudampfschifffahrtsgesellschaft"]
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(docs_frame(spark, texts + plain))).collect()}
    assert sum(got[i] == "random:4:64" for i in range(50)) >= 40
    assert [got[50 + i] for i in range(3)] == ["", "", ""]


def test_redaction(spark):
    df = docs_frame(spark, ["a password=hunter22 b", "clean", "token=abcdef0123456789abcdef0123 é"])
    got = {r["doc_id"]: r["t"] for r in secrets.scan(df, keep=("text",)).select("doc_id", secrets.redacted(__import__("pyspark").sql.functions.col("text"), __import__("pyspark").sql.functions.col("spans")).alias("t")).collect()}
    assert got == {0: "a [secret] b", 1: "clean", 2: "[secret] é"}


def test_licences(spark):
    notice = dict(licenses.TEMPLATES)["MIT-notice"]
    far = notice.replace("persons to whom", "people to which", 1)
    texts = ["w " * 50 + notice + " z" * 80, "a b " + far, "Released under\nthe MIT License. ok", "Licensed under CC BY-NC 4.0", "nothing to see here at all", None]
    got = {r["doc_id"]: (r["licenses"], r["n_licenses"]) for r in licenses.scan(docs_frame(spark, texts)).collect()}
    assert got == {0: ("MIT-notice", 1), 1: ("MIT-notice", 1), 2: ("MIT", 1), 3: ("CC-BY-NC-4.0", 1), 4: ("", 0), 5: ("", 0)}
    assert licenses.collision_probability(0.45) > 0.9999
    assert licenses.scan(docs_frame(spark, texts), templates=()).count() == 6


def test_licence_gates_lose_nothing(spark, monkeypatch):
    notices = [t for _, t in licenses.TEMPLATES]
    rng = random.Random(7)
    texts = [" ".join(rng.choice([n, n[: len(n) // 2], "x y z", "you may not use this file except", "software license"]) for n in rng.sample(notices, 3)) for _ in range(30)]
    every = lambda: sorted(tuple(r) for r in licenses.scan(docs_frame(spark, texts)).collect())
    got = every()
    monkeypatch.setattr(licenses, "GATE_LIMIT", 0)
    assert every() == got and any(r[1] for r in got)
    told = set(licenses.telling_words([r["shingles"] for r in licenses.template_frame(spark).collect()]))
    assert all(told & set(s.split(" ")) for r in licenses.template_frame(spark).collect() for s in r["shingles"])


def test_odd_rows(spark):
    odd = odd_frame(spark)
    rows = odd.collect()
    n = len(rows)
    found = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secrets.digest(secrets.scan(odd)).collect()), key=repr)
    assert found == sorted(((r["doc_id"], 0, 0, 0, "") for r in rows), key=repr)
    assert sorted((tuple(r) for r in licenses.scan(odd).collect()), key=repr) == sorted(((r["doc_id"], 0, "", None) for r in rows), key=repr)
    sizes = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in rows]
    mixed = mixing.mix(odd, keep=("source",)).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in mixed), key=repr) == sorted(sizes, key=repr)
    for source in {r["source"] for r in mixed}:
        mine = [r for r in mixed if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sum(r["size"] for r in mine)} and abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    for f in (lambda d: secrets.digest(secrets.scan(d)), licenses.scan, mixing.mix):
        assert f(odd.limit(0)).count() == 0


def test_mixing_fills_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 50), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, DOC), keep=("source",)).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 and target <= 3 * size
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6 * total


def test_mixing_clamps(spark):
    rows = [(i, "w " * 10, "en", s, 0) for i, s in enumerate(["a"] * 20 + ["b"] * 2 + ["c"] * 1)]
    by = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(spark.createDataFrame(rows, DOC), keep=("source",)).collect()}
    assert by == {"a": (140.0, 200), "b": (60.0, 20), "c": (30.0, 10)}


def test_very_many_matches(spark):
    text = "token=abcdef " * 50_000
    row = secrets.digest(secrets.scan(docs_frame(spark, [text]))).first()
    assert row["n_assign"] == 50_000 and row["spans"].endswith(f"assign:{len(text) - 13}:{len(text) - 1}")
