import random
import re

import corpus_pipeline
from chronoloom.llm import quality
from helpers import DOC, ODD
from test_decontamination import slow as slow_decontamination
from test_native import base_spans
from test_simhash import slow_components, slow_fingerprint
from test_slow_models import slow_quality


def tables(spark, tmp_path, extra):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: ".\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n))
    junk = lambda n: "\n".join(" ".join([rng.choice(["$$$", "###", "%%%"])] * 9) for _ in range(n))
    items = [(i, prose(2)) for i in range(4)] + [(9, None)]
    texts = [prose(rng.randint(1, 20)) for _ in range(40)] + [junk(rng.randint(1, 9)) for _ in range(40)] + ODD
    texts += [t + " tail" for t in texts[:5]] + [t for t in texts[5:9]]
    texts += [items[0][1] + "\n" + prose(1), prose(3) + items[1][1], prose(60) + "\n" + items[2][1].split(".")[0]]
    texts += [prose(2) + " password=abcdef123 " + prose(1), "token: " + "ab12" * 8]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)] + [(None, None, None, None, None), (0, texts[0], "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOC)
    if extra:
        docs = docs.selectExpr("*", "'x' AS spans", "1 AS score", "'y' AS fp", "2 AS size", "'z' AS held_out", "'k' AS taken")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return items


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages_equal_brute_force(spark, tmp_path):
    for extra in (False, True):
        sf = f"{tmp_path}/{extra}"
        items = tables(spark, sf, extra)
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        before = docs.collect()
        names = docs.columns
        # 1: what the classifier rejects goes, row by row.
        good = corpus_pipeline.keep_good(spark, docs, sf)
        assert good.columns == names
        model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
        want = [r for r in before if slow_quality((r["text"] or "").encode(), model) >= quality.THRESHOLD]
        assert key(good.collect()) == key(want) and 40 <= len(want) < len(before)
        # 2: one row of each component stays.
        one = corpus_pipeline.keep_one_of_each(spark, docs, sf)
        assert one.columns == names
        fps = [slow_fingerprint(r["text"]) for r in before]
        roots = slow_components([r["doc_id"] for r in before], fps)
        assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for c in roots if c is not None})
        # 3: contaminated rows go.
        clean = corpus_pipeline.drop_contaminated(spark, docs, sf)
        assert clean.columns == names
        bad = {i for i, *_, c in slow_decontamination([(n, r["text"]) for n, r in enumerate(before)], items) if c}
        assert bad and key(clean.collect()) == key(r for n, r in enumerate(before) if n not in bad)
        # 4: all rows stay, secrets are masked.
        masked = corpus_pipeline.mask_secrets(spark, docs, sf)
        assert masked.columns == names and masked.schema == docs.schema
        got = {r["doc_id"]: r["text"] for r in masked.collect()}
        assert masked.count() == len(before)
        for r in before:
            if base_spans(r["text"]):
                assert "[secret]" in got[r["doc_id"]] and not re.search("password=|ab12ab12", got[r["doc_id"]])
            else:
                assert got[r["doc_id"]] == r["text"]
        # 5 and all together.
        result = corpus_pipeline.run(spark, sf)
        rows = result.collect()
        by = {}
        for r in rows:
            by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
        assert all(abs(t - taken) <= 1 for t, taken in by.values())
        # The whole run equals the stages one after another, the classifier being the same model.
        left = [r for r in before if quality.score_batch([(r["text"] or "").encode()], model)[0] >= quality.THRESHOLD]
        roots = slow_components([r["doc_id"] for r in left], [slow_fingerprint(r["text"]) for r in left])
        ids = {c for c in roots if c is not None}
        texts = {r["doc_id"]: r["text"] for r in left}
        bad = {i for i, *_, c in slow_decontamination([(i, texts[i]) for i in ids], items) if c}
        assert sorted(r["doc_id"] for r in rows) == sorted(ids - bad)


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, False)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
