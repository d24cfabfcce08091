import itertools
import zlib

import numpy as np
import pytest

from chronoloom.llm import quality, registry, toxicity
from helpers import docs_frame, odd_frame


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 3, 6, 2])
    odds, edge = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, pairs, norm = quality.marginals(odds, lengths, edge)
    at = 0
    for c, n in enumerate(lengths):
        total, want, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(odds[at + i] * v for i, v in enumerate(y)) + sum(edge[a, b] for a, b in zip(y, y[1:])))
            total += p
            want += p * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += p
        assert np.allclose(good[at : at + n], want / total)
        assert np.allclose(pairs[c], both / total)
        assert np.isclose(norm[c], np.log(total))
        at += n


def test_neighbours_stop_at_documents():
    bins = np.arange(6)[:, None]
    got = quality._with_neighbours(bins, np.array([0, 4]), np.array([3, 5]))
    width, none = quality.BINS, 3 * quality.BINS
    assert got[:, 1].tolist() == [none, width, width + 1, width + 2, none, width + 4]
    assert got[:, 2].tolist() == [2 * width + 1, 2 * width + 2, 2 * width + 3, none, 2 * width + 5, none]


def test_compression_sees_every_line():
    rng = np.random.default_rng(3)
    column = quality._NAMES.index("doc_packed")
    noise = [bytes(rng.integers(97, 123, 60, dtype=np.uint8)) for _ in range(1000)]
    for lines in (noise, noise[:130], [b"again and again the same line, at that"] * 200, [b"same" * 20 if i % 15 else x for i, x in enumerate(noise)]):
        joined = b"\n".join(lines)
        assert np.allclose(quality.features(lines)[:, column], len(zlib.compress(joined, 1)) / len(joined), atol=2e-3)


@pytest.mark.parametrize("query, column, least", [(registry.op7_quality_crf, "quality", 0.95), (registry.op2_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, query, column, least):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = query(spark, sf).collect()
    assert len(got) == len({r["doc_id"] for r in got})
    pairs = [(labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    ones, zeros = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    better = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert better > least


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, column):
    odd = odd_frame(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    n = odd.count()
    rows = module.classify(odd, labels).collect()
    assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["held_out"] is None for r in rows) == 1
    assert module.classify(odd, labels.limit(0)).count() == n
    assert module.classify(odd.limit(0), labels).count() == 0
    one = module.classify(docs_frame(spark, ["a", None]), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert {r["score"] for r in one} == {1.0}


def test_severity_is_ordered():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(100, 200, 30), np.arange(k))) for k in rng.integers(0, 12, 400)]
    toxic = np.array([int(len(r[r < 100]) > 3) for r in rows])
    model = toxicity.fit(rows, toxic, np.ones(400))
    assert (np.diff(model["cuts"]) > 0).all()
    table = np.zeros(1 << toxicity.BITS)
    table[model["used"]] = model["weights"]
    z = np.array([table[r].sum() for r in rows])
    assert z[toxic == 1].mean() > z[toxic == 0].mean() + 1
