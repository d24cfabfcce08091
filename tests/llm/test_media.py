import hashlib
import zlib

import numpy as np

from chronoloom.llm import media
from helpers import docs_frame, odd_frame


def test_round_trip_and_digest(spark):
    texts = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "ü漢" * 500, "same", "same"]
    stored = media.encode(docs_frame(spark, texts))
    rows = {r["doc_id"]: r for r in media.digest(stored).collect()}
    raw = {r["doc_id"]: r for r in stored.collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = rows[i]
        assert media.from_wav(raw[i]["media"]) == padded
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(raw[i]["media"]).hexdigest() and r["media_bytes"] == len(raw[i]["media"])
    assert rows[7]["feature"] == rows[8]["feature"] != rows[6]["feature"]


def test_tones_are_found():
    n = np.arange(media.FRAME * 40)
    tone = np.where(n < len(n) // 2, 0, np.round(100 * np.sin(2 * np.pi * 30 * n / media.FRAME))) + 128
    t, f = media.peaks(tone.astype(np.uint8).tobytes())
    assert 30 in f and t.min() >= 38
    found = media.pairs(np.array([0, 1, 20, 21], np.int32), np.array([5, 6, 7, 8], np.int16)).tolist()
    assert found == [[0, 5, 6, 1], [20, 7, 8, 1]]


def test_odd_rows(spark):
    odd = odd_frame(spark)
    def sizes(text):
        n = len((text or "").encode())
        return n, max(576, -(-n // 576) * 576)

    got = sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in media.digest(media.encode(odd)).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *sizes(r["text"])) for r in odd.collect()), key=repr)
    assert media.digest(media.encode(odd.limit(0))).count() == 0
