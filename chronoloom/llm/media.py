"""Media columns: texts as WAV files, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload of bytes is stored as one channel of 8-bit samples (mono WAV by the wave module), read back from the stored
bytes, cut into frames of ``FRAME`` samples at half a frame as hop (Hann window), and transformed. In every frame the strongest bin of each of
``BANDS`` frequency bands is a peak if it is the maximum among its neighbours in time and above the frame's mean; every peak is paired with the
next ``FAN`` peaks at most ``REACH`` frames ahead. A fingerprint is (time, first bin, second bin, distance), kept as an array in order of time.

Everything happens row by row inside a task: bounded by one document's payload, no shuffle, nothing written aside.

Defined results: null and empty texts have a payload of 576 bytes 255 (silence at the edge: no peaks); equal texts give equal
values; repeated rows each give a row; a null doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

BLOCK = 576
RATE = 8000
FRAME = 288
HOP = FRAME // 2
BANDS = ((1, 8), (8, 20), (20, 45), (45, 90), (90, FRAME // 2 + 1))
FAN = 3
REACH = 16
#: Frames transformed at once, so that memory is bounded whatever the length.
CHUNK = 4096

SCHEMA = "doc_id bigint, n_bytes bigint, media binary, peaks array<struct<t:int,f1:smallint,f2:smallint,dt:smallint>>"


def payload(text: bytes) -> bytes:
    """The bytes, filled up with 255 to a positive multiple of the block."""
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text + b"\xff" * (size - len(text))


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectra(samples: bytes):
    """Magnitudes of windowed frames, in chunks of frames."""
    x = np.frombuffer(samples, np.uint8)
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, len(frames), CHUNK):
        part = (frames[at : at + CHUNK].astype(np.float32) - 128) / 128 * window
        yield np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and bins of the peaks, by time and bin."""
    best, level, mean = [], [], []
    for s in spectra(samples):
        s[:, 0] = 0
        best.append(np.stack([s[:, a:b].argmax(1) + a for a, b in BANDS], 1))
        level.append(np.stack([s[:, a:b].max(1) for a, b in BANDS], 1))
        mean.append(s.mean(1))
    best, level, mean = np.concatenate(best), np.concatenate(level), np.concatenate(mean)
    edge = np.full((1, len(BANDS)), -1, np.float32)
    is_peak = (level > np.concatenate([edge, level[:-1]])) & (level >= np.concatenate([level[1:], edge])) & (level > mean[:, None]) & (level > 1e-3)
    t, band = np.nonzero(is_peak)
    return t.astype(np.int32), best[t, band].astype(np.int16)


def pairs(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """(time, first bin, second bin, distance) of every peak and its next FAN peaks within REACH frames, by time."""
    found = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= REACH
        found.append(np.stack([t[:-k][ok], f[:-k][ok], f[k:][ok], dt[ok]], 1))
    out = np.concatenate(found) if found else np.empty((0, 4), int)
    return out[np.lexsort(out.T[::-1])]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), peaks (fingerprints of what is read back from it)."""

    def made(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                media = [to_wav(payload(t)) for t in texts]
                prints = [pairs(*peaks(from_wav(m))) for m in media]
                all_prints = np.concatenate(prints)
                fields = pa.StructArray.from_arrays(
                    [pa.array(all_prints[:, i].astype(k)) for i, k in enumerate((np.int32, np.int16, np.int16, np.int16))], ["t", "f1", "f2", "dt"]
                )
                ends = np.append(0, np.cumsum([len(p) for p in prints])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), fields)],
                    ["doc_id", "n_bytes", "media", "peaks"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(made, SCHEMA)


def digest(media: DataFrame) -> DataFrame:
    """The contract's columns: what is stored is read back once more and summed up."""

    def summed(batches):
        for batch in batches:
            rows = []
            peaks_ = batch.column("peaks")
            flat, ends = peaks_.flatten(), np.asarray(peaks_.offsets) - peaks_.offsets[0].as_py()
            numbers = np.stack([np.asarray(flat.field(i)).astype("<i4") for i in range(4)], 1)
            for i, m in enumerate(batch.column("media").to_pylist()):
                data = from_wav(m)
                feature = hashlib.sha256(numbers[ends[i] : ends[i + 1]].tobytes()).hexdigest()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{ends[i + 1] - ends[i]}:{feature}"))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_bytes", *names])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.mapInArrow(summed, schema)
