"""Exact long repeats across a corpus with run-length indexes.

Two kinds of windows are looked up: strings of ``LENGTH`` bytes that start anywhere else in the corpus (kind 0; their bytes are removed), and
passages of ``WORDS`` words, with the white space between them, that occur in another document too (kind 1; only counted, for a column beside the
removal's). Windows never cross documents.

Routing. A window is filed under the least hash of its grams (``GRAMS`` bytes or words); equal windows have equal keys, and neighbouring windows
mostly share theirs. A segment is a maximal run of windows of one document with one key, its text those windows' bytes. Every window
belongs to exactly one segment. Counting keys, before and after a shuffle, tells which can hold a repeat at all: a key that
occurs once has none, unless its gram occurs at two places of its segment (which is told at once).

Index. Segments are filed by a keyed BLAKE2b hash, whose key is drawn anew by every run. One that stands at several places is cut out at two of them, and so is
a text that several rows have (as long segments of its own); only if their bytes, compared, are equal, the index takes them as one text that stands there
twice. The segments of all keys that are left go to buckets of bounded size (BUCKET on average, CROWDED more at most for a key). A bucket's segments, with a
separator after each, are sorted to a run-length Burrows-Wheeler transform; the text positions at run heads and run tails are
sampled with the length of their common prefix with the neighbour across the run's border. All other values follow: inside a
run, the common prefix of a position with its neighbour is one less than that of the position before. One stream over the text from
sample to sample gives the matching statistics of every position against everything else in the bucket, and where they
reach LENGTH, a repeat is marked. Passages are decided the same way on words and white space as symbols: the suffixes' order has runs of one document each,
and the common prefixes at a run's ends, carried into it, are the matching statistics against other documents; a passage is marked where they reach
its symbols. Marks of a segment hold for every document that has it.

A key with more than CROWDED bytes of different segments (a passage shared by very many documents has a different one at each end) is filed
again: its segments are cut up by longer grams, which fall apart into rare keys, up to the grams as long as the window, of
which a key has one. Every level is the same step over the segments of the last one, so all removed bytes come from the index.

Texts are identified by their SHA-256 (two 64-bit hashes of it): marks depend on nothing else. Segments and marks are narrow; the texts
are shuffled twice, once to cut out segments for the buckets (one copy of a text a task) and once to take the marks out.

Defined results: null is empty; texts below LENGTH bytes have no marks; repeated rows repeat each other and each give a row; a
null doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, shuffles_dropped, text_of, written

LENGTH = 400
WORDS = 51
#: Gram lengths of the levels: bytes, and words.
GRAMS = ((128, 256, 384, LENGTH), (12, 24, 48, WORDS))
#: Bytes of one piece of a long text, bytes of short texts taken together, windows of one segment, windows of one segment of a copied text, bytes of one bucket, bytes of one key's different
#: segments from which on it is filed again (a bucket may hold so many more).
PIECE = 1 << 20
GATHERED = 1 << 16
LONGEST = 4096
COPIED = 1 << 16
BUCKET = 1 << 19
CROWDED = 1 << 21
#: Rows taken up at a time.
ROWS = 500
#: Bytes compared at once before prefix doubling.
WIDTH = 8
END = 0xFF  # no byte of UTF-8

_BASE = 0x9E3779B97F4A7C15  # of the grams' hashes, which only file windows
_POWERS: dict = {}
_SYMBOL = re.compile(rb"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_BLANK = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = tuple(both)
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _prefix(data: bytes, base: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    x *= _powers(len(x) + 1, base)[0][: len(x)]
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts, ends, base: int) -> np.ndarray:
    return _mixed((prefix[ends] - prefix[starts]) * _powers(len(prefix), base)[1][starts])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of width values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of words, and first bytes after them."""
    blank = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)], [True]])
    change = np.flatnonzero(blank[1:] != blank[:-1])
    return change[::2], change[1::2]


def _within(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each of n places is in one of the ranges, which don't overlap."""
    change = np.zeros(n + 1, np.int64)
    change[first] += 1
    np.subtract.at(change, stop, 1)
    return np.cumsum(change)[:n] > 0


def _runs(kind: int, grams: np.ndarray, width: int, first: np.ndarray, stop: np.ndarray):
    """Keys of the windows (of width grams each) that begin in the ranges, cut to segments: key, first window, windows, whether the key may occur at two places."""
    least = sliding_minimum(grams, width)
    windows = np.flatnonzero(_within(len(least), first, stop))
    keys = least[windows]
    starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1)
    sizes = np.diff(np.append(starts, len(keys)))
    if sizes.max() > LONGEST:
        starts = np.concatenate([np.arange(s, s + n, LONGEST) for s, n in zip(starts, sizes)])
        sizes = np.diff(np.append(starts, len(keys)))
    found = (keys[starts] & ~np.uint64(1)) | np.uint64(kind)
    if kind:  # a passage that one document alone repeats doesn't count
        return found, windows[starts], sizes, np.zeros(len(found), bool)
    # Places that are the least of some window: no larger than the greatest key of the windows around them.
    outside = np.full(len(least) + 2 * width - 2, np.iinfo(np.uint64).max)
    outside[windows + width - 1] = ~keys
    around = ~sliding_minimum(outside, width)
    values, counts = np.unique(grams[(grams == around) & _within(len(grams), first, stop + width - 1)], return_counts=True)
    return found, windows[starts], sizes, np.isin(keys[starts], values[counts > 1])


def segment_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray, secret: bytes) -> np.ndarray:
    """Keyed 64-bit BLAKE2b of the segments' bytes."""
    view, keyed = memoryview(data), hashlib.blake2b(digest_size=8, key=secret)
    out = []
    for s, n in zip(starts.tolist(), sizes.tolist()):
        one = keyed.copy()
        one.update(view[s : s + n])
        out.append(one.digest())
    return np.frombuffer(b"".join(out), np.int64)


def _found(data: bytes, bytewise, words: np.ndarray, ends: np.ndarray, wordwise, level: int, secret: bytes):
    """Arrays key, segment hash, first byte, bytes, inner of the windows that begin in the ranges (of bytes, and of words)."""
    prefix, out = _prefix(data, _BASE), []
    if len(bytewise[0]):
        gram = GRAMS[0][level]
        places = np.arange(len(data) - gram + 1)
        key, first, n, inner = _runs(0, substring_hashes(prefix, places, places + gram, _BASE), LENGTH - gram + 1, *bytewise)
        out.append((key.view(np.int64), first, n + LENGTH - 1, inner))
    if len(wordwise[0]):
        gram = GRAMS[1][level]
        places = np.arange(len(words) - gram + 1)
        key, first, n, inner = _runs(1, substring_hashes(prefix, words[places], ends[places + gram - 1], _BASE), WORDS - gram + 1, *wordwise)
        out.append((key.view(np.int64), words[first], ends[first + n + WORDS - 2] - words[first], inner))
    key, first, size, inner = (np.concatenate(x) for x in zip(*out))
    return key, segment_hashes(data, first, size, secret), first, size, inner


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _of_short(texts: list[bytes], level: int, kinds, secret: bytes):
    """The texts' segments in one go; a blank between texts, and no window over it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = b"\n".join(texts)
    words, ends = word_bounds(data) if 1 in kinds else _NONE
    a, b = np.searchsorted(words, begin), np.searchsorted(words, begin + sizes)
    long, wordy = (sizes >= LENGTH) & (0 in kinds), b - a >= WORDS
    bytewise, wordwise = (begin[long], (begin + sizes - LENGTH + 1)[long]), (a[wordy], (b - WORDS + 1)[wordy])
    if len(bytewise[0]) or len(wordwise[0]):
        key, whole, first, size, inner = _found(data, bytewise, words, ends, wordwise, level, secret)
        owner = np.searchsorted(begin, first, side="right") - 1
        yield owner, key, whole, first - begin[owner], size, inner


def _of_long(data: bytes, level: int, kinds, secret: bytes):
    """A long text's segments, piece by piece."""
    words, ends = word_bounds(data) if 1 in kinds else _NONE
    for at in range(0, len(data), PIECE):
        here = min(PIECE, len(data) - LENGTH + 1 - at) if 0 in kinds else 0
        a, b = np.searchsorted(words, (at, at + PIECE))
        there = min(b, len(words) - WORDS + 1) - a
        if here <= 0 and there <= 0:
            continue
        last = max(at + here + LENGTH - 1 if here > 0 else 0, ends[a + there + WORDS - 2] if there > 0 else 0)
        span = lambda n: (np.array([0]), np.array([n])) if n > 0 else _NONE
        piece = slice(a, a + max(0, there + WORDS - 1))
        key, whole, first, size, inner = _found(data[at:last], span(here), words[piece] - at, ends[piece] - at, span(there), level, secret)
        yield np.zeros(len(key), np.int64), key, whole, first + at, size, inner


def segments_of(texts: list[bytes], level: int = 0, kinds=(0, 1), secret: bytes = b""):
    """Arrays text's number, key (its lowest bit is the kind), segment hash, first byte, bytes, whether the key may occur at two places of the segment."""
    out = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))]
    most = min(GATHERED, PIECE)
    filled = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        if len(texts[at]) > most:
            end, found = at + 1, _of_long(texts[at], level, kinds, secret)
        else:
            end = max(at + 1, int(np.searchsorted(filled, most + (filled[at - 1] if at else 0), side="right")))
            found = _of_short(texts[at:end], level, kinds, secret)
        out += [(owner + at, *rest) for owner, *rest in found]
        at = end
    return tuple(np.concatenate(x) for x in zip(*out))


def segments(data: bytes, level: int = 0, kinds=(0, 1), secret: bytes = b""):
    """The same of one text, without its number."""
    return segments_of([data], level, kinds, secret)[1:]


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys of so many bits."""
    n = len(key)
    if bits + n.bit_length() > 64:
        return np.argsort(key, kind="stable")
    packed = (key.astype(np.uint64) << np.uint64(n.bit_length())) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << n.bit_length()) - 1)).astype(np.int64)


def suffix_order(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by prefixes of WIDTH, 2 * WIDTH, ... symbols.

    data: texts with an END after each; ends: every position's END. A suffix stops at its END; equal suffixes go by position.
    """
    n = len(data)
    left = (ends - np.arange(n)).astype(np.int32)
    key = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(WIDTH - 1, np.uint8)), WIDTH).copy().view(f">u{WIDTH}").ravel().astype(np.uint64)
    short = np.flatnonzero(left < WIDTH - 1)  # nothing counts after an END
    key[short] &= ~np.uint64(0) << (np.uint64(8) * (WIDTH - 1 - left[short]).astype(np.uint64))
    return doubled(key, WIDTH, left)


def doubled(key: np.ndarray, width: int, left: np.ndarray, most: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and ranks by prefix doubling from keys of the first width symbols; left: symbols before a position's end; most: symbols that count."""
    n = len(key)
    order = np.argsort(key, kind="quicksort")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    del key
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(size > 1, size)]
    ranks, bits = [rank.astype(np.int32)], n.bit_length()
    while True:
        active = active[left[active] >= width]  # the others are equal to their ends
        if not len(active) or (most and width >= most):
            break
        key = (rank[active] << bits) | rank[active + width]
        order = _order(key, 2 * bits)
        active, ordered = active[order], key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        group = np.append(True, (ordered[1:] >> bits) != (ordered[:-1] >> bits))
        at = np.arange(len(order))
        # A group keeps its place: the rank is the number of suffixes before it.
        rank[active] = rank[active] + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        width *= 2
        ranks.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        active = active[np.repeat(size > 1, size)]
    return _order(rank, bits), ranks


def common_prefix(p: np.ndarray, q: np.ndarray, data: np.ndarray, ends: np.ndarray, ranks: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """Lengths of the common prefixes of suffixes p and q, which end with their texts; width: symbols of the first ranks."""
    n = len(data)
    most = np.minimum(ends[p] - p, ends[q] - q)
    out = np.zeros(len(p), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        out += (ranks[level][np.minimum(p + out, n - 1)] == ranks[level][np.minimum(q + out, n - 1)]).astype(np.int64) * (width << level)
    going = out < most
    for _ in range(width - 1):
        going &= data[np.minimum(p + out, n - 1)] == data[np.minimum(q + out, n - 1)]
        out += going
    return np.minimum(out, most)


def _streamed(n: int, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Value at every text position from the samples: one less at every step away from the sample that reaches furthest."""
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, places, places + lengths)
    return np.maximum.accumulate(reach) - np.arange(n)


def matching_statistics(texts: list[bytes], copies=None) -> tuple[np.ndarray, np.ndarray, int]:
    """For every position of the texts, laid end to end with a separator after each: longest match that starts anywhere else.

    copies: how often each text stands there, once or twice; a copy follows its text, and so do its suffixes in order, so only
    different texts are sorted. Also the texts' first positions and the number of runs of the transform.
    """
    sizes = np.array([len(t) for t in texts])
    twice = np.zeros(len(texts), bool) if copies is None else np.asarray(copies) > 1
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    stops = np.cumsum(sizes + 1) - 1
    ends = np.repeat(stops, sizes + 1)
    order, ranks = suffix_order(data, ends)
    # Every suffix of a text that stands there twice is followed by its copy's, whose place is the text's length later.
    number = 1 + np.repeat(twice, sizes + 1).astype(np.int64)[order]
    suffix = np.repeat(order, number)
    bwt = data[suffix - 1]  # of the first position: the last separator
    border = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == END)) + 1  # heads of runs but the first; separators differ from each other
    heads, tails = suffix[border], suffix[border - 1]
    shared = np.where(heads == tails, ends[heads] - heads, 0)
    other = heads != tails
    shared[other] = common_prefix(heads[other], tails[other], data, ends, ranks)
    # Both copies of a text have the same statistics, so their samples are laid out over the text once.
    n = len(data)
    before = _streamed(n, heads, shared)
    after = _streamed(n, tails, shared)
    return np.maximum(np.maximum(before, after), 0), np.append(0, stops[:-1] + 1), len(border) + 1


def covered(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of [first, last) over sorted windows."""
    if not len(first):
        return []
    new = np.append(True, first[1:] > last[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return list(zip(first[new].tolist(), last[ends].tolist()))


def marked_bytes(texts: list[bytes], copies) -> list[list[tuple[int, int]]]:
    """Per text, the stretches covered by LENGTH bytes that start elsewhere among the texts."""
    statistics, starts, _ = matching_statistics(texts, copies)
    hits = np.flatnonzero(statistics >= LENGTH)
    cuts = np.searchsorted(hits, np.append(starts, len(statistics)))
    return [covered(w := hits[cuts[i] : cuts[i + 1]] - starts[i], w + LENGTH) for i in range(len(texts))]


def _least_so_far(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running minimum that begins again where new is true."""
    below = (np.cumsum(new) * (values.max(initial=0) + 1)).astype(np.int64)
    return np.minimum.accumulate(values - below) + below


def foreign_statistics(symbols: np.ndarray, ends: np.ndarray, color: np.ndarray, most: int) -> np.ndarray:
    """For every position, the longest match with a text of another color, exact up to most symbols; symbols: texts with a separator after each, all from 1 on."""
    left = (ends - np.arange(len(symbols))).astype(np.int32)
    bits = int(symbols.max()).bit_length()
    width = max(1, 62 // bits)
    key = symbols.copy()
    for i in range(1, width):  # nothing counts after a separator
        key = (key << bits) | np.where(left >= i, np.append(symbols[i:], np.zeros(i, symbols.dtype))[: len(symbols)], 0)
    order, ranks = doubled(key, width, left, most)
    shared = np.append(0, common_prefix(order[1:], order[:-1], symbols, ends, ranks, width))  # with the suffix before
    border = np.append(True, color[order][1:] != color[order][:-1])  # heads of runs of one color
    up = _least_so_far(shared, border)  # the least from a run's head on: with the last suffix of another color before
    down = _least_so_far(np.append(shared[1:], 0)[::-1], np.append(border[1:], True)[::-1])[::-1]
    out = np.empty(len(symbols), np.int64)
    out[order] = np.maximum(up, down)
    return out


def marked_passages(texts: list[bytes], colors: list) -> list[list[tuple[int, int]]]:
    """Per text, the stretches of WORDS words that occur in a text of another color; a text without a color is of several. Texts begin and end with words."""
    numbers: dict[bytes, int] = {}
    cut = [[numbers.setdefault(x, len(numbers) + 1) for x in _SYMBOL.findall(t)] for t in texts]
    sizes = np.array([len(c) for c in cut])
    stops = np.cumsum(sizes + 1) - 1
    symbols = np.full(int(stops[-1]) + 1, len(numbers) + 1)
    starts = stops - sizes
    for c, s in zip(cut, starts):
        symbols[s : s + len(c)] = c
    own = {c: i for i, c in enumerate(dict.fromkeys(colors))}
    color = np.array([-1 - i if c is None else own[c] for i, c in enumerate(colors)])
    found = foreign_statistics(symbols, np.repeat(stops, sizes + 1), np.repeat(color, sizes + 1), 2 * WORDS - 1)
    out = []
    for t, c, s, n in zip(texts, colors, starts, sizes):
        first, last = word_bounds(t)
        hit = np.ones(max(0, len(first) - WORDS + 1), bool) if c is None else found[s : s + n : 2][: max(0, len(first) - WORDS + 1)] >= 2 * WORDS - 1
        at = np.flatnonzero(hit)
        out.append(covered(first[at], last[at + WORDS - 1]))
    return out


#: A piece is a text (level 0: its two hashes) or a crowded segment of the level before (its key and hash); n: 2 if it stands at several places, else 1;
#: color: the hash of the only text that has it, null for several.
PIECE_ID = ["pk", "pw"]
FOUND = "pk long, pw long, key long, whole long, first long, size long, inner boolean"
CUT = "key long, whole long, n long, color long, load long, single boolean, pk long, pw long, first long, place long, data binary"
MARK = "pk long, pw long, kind int, s long, e long"
SEGMENT_MARK = "key long, whole long, s long, e long, single boolean, pk long, pw long, first long"


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary), and the two hashes that stand for the text."""
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    text = text.withColumn("sha", F.sha2("text", 256))
    return text.select("doc_id", "text", F.xxhash64("sha").alias("pk"), F.xxhash64("sha", F.lit(1)).alias("pw"))


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(list(zip(*rows)) or [()] * len(fields), fields)], [f for f, _ in fields])


def _slices(batches):
    """Batches of few rows, so that little of the texts is in memory twice."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _segment_rows(level: int, secret: bytes):
    """Segments of texts, or of crowded segments: these are of one kind, and their n and color go along."""
    along = ["n", "color"] if level else []
    names = [*(x.split()[0] for x in FOUND.split(", ")), *along]

    def rows(batches):
        for batch in _slices(batches):
            data = batch.column("data").to_pylist()
            given = {c: batch.column(c) for c in ("pk", "pw", *along)}
            for kinds in ((0,), (1,)) if level else ((0, 1),):
                mine = np.flatnonzero((given["pk"].to_numpy() & 1) == kinds[0]) if level else np.arange(len(batch))
                owner, *found = segments_of([data[i] for i in mine], level, kinds, secret)
                owner = pa.array(mine[owner])
                columns = {"pk": given["pk"].take(owner), "pw": given["pw"].take(owner)} | dict(zip(("key", "whole", "first", "size", "inner"), map(pa.array, found)))
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else given[c].take(owner) for c in names], names)

    return rows


def _cut_rows(batches):
    """Pieces with a list of wanted segments to one row per segment and place. Of the copies of a piece in one task, one is cut, and two where its copies are wanted (place 2 and above)."""
    done: dict = {}
    place = (TaskContext.get().partitionId() << 40) + 2
    for batch in _slices(batches):
        rows = []
        for pk, pw, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("pk", "pw", "data", "wanted"))):
            done[pk, pw] = copies = done.get((pk, pw), 0) + 1
            if copies > 2:
                continue
            place += 1
            for w in wanted:
                if copies == 1 or w["side"] > 1:
                    rows.append((w["key"], w["whole"], w["n"], w["color"], w["load"], w["single"], pk, pw, w["first"], place if w["side"] > 1 else w["side"], data[w["first"] : w["first"] + w["size"]]))
                if len(rows) >= 4000:
                    yield _batch(rows, CUT)
                    rows = []
        if rows:
            yield _batch(rows, CUT)


def _compared(cut: DataFrame) -> DataFrame:
    """One row per segment; n: 2 if its bytes at two places, or in two copies of its text, are equal."""
    same = [c for c in ("n", "color", "load", "single")]
    both = cut.groupBy("key", "whole").agg(*[F.max(c).alias(c) for c in same], F.min(F.struct("pk", "pw", "first")).alias("at"), F.min("place").alias("p"), F.max("place").alias("q"), F.min_by("data", "place").alias("data"), F.max_by("data", "place").alias("other"))
    n = F.when(F.col("p") == F.col("q"), F.col("n")).when(F.col("data") == F.col("other"), 2).otherwise(F.raise_error("two segments have one hash; run again, with another key"))
    return both.select("key", "whole", n.cast("long").alias("n"), "color", "load", "single", "at.*", "data")


def _copies(most: int):
    """Rows of pieces, so many per task of those that are equal."""

    def rows(batches):
        seen: dict = {}
        for batch in batches:
            keep = []
            for i, piece in enumerate(zip(batch.column("pk").to_pylist(), batch.column("pw").to_pylist())):
                seen[piece] = n = seen.get(piece, 0) + 1
                if n <= most:
                    keep.append(i)
            yield batch if len(keep) == len(batch) else batch.take(pa.array(keep, pa.int64()))

    return rows


def _merged(marks: DataFrame) -> DataFrame:
    """The union of a piece's marks; a piece of this kind is a segment, so its marks are no more than its bytes."""

    def rows(batches):
        for batch in batches:
            out = []
            for pk, pw, kind, found in zip(*(batch.column(c).to_pylist() for c in ("pk", "pw", "kind", "found"))):
                out += [(pk, pw, kind, s, e) for s, e in _joined([(m["s"], m["e"]) for m in found])]
            yield _batch(out, MARK)

    return marks.groupBy(*PIECE_ID, "kind").agg(F.collect_set(F.struct("s", "e")).alias("found")).mapInArrow(rows, MARK)


def _bucket_marks(table: pa.Table) -> pa.Table:
    """Marks of one bucket's segments, kind by kind."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "whole", "n", "color", "single", "pk", "pw", "first", "data"))), key=lambda r: r[:2])
    out = []
    for kind in (0, 1):
        mine = [r for r in rows if r[0] & 1 == kind]
        if mine:
            found = marked_bytes([r[-1] for r in mine], [r[2] for r in mine]) if kind == 0 else marked_passages([r[-1] for r in mine], [r[3] for r in mine])
            for r, spans in zip(mine, found):
                out += [(r[0], r[1], s, e, *r[4:8]) for s, e in spans]
    return pa.Table.from_batches([_batch(out, SEGMENT_MARK)])


def _copied(texts: DataFrame) -> DataFrame:
    """pk, pw, length of texts that several rows have."""
    return texts.groupBy(*PIECE_ID).agg(F.count("*").alias("rows"), F.max(F.length("text")).cast("long").alias("length")).where(F.col("rows") > 1).drop("rows")


def _copied_segments(copied: DataFrame) -> DataFrame:
    """Texts that several rows have, cut to long segments of their own, of two rows each."""
    cut = copied.where(F.col("length") >= LENGTH).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - LENGTH, F.lit(COPIED).cast("long"))).alias("first"))
    size = F.least(F.lit(COPIED + LENGTH - 1).cast("long"), F.col("length") - F.col("first"))
    key = F.xxhash64("pk", "pw", "first").bitwiseAND(-2)
    return cut.select(key.alias("key"), F.xxhash64("pw", "first", "pk").alias("whole"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("color"), size.alias("load"), F.lit(True).alias("single"), F.lit(2).alias("side"), "pk", "pw", "first", size.alias("size"))


def piece_marks(pieces: DataFrame, secret: bytes, level: int = 0, copied: DataFrame | None = None) -> DataFrame:
    """pk, pw, kind, s, e: stretches of pieces covered by repeats (they may overlap and touch). Tables that no later step reads are deleted on the way."""
    spark = pieces.sparkSession
    few = lambda most: pieces if level else pieces.mapInArrow(_copies(most), "pk long, pw long, data binary")
    with scratch(spark, only=("segments",)):
        found = written(few(1).mapInArrow(_segment_rows(level, secret), FOUND + (", n long, color long" if level else "")), "segments")
        # Most keys occur once: they go before anything wider than a key is shuffled for good.
        known = found.groupBy("key").agg(F.count("*").alias("rows"), F.max("inner").alias("any"), (F.max("n") if level else F.lit(1)).alias("n"))
        found = found.join(known.where((F.col("rows") > 1) | F.col("any") | (F.col("n") > 1)).select("key"), "key", "left_semi")
        found = written(found.select(*[x.split()[0] for x in FOUND.split(", ")], *(["n", "color"] if level else [])).distinct(), "candidates")  # a text's places once, however many copies it has
    color = F.col("color" if level else "pk")
    counted = found.groupBy("key", "whole").agg(
        F.min(F.struct("pk", "pw", "first", "size")).alias("one"),
        F.max(F.struct("pk", "pw", "first", "size")).alias("other"),
        ((F.min("pk") != F.max("pk")) | (F.min("pw") != F.max("pw")) | (F.min("first") != F.max("first"))).alias("several"),
        F.max("inner").alias("inner"),
        F.min(color).alias("least"),
        F.max(color).alias("most"),
        *([F.max("n").alias("n"), F.max(F.col("color").isNull()).alias("mixed")] if level else []),
    )
    counted = counted if level else counted.withColumns({"n": F.lit(1).cast("long"), "mixed": F.lit(False)})
    # A key of one place has no repeat, and one of a single text has no passage of another document.
    keys = counted.groupBy("key").agg(F.sum(F.when(F.col("several"), 2).otherwise(F.col("n"))).alias("all"), F.sum("one.size").alias("load"), F.max("inner").alias("any"), ((F.min("least") < F.max("most")) | F.max("mixed")).alias("texts"))
    keys = keys.where(F.when(F.col("key").bitwiseAND(1) == 0, (F.col("all") > 1) | F.col("any")).otherwise(F.col("texts"))).select("key", "load")
    color = F.when(~F.col("mixed") & (F.col("least") == F.col("most")), F.col("least"))
    places = F.posexplode(F.when(F.col("several"), F.array("one", "other")).otherwise(F.array("one"))).alias("side", "at")
    flagged = counted.join(keys, "key").select("key", "whole", "n", color.alias("color"), "load", (~F.col("several")).alias("single"), places)
    flagged = flagged.select("key", "whole", "n", "color", "load", "single", "side", "at.*")
    with scratch(spark, only=("flagged",)):
        flagged = written(flagged if copied is None else flagged.unionByName(_copied_segments(copied)), "flagged")

        last = level + 1 == len(GRAMS[0])
        crowded = F.lit(False) if last else F.col("load") > CROWDED
        size, more = flagged.agg(F.sum(F.when(~crowded & (F.col("side") != 1), F.col("size"))), F.max(crowded)).first()
        buckets = max(1, -(-(size or 0) // BUCKET))
        item = F.struct("key", "whole", "n", "color", "load", "single", "side", "first", "size")
        lists = flagged.groupBy(*PIECE_ID).agg(F.collect_list(item).alias("wanted"))
        # Copies of a text give its segments again: one row of each is kept, so that BUCKET bounds a group.
        cut = few(2).select("data", *PIECE_ID).join(lists, PIECE_ID).select("pk", "pw", "data", "wanted").mapInArrow(_cut_rows, CUT)
        cut = written(_compared(cut), "cut-segments")
    shelved = cut.where(~crowded).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    marked = shelved.groupBy("bucket").applyInArrow(_bucket_marks, SEGMENT_MARK)
    if more:
        finer = cut.where(crowded).select(F.col("key").alias("pk"), F.col("whole").alias("pw"), "n", "color", "data")
        deeper = piece_marks(finer, secret, level + 1).withColumnsRenamed({"pk": "key", "pw": "whole"})
        where = cut.where(crowded).select("key", "whole", "single", "pk", "pw", "first")
        marked = marked.unionByName(deeper.join(where, ["key", "whole"]).select(marked.columns))
    marked = written(marked, "segment-marks")
    # A segment that stands at one place of one text has it at hand; others are looked up.
    kind = F.col("key").bitwiseAND(1).cast("int").alias("kind")
    placed = lambda df: df.select(*PIECE_ID, kind, (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e")).alias("e"))
    many = found.select("key", "whole", "pk", "pw", "first").join(marked.where(~F.col("single")).select("key", "whole", "s", "e"), ["key", "whole"])
    every = placed(marked.where("single")).unionByName(placed(many))
    return every if level == 0 else _merged(every)


def marks(texts: DataFrame) -> DataFrame:
    """pk, pw, kind, s, e of texts. Texts that several rows have are passages of several documents as a whole."""
    long = texts.where(F.length("text") >= 2 * WORDS - 1).select(*PIECE_ID, F.col("text").alias("data"))
    with shuffles_dropped(texts.sparkSession):
        copied = written(_copied(texts), "copied")
        found = piece_marks(long, secrets.token_bytes(16), copied=copied)
    return found.unionByName(copied.select(*PIECE_ID, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("s"), F.col("length").alias("e")))


def _joined(found: list) -> list[tuple[int, int]]:
    if not found:
        return []
    s, e = np.array(sorted(found), np.int64).T
    return covered(s, np.maximum.accumulate(e))


def _removed_rows(batches):
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in _slices(batches):
        rows = []
        for i, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
            spans, passages = (_joined([(m["s"], m["e"]) for m in found or () if m["kind"] == k]) for k in (0, 1))
            at, kept, words = 0, [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            if passages:
                starts, _ = word_bounds(text)
                if len(starts) >= WORDS:
                    words = int(np.diff(np.searchsorted(starts, np.array(passages)), axis=1).sum())
            rows.append((i, len(text), [{"s": s, "e": e} for s, e in spans], b"".join([*kept, text[at:]]), words))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), span, pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "spans", "kept", "passage_words"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed stretches), kept (the bytes left), passage_words (words in passages of WORDS or more of other documents)."""
    texts = _identified(docs)
    lists = marks(texts).groupBy(*PIECE_ID).agg(F.collect_set(F.struct("kind", "s", "e")).alias("found"))
    out = "doc_id long, n_bytes long, spans array<struct<s:bigint,e:bigint>>, kept binary, passage_words long"
    return texts.join(lists, PIECE_ID, "left").select("doc_id", "text", "found").mapInArrow(_removed_rows, out)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and the words of passages that other documents have."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_words")
