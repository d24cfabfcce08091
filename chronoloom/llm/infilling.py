"""Fill-in-middle transformation by overlapping chunks.

A text is cut into three pieces at two ranks of units (code points; words or lines by parameter) and written as prefix, suffix and
middle in one of two orders, after seeded draws from a digest of its id.

Method. Whether a unit begins at a byte is a predicate of that byte and the one before it. A text's bytes are decomposed into
chunks of ``CHUNK`` bytes that each overlap their predecessor by one byte, so every chunk counts its own units without
the others. The chunks' counts are cumulated; a cut rank lies in the one chunk whose range of counts holds it, and only these
owning chunks (two at most) are scanned a second time, for the byte where the cut falls.

The work is one map over the rows: nothing is shuffled, a text stays in the task that reads it, and beside the text a task
holds one chunk's flags. Rows are taken up by bytes, so long texts don't add up.

Defined results: null counts as the empty text, which is written plain; a row without an id draws from the digest of an empty id;
repeated rows are written alike; a text with a sentinel in it is plain; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of one chunk.
CHUNK = 1 << 16
_BLANK = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
_FIRST = 10  # stands before a text's first byte: a blank and an end of line

#: Whether a unit begins between two adjacent bytes.
UNITS = {
    "char": lambda before, after: (after & 0xC0) != 0x80,
    "word": lambda before, after: _BLANK[before] & ~_BLANK[after],
    "line": lambda before, after: before == 10,
}


def chunks(data: np.ndarray, size: int):
    """(first byte, the byte before each byte, the bytes) of every chunk; the overlap of one byte is the first of the bytes before."""
    for at in range(0, len(data), size):
        after = data[at : at + size]
        before = np.append(np.uint8(_FIRST), after[:-1]) if at == 0 else data[at - 1 : at + len(after) - 1]
        yield at, before, after


def unit_counts(data: np.ndarray, begins, size: int) -> np.ndarray:
    """Units that begin in each chunk."""
    return np.array([np.count_nonzero(begins(before, after)) for _, before, after in chunks(data, size)], np.int64)


def cut_bytes(data: np.ndarray, counts: np.ndarray, ranks, begins, size: int) -> list[int]:
    """The byte before which so many units lie, for each rank; the owning chunk alone is scanned."""
    until = np.cumsum(counts)
    out = []
    for rank in ranks:
        if rank <= 0 or not len(until):
            out.append(0)
        elif rank >= until[-1]:
            out.append(len(data))
        else:
            owner = int(np.searchsorted(until, rank, side="right"))
            at = owner * size
            _, before, after = next(chunks(data[at - 1 : at + size], size + 1)) if owner else next(chunks(data[:size], size))
            places = np.flatnonzero(begins(before, after)[1:] if owner else begins(before, after))
            out.append(at + int(places[rank - (until[owner - 1] if owner else 0)]))
    return out


def _code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def transform(docs: DataFrame, unit: str = "char", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output (text)."""
    begins = UNITS[unit]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = text_of(docs)
    plain = (text == "") | F.greatest(*[F.contains(text, F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]) | (drawn[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(drawn[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.cast("binary").alias("text"), form.alias("form"), drawn[0].alias("h1"), drawn[1].alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def written_out(batches):
        for batch in by_bytes(batches, "text"):
            out = []
            for text, form, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("text", "form", "h1", "h2"))):
                data = np.frombuffer(text, np.uint8)
                counts = unit_counts(data, begins, chunk)
                n = int(counts.sum())
                if form == "plain":
                    out.append((n, None, None, text))
                    continue
                first, last = cut_bytes(data, counts, sorted((h1 % (n + 1), h2 % (n + 1))), begins, chunk)
                pieces = (p, text[:first], s, text[last:], m) if form == "psm" else (s, text[last:], p, text[:first], m)
                out.append((n, _code_points(text[:first]), _code_points(text[first:last]), b"".join((*pieces, text[first:last]))))
            n, prefix, middle, output = zip(*out)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(written_out, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for. Sentinels don't overlap themselves, so the first of each is the one written."""

    def between(first: str, second: str, swapped: bool) -> Column:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, MIDDLE, 1)
        middle = F.substr(rest, F.length(two) + F.lit(len(MIDDLE) + 1))
        return F.concat(two, middle, one) if swapped else F.concat(one, middle, two)

    return F.when(form == "plain", output).when(form == "psm", between(PREFIX, SUFFIX, False)).otherwise(between(SUFFIX, PREFIX, True))


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same rows by substrings, for DuckDB.
ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
         ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM hashed),
formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
       (CASE WHEN form <> 'plain' THEN a END)::BIGINT AS prefix_chars,
       (CASE WHEN form <> 'plain' THEN b - a END)::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                        ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed
"""
