"""Secret scans: fixed patterns and a randomness test battery (DataFrame functions only).

Patterns give the kinds ``assign``, ``access`` and ``hex``. On top of them, every maximal run of at least 20
characters ``[A-Za-z0-9+/_=-]`` that has a letter and a digit is a candidate of kind ``random``:

* the encoding is inferred from the characters seen (hex, base32, lower or upper alphanumeric, base62, base64),
  which fixes the alphabet's size k;
* chi-squared uniformity: for ordinary identifiers the statistic is noncentral, of mean (k-1) + n*d and variance
  2(k-1) + 4nd with a departure d from uniform per encoding; the lower tail is the evidence for randomness, and
  grows with the length n;
* runs: alternations between letters and digits against those of ordinary identifiers (upper tail), and
  against those of a random string (two-sided gate);
* serial correlation of successive code points: a random string's stays within a bound that shrinks with n (gate).

The two tails are combined by Stouffer's rule to one p-value under "ordinary identifier". Benjamini-Hochberg runs
within every stratum (encoding and length class) over a histogram of p-values (at most 6 x 6 strata of 401 bins,
whatever the corpus), so the rate of false discoveries holds at each length. A random span that overlaps a pattern's span is left out.

Defined results: null text is empty and has no spans; an empty table gives no rows; repeated rows each give
a row; null ids are kept; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, running, text_of

#: The contract's patterns (fixed values); group 2 of assign is the secret itself.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")

#: Encodings in order of inference: name, characters, alphabet size, departure from uniform of ordinary identifiers.
ENCODINGS = (
    ("hex", r"[0-9a-f]+|[0-9A-F]+", 16, 1.0),
    ("base32", r"[A-Z2-7]+=*", 32, 1.2),
    ("lower36", r"[0-9a-z]+", 36, 1.2),
    ("upper36", r"[0-9A-Z]+", 36, 1.2),
    ("base62", r"[0-9A-Za-z]+", 62, 1.5),
    ("base64", r"[0-9A-Za-z+/_=-]+", 64, 1.5),
)
FDR = 0.05
GATE_Z = 3.3
BINS = 400


def _spans(text: Column, pattern: str, keep) -> Column:
    """Array of (start, end) of the pattern's matches that pass keep(match), from the pieces between matches."""
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
        spans = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t")))
        return F.filter(spans, lambda x: keep(x["t"]))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _normal_cdf(z: Column) -> Column:
    """Logistic-type approximation of the normal distribution function, absolute error below 2e-4."""
    return 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.070565 * z * z * z)))


def _tested(run: Column) -> Column:
    """One candidate with its statistics."""
    token = run["t"]
    n = F.length(token).cast("double")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)
    encoding = F.lit(len(ENCODINGS) - 1)
    k, depart = F.lit(float(ENCODINGS[-1][2])), F.lit(ENCODINGS[-1][3])
    for i in range(len(ENCODINGS) - 2, -1, -1):
        _, chars, size, departure = ENCODINGS[i]
        fits = token.rlike(f"^(?:{chars})$")
        encoding, k, depart = F.when(fits, F.lit(i)).otherwise(encoding), F.when(fits, F.lit(float(size))).otherwise(k), F.when(fits, F.lit(departure)).otherwise(depart)
    return F.struct(run["s"].alias("s"), run["e"].alias("e"), n.alias("n"), codes.alias("codes"), encoding.alias("encoding"), k.alias("k"), depart.alias("depart"))


def _scored(x: Column) -> Column:
    codes, n, k, d = x["codes"], x["n"], x["k"], x["depart"]
    squares = F.aggregate(
        F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(codes, lambda y: y == c)).cast("double"), F.lit(2.0))
    )
    chi = k / n * squares - n
    z_chi = ((k - 1 + n * d) - chi) / F.sqrt(2 * (k - 1) + 4 * n * d)
    digit = F.transform(codes, lambda c: F.when(c.between(48, 57), 1.0).otherwise(0.0))
    digits = F.aggregate(digit, F.lit(0.0), lambda a, b: a + b)
    after = F.slice(digit, F.lit(2), F.size(digit))
    changes = F.aggregate(F.zip_with(digit, after, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    runs = changes + 1
    mixed = 2 * digits * (n - digits)
    expected = mixed / n + 1
    spread = F.sqrt(F.greatest(F.lit(0.25), mixed * (mixed - n) / (n * n * (n - 1))))
    z_runs = (runs - 3) / F.sqrt(1 + n / 20)
    random_runs = (runs - expected) / spread
    values = F.transform(codes, lambda c: c.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / n
    centred = F.transform(values, lambda v: v - mean)
    power = F.aggregate(centred, F.lit(0.0), lambda a, b: a + b * b)
    lagged = F.aggregate(F.zip_with(centred, F.slice(centred, F.lit(2), F.size(centred)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    serial = F.when(power > 0, lagged / power * F.sqrt(n)).otherwise(F.lit(99.0))
    p = 1 - _normal_cdf((z_chi + z_runs) / F.sqrt(F.lit(2.0)))
    gate = (F.abs(random_runs) <= GATE_Z) & (F.abs(serial) <= GATE_Z)
    bin_ = F.when(gate, F.least(F.lit(BINS), F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-30)))).cast("int"))).otherwise(F.lit(0))
    length_class = F.least(F.lit(5), F.floor(F.log2(n / 20)).cast("int"))
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), (x["encoding"] * 6 + length_class).alias("stratum"), F.greatest(bin_, F.lit(0)).alias("bin"))


def candidates(docs: DataFrame, keep=()) -> DataFrame:
    """doc_id, the patterns' spans and the tested runs of every document; without the text unless kept."""
    text = text_of(docs)
    kept = _spans(text, RUN, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    return docs.select(
        "doc_id",
        *[docs[c].alias(f"__kept_{c}") for c in keep],
        _spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("assign"),
        _spans(text, ACCESS, lambda m: F.length(m) >= 20).alias("access"),
        _spans(text, HEX.replace("+", "{24,}"), lambda m: F.length(m) >= 24).alias("hex"),
        F.transform(F.transform(kept, _tested), _scored).alias("runs"),
    )


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg by stratum on binned p-values: the least bin that counts as a discovery."""
    counts = found.select(F.explode("runs").alias("r")).groupBy(F.col("r.stratum").alias("stratum"), F.col("r.bin").alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    counts = counts.withColumn("at_least", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    passed = counts.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 20) <= fdr * F.col("at_least") / F.col("all")))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}  # 36 rows at most


def _numbered(kind: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))


def _all_spans(limits: dict[int, int]) -> Column:
    """Every kept span as (start, kind's number, end)."""
    base = F.concat(*[F.transform(F.col(k), _numbered(i)) for i, k in enumerate(KINDS[:3])])
    if not limits:
        return F.array_sort(base)
    limit = F.create_map(*[F.lit(v) for pair in sorted(limits.items()) for v in pair])
    random = F.transform(
        F.filter(F.col("runs"), lambda r: (r["bin"] >= F.coalesce(limit[r["stratum"]], F.lit(BINS + 1))) & ~F.exists(base, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"]))),
        _numbered(3),
    )
    return F.array_sort(F.concat(base, random))


def scan(docs: DataFrame, fdr: float = FDR, keep=()) -> DataFrame:
    """doc_id, spans: array of (s, k, e) sorted by start, kind and end; and the columns named in keep.

    Two narrow passes over the texts and no shuffle of them: one for the thresholds (the runs alone are read
    off, then a histogram), one for the decisions.
    """
    limits = thresholds(candidates(docs), fdr)
    return candidates(docs, keep).select("doc_id", *[F.col(f"__kept_{c}").alias(c) for c in keep], _all_spans(limits).alias("spans"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    of = lambda i: F.size(F.filter("spans", lambda x: x["k"] == i)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_named(F.filter("spans", lambda x: x["k"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced by the mask; overlapping spans by one mask."""

    def masked(ends: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            return F.when(x["s"] >= last, F.concat(F.substring(text, last + 1, x["s"] - last), F.lit(mask))).otherwise("")

        tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

    ends = running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(ends, masked)).otherwise(text)


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle(fdr: float = FDR) -> str:
    """The same rows in SQL for DuckDB, over relations of matches and characters."""
    sources = []
    for number, (pattern, keep) in enumerate((
        (ASSIGN, f"length(regexp_extract(m, '{_quoted(ASSIGN)}', 2)) >= 6"),
        (ACCESS, "length(m) >= 20"),
        (HEX, "length(m) >= 24"),
        ("[A-Za-z0-9+/_=-]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
    )):
        rx = _quoted(pattern)
        sources.append(f"SELECT rid, {number} AS k, s, e, m FROM (SELECT rid, m, CAST(before + length(g) AS BIGINT) AS s, CAST(before + length(g) + length(m) AS BIGINT) AS e FROM ("
                       f"SELECT rid, m, g, coalesce(sum(length(m) + length(g)) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ("
                       f"SELECT rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS pos FROM ("
                       f"SELECT rid, regexp_extract_all(t, '{rx}') AS ms, string_split_regex(t, '{rx}') AS gs FROM d WHERE regexp_matches(t, '{rx}'))))) WHERE {keep}")  # fmt: skip
    encoding = "CASE " + " ".join(f"WHEN regexp_full_match(m, '{chars}') THEN {i}" for i, (_, chars, _, _) in enumerate(ENCODINGS[:-1])) + f" ELSE {len(ENCODINGS) - 1} END"
    sizes = ", ".join(f"({i}, {float(k)}::DOUBLE, {depart}::DOUBLE)" for i, (_, _, k, depart) in enumerate(ENCODINGS))
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({' UNION ALL '.join(sources)}),
tokens AS (SELECT rid, s, e, m, length(m)::DOUBLE AS n, {encoding} AS encoding FROM matches WHERE k = 3),
chars AS (SELECT rid, s, unnest(list_transform(string_split(m, ''), lambda c: unicode(c))) AS code, generate_subscripts(string_split(m, ''), 1) AS pos FROM tokens),
squares AS (SELECT rid, s, sum(c * c)::DOUBLE AS squares FROM (SELECT rid, s, code, count(*) AS c FROM chars GROUP BY ALL) GROUP BY ALL),
moved AS (
  SELECT rid, s, code - avg(code) OVER (PARTITION BY rid, s) AS v, lead(code) OVER o - avg(code) OVER (PARTITION BY rid, s) AS w,
         CASE WHEN code BETWEEN 48 AND 57 THEN 1 ELSE 0 END AS digit, CASE WHEN lead(code) OVER o BETWEEN 48 AND 57 THEN 1 WHEN lead(code) OVER o IS NOT NULL THEN 0 END AS next_digit
  FROM chars WINDOW o AS (PARTITION BY rid, s ORDER BY pos)),
sums AS (SELECT rid, s, sum(v * v) AS power, coalesce(sum(v * w), 0) AS lagged, sum(digit)::DOUBLE AS digits, count(*) FILTER (digit <> next_digit) + 1.0::DOUBLE AS runs FROM moved GROUP BY ALL),
stats AS (
  SELECT t.*, ((k - 1 + n * depart) - (k / n * squares - n)) / sqrt(2 * (k - 1) + 4 * n * depart) AS z_chi, (runs - 3) / sqrt(1 + n / 20) AS z_runs,
         (runs - (2 * digits * (n - digits) / n + 1)) / sqrt(greatest(0.25::DOUBLE, 2 * digits * (n - digits) * (2 * digits * (n - digits) - n) / (n * n * (n - 1)))) AS random_runs,
         CASE WHEN power > 0 THEN lagged / power * sqrt(n) ELSE 99.0 END AS serial
  FROM tokens t JOIN squares USING (rid, s) JOIN sums USING (rid, s) JOIN (VALUES {sizes}) v(encoding, k, depart) USING (encoding)),
tested AS (
  SELECT rid, s, e, encoding * 6 + least(5, floor(log2(n / 20)))::INT AS stratum,
         CASE WHEN abs(random_runs) <= {GATE_Z} AND abs(serial) <= {GATE_Z} THEN greatest(0, least({BINS}, floor(-20 * log10(greatest(
           1 - 1 / (1 + exp(-(1.5976::DOUBLE * z + 0.070565::DOUBLE * z * z * z))), 1e-30)))))::INT ELSE 0 END AS bin
  FROM (SELECT *, (z_chi + z_runs) / sqrt(2.0::DOUBLE) AS z FROM stats)),
counts AS (SELECT stratum, bin, count(*) AS n FROM tested GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS at_least, sum(n) OVER (PARTITION BY stratum) AS every FROM counts),
limits AS (SELECT stratum, min(bin) AS least_bin FROM ranked WHERE bin > 0 AND pow(10.0::DOUBLE, -bin / 20) <= {fdr}::DOUBLE * at_least / every GROUP BY stratum),
found AS (
  SELECT rid, k, s, e FROM matches WHERE k < 3
  UNION ALL SELECT t.rid, 3, t.s, t.e FROM tested t JOIN limits USING (stratum)
  WHERE bin >= least_bin AND NOT EXISTS (SELECT 1 FROM matches b WHERE b.k < 3 AND b.rid = t.rid AND b.s < t.e AND t.s < b.e)),
named AS (SELECT rid, k, s, e, list_value({names})[k + 1] || ':' || s || ':' || e AS name FROM found),
grouped AS (
  SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
         string_agg(name, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(name, ',' ORDER BY s, k, e) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN grouped USING (rid)
"""
