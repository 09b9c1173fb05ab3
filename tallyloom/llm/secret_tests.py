"""Secret scans: patterns, and a battery of randomness tests under false-discovery control.

Long runs of letters, digits and ``+/_-`` are candidates. The smallest alphabet that holds all
of a candidate's characters is its encoding. Three tests ask whether its symbols look drawn
evenly from that alphabet: chi-squared of the symbol counts, the number of runs above and below
the middle, and the correlation of neighbours; Fisher's method combines them. A candidate that
passes is still no secret if a word of the corpus would often look the same: under the
characters' frequencies in the corpus, its log-likelihood ratio against the even distribution
has a p-value, which falls with length, and Benjamini and Hochberg's procedure, run over all
candidates of a length band, sets the p-value up to which the band's candidates are secrets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.tokens import as_bytes, slabs
from tallyloom.session import durable

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}")

DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOW, UP, UP + "234567", LOW + "234567",
    DIGITS + LOW, DIGITS + UP, UP + LOW, UP + LOW + DIGITS, UP + LOW + DIGITS + "+/", UP + LOW + DIGITS + "-_",
)
CODES = [{c: i for i, c in enumerate(e)} for e in ENCODINGS]
BANDS = (12, 20, 32, 64)
#: Tenths of a decimal power; p-values are counted by these.
BINS = 400
PASS, RATE = 0.001, 0.01

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])
TRIED = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("band", T.IntegerType()), T.StructField("bin", T.IntegerType()),
    T.StructField("passed", T.BooleanType()),
])


def _tail(z: float) -> float:
    """P(Z >= z) of the standard normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(text: str, code: dict[str, int]) -> float:
    """Fisher's combination of the three tests: small if ``text`` is not evenly random."""
    n, k = len(text), len(code)
    symbols = [code[c] for c in text]
    counts: dict[int, int] = {}
    for s in symbols:
        counts[s] = counts.get(s, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    even = _tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [2 * s >= k for s in symbols]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean, spread = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    run = 2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1e-12
    centre = sum(symbols) / n
    off = [s - centre for s in symbols]
    power = sum(x * x for x in off)
    serial = 2 * _tail(abs(sum(x * y for x, y in zip(off, off[1:], strict=False)) / power)
                       * math.sqrt(n)) if power else 1e-12
    half = -sum(math.log(max(p, 1e-300)) for p in (even, run, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def language_tables(frequency: np.ndarray) -> list[tuple[dict[str, float], float, float]]:
    """For each encoding the log ratio of every symbol, and its mean and deviation in the corpus."""
    out = []
    for code in CODES:
        inside = np.array([frequency[ord(c)] for c in code])
        inside = inside / inside.sum()
        ratio = -np.log(inside * len(code))
        mean = float((inside * ratio).sum())
        spread = math.sqrt(float((inside * (ratio - mean) ** 2).sum()))
        out.append((dict(zip(code, ratio.tolist(), strict=True)), mean, spread))
    return out


def language_p(text: str, table: tuple[dict[str, float], float, float]) -> float:
    """How likely corpus text of this length looks at least as even.

    The normal approximation, but not below exp(-ratio), which the likelihood of a ratio so high
    never exceeds: the approximation's tail is too thin for short texts.
    """
    ratio, mean, spread = table
    total = sum(ratio[c] for c in text)
    if not spread:
        return 1.0
    return max(_tail((total - mean * len(text)) / (spread * math.sqrt(len(text)))),
               math.exp(-max(total, 0.0)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the three patterns."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def candidates(
    text: str, tables: list[tuple[dict[str, float], float, float]], least: float
) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, band, bin of the p-value, passed the battery) of every candidate.

    The battery is run from bin ``least`` on, below which no cut can lie.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        seen = set(m[0])
        kind = next((i for i, c in enumerate(CODES) if seen <= c.keys()), len(CODES) - 2)
        value = m[0] if seen <= CODES[kind].keys() else m[0].replace("-", "+").replace("_", "/")
        band = sum(len(value) >= b for b in BANDS) - 1
        p = language_p(value, tables[kind])
        level = min(int(-10 * math.log10(max(p, 1e-300))), BINS - 1)
        out.append((m.start(), m.end(), band, level,
                    level >= least and battery(value, CODES[kind]) >= PASS))
    return out


def secret_spans(
    text: str, tables: list[tuple[dict[str, float], float, float]], cuts: list[int]
) -> list[tuple[int, int, int]]:
    """Base spans and the candidates that their band's cut accepts, outside base spans."""
    base = base_spans(text)
    more = [(3, start, end) for start, end, band, level, passed in candidates(text, tables, min(cuts))
            if passed and level >= cuts[band]
            and not any(start < e and s < end for _, s, e in base)]
    return base + more


def _character_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(128, np.int64)
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for low, high in slabs(texts):
            data = np.frombuffer(b"".join(texts[low:high]), np.uint8)
            counts += np.bincount(data, minlength=256)[:128]
    yield pa.RecordBatch.from_arrays([pa.array(range(128)), pa.array(counts)], ["code", "n"])


def character_frequency(docs: DataFrame, text_col: str) -> np.ndarray:
    """Share of each ASCII character in all texts; 128 numbers reach the driver."""
    counts = docs.select(text_col).mapInArrow(_character_counts, "code long, n long")
    out = np.ones(128)
    for row in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] += row["n"]
    return out / out.sum()


def _scan(columns: list[str], frequency: np.ndarray, rate: float) -> Callable:
    tables, least = language_tables(frequency), math.floor(-10 * math.log10(rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("__source").to_pylist()]
            base = [[dict(zip(SPAN.names, s, strict=True)) for s in base_spans(t)] for t in texts]
            tried = [[dict(zip(TRIED.names, c, strict=True)) for c in candidates(t, tables, least)]
                     for t in texts]
            ints = pa.int32()
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in columns],
                pa.array(base, pa.list_(pa.struct([(n, ints) for n in SPAN.names]))),
                pa.array(tried, pa.list_(pa.struct(
                    [*[(n, ints) for n in TRIED.names[:-1]], ("passed", pa.bool_())]))),
            ], [*columns, "__base", "__tried"])
    return run


def scanned(
    docs: DataFrame, columns: list[str], text_col: str, frequency: np.ndarray, rate: float = RATE
) -> DataFrame:
    """``columns`` with ``__base`` spans and ``__tried`` candidates of every text; stored."""
    schema = T.StructType([*[docs.schema[c] for c in columns],
                           T.StructField("__base", T.ArrayType(SPAN)),
                           T.StructField("__tried", T.ArrayType(TRIED))])
    return durable(docs.select(*columns, F.col(text_col).alias("__source")).mapInArrow(
        _scan(columns, frequency, rate), schema), "scanned")


def discovery_cuts(found: DataFrame, rate: float = RATE) -> list[int]:
    """For each length band the least bin whose candidates are discoveries.

    From the counts of all candidates by band and bin, a table of fixed size.
    """
    counts = np.zeros((len(BANDS), BINS), np.int64)
    passing = np.zeros_like(counts)
    rows = found.select(F.explode("__tried").alias("c")).groupBy("c.band", "c.bin").agg(
        F.count("*").alias("n"), F.count_if("c.passed").alias("passed"))
    for row in rows.collect():
        counts[row["band"], row["bin"]] = row["n"]
        passing[row["band"], row["bin"]] = row["passed"]
    cuts = []
    for tried, passed in zip(counts.sum(axis=1), passing, strict=True):
        above = np.cumsum(passed[::-1])[::-1]
        expected = tried * 10.0 ** (-np.arange(BINS) / 10)
        good = np.flatnonzero((above > 0) & (expected <= rate * above))
        cuts.append(int(good[0]) if len(good) else BINS)
    return cuts


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE
) -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``,
    ``base_sha256`` (hex digest of the pattern spans) and ``spans``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by
    commas. A null or empty text has none, and the digest of the empty string. Repeated rows each
    get a row. ``rate`` is the expected share of false discoveries per length band.
    """
    frequency = character_frequency(docs, text_col)
    found = scanned(docs, [id_col], text_col, frequency, rate)
    cuts = F.array(*map(F.lit, discovery_cuts(found, rate)))
    more = F.transform(
        F.filter("__tried", lambda c: c["passed"]
                 & (c["bin"] >= F.element_at(cuts, c["band"] + 1))
                 & ~F.exists("__base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"]))),
        lambda c: F.struct(F.lit(3).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    named = found.withColumn("__more", more)

    def of(kind: int) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")

    return named.select(
        id_col, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.size("__more").cast("long").alias("n_random"),
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.concat("__base", "__more")).alias("spans"))


def _redact(columns: list[str], text_col: str, count_col: str | None, frequency: np.ndarray,
            cuts: list[int], mark: str) -> Callable:
    tables = language_tables(frequency)

    def clean(text: str | None) -> str | None:
        spans = sorted((s, e) for _, s, e in secret_spans(text or "", tables, cuts))
        if not spans:
            return text
        out, done = [], 0
        for start, end in spans:
            if start >= done:
                out += [text[done:start], mark]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text_col).to_pylist()
            new = [clean(t) for t in old]
            columns_out = []
            for c in columns:
                if c == text_col:
                    columns_out.append(pa.array(new, pa.string()))
                elif c == count_col:
                    columns_out.append(pa.array([
                        n if a == b else len(b) for n, a, b in
                        zip(batch.column(c).to_pylist(), old, new, strict=True)],
                        batch.column(c).type))
                else:
                    columns_out.append(batch.column(c))
            yield pa.RecordBatch.from_arrays(columns_out, columns)
    return run


def redact_secrets(
    docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars",
    rate: float = RATE, mark: str = "<secret>",
) -> DataFrame:
    """The documents with every secret replaced by ``mark``; texts without one stay as they are.

    ``count_col``, if present, is set to the new number of characters where a text changed.
    """
    frequency = character_frequency(docs, text_col)
    cuts = discovery_cuts(scanned(docs, [], text_col, frequency, rate), rate)
    return docs.mapInArrow(
        _redact(docs.columns, text_col, count_col, frequency, cuts, mark), docs.schema)
