"""Secret scan: exact patterns, and a battery of randomness tests that adds random strings in some encoding.

Each run of 20 or more encoding characters gets an inferred encoding (hexadecimal, base 32, 36, 62 or 64), and so does each
part of 20 or more letters and digits between its separators, such as a token within a path. Three tests ask whether it
could be uniform random text in that encoding: chi-squared uniformity of the alphabet (its tail by a gamma distribution with
the statistic's own mean and variance, which short runs need), the number of runs of character classes, and serial
correlation of neighbouring values; the Cauchy rule combines their p-values. Ordinary identifiers fail them, the more surely
the longer they are. So false-discovery control works by length: within each encoding and length class, counted over all
documents, the share of random strings follows from the p-values above one half, where the others are rare, and the smallest
bar is taken that keeps the estimated share of others among the reported within RATE, with a prior count of false
discoveries that falls with length. So in a class of very few candidates nothing is added unless they are long. Runs without
a digit have no encoding, since words look like them: of random runs of 20, 32 and 40 characters in base 62 that misses one
in 32, 254 and 1007.

Null text is empty and has no span. Positions are in code points, ends exclusive; an exact match's span is the whole match.
Added spans (kind `random`) that touch an exact one are dropped, and of a run and a part of it only the run is added. Very
long texts are scanned whole, in time that grows with their length. Repeated rows get equal results, each counted in its
class; rows without an id too. Without any candidate nothing is added; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .pii import joined

KINDS = ("assign", "access", "hex", "random")
#: Share of false discoveries among the added spans of a class; bins of p-values; smallest lengths of the classes.
RATE, BINS, LENGTHS = 0.1, 50, (20, 24, 32, 40, 64)

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: Runs that are long enough; shorter runs are matches that fail, with nothing to find inside them.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_PART = re.compile(r"[A-Za-z0-9]{20,}")
#: Encodings: name, alphabet in the order of its values.
_DIGITS, _UPPER, _LOWER = "0123456789", common.UPPER, common.LOWER
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
_CLASS = {c: 0 for c in _DIGITS} | {c: 1 for c in _UPPER} | {c: 2 for c in _LOWER} | {c: 3 for c in "+/-_"}


def exact_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def inferred(run: str) -> tuple[str, dict] | None:
    """The smallest encoding whose alphabet holds the run; words without digits and plain numbers have none."""
    chars = set(run)
    if chars <= set(_DIGITS) or not chars & set(_DIGITS):
        return None
    return next(((name, values) for name, alphabet, values in _SETS if chars <= alphabet), None)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty."""
    if df <= 0:
        return 1.0
    return _upper_normal(((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(run: str, values: dict) -> float:
    """Combined p-value that the run is uniform random text over the alphabet of values."""
    n, size = len(run), len(values)
    x = np.fromiter((values[c] for c in run), np.float64, n)
    counts = np.bincount(x.astype(np.int64), minlength=size)
    # uniform text of n characters has a chi-squared of mean size - 1 and variance 2 * (size - 1) * (n - 1) / n
    p_chi = _chi_tail((size / n * float((counts**2).sum()) - n) * n / (n - 1), (size - 1) * n / (n - 1))
    weights: dict[int, float] = {}
    for c in values:
        weights[_CLASS[c]] = weights.get(_CLASS[c], 0) + 1 / size
    kinds = np.fromiter((_CLASS[c] for c in run), np.int64, n)
    same = sum(w * w for w in weights.values())
    cubes = sum(w**3 for w in weights.values())
    changes = int((kinds[1:] != kinds[:-1]).sum())
    spread = (n - 1) * same * (1 - same) + 2 * (n - 2) * (cubes - same * same)
    z = (changes - (n - 1) * (1 - same)) / math.sqrt(max(spread, 1e-9))
    p_runs = 2 * _upper_normal(abs(z))
    y = x - (size - 1) / 2
    r = float((y[1:] * y[:-1]).sum()) / ((size * size - 1) / 12)
    p_serial = 2 * _upper_normal(abs(r) / math.sqrt(n - 1))
    clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
    t = sum(math.tan((0.5 - clip(p)) * math.pi) for p in (p_chi, p_runs, p_serial)) / 3
    return 0.5 - math.atan(t) / math.pi


def candidates(text: str) -> list[tuple[int, int, str, int, float]]:
    """Start, end, encoding, length class and p-value of each run with an encoding, before those of its parts."""
    out = []
    for m in _RUN.finditer(text):
        spans = [(0, len(m[0]))]
        if not m[0].isalnum():
            spans += [p.span() for p in _PART.finditer(m[0])]
        for a, b in spans:
            run = m[0][a:b]
            found = inferred(run)
            if found:
                length = max(k for k in LENGTHS if k <= len(run))
                out.append((m.start() + a, m.start() + b, found[0], length, battery(run, found[1])))
    return out


def bars(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[tuple[str, int], float]:
    """The smallest p-value to report, by encoding and length class, from a histogram over all documents."""

    @F.arrow_udf("array<struct<encoding:string,length:int,bin:int>>")
    def binned(text: pa.Array) -> pa.Array:
        rows = [
            [{"encoding": e, "length": k, "bin": min(BINS - 1, int(p * BINS))} for a, b, e, k, p in candidates(t)] for t in text.to_pylist()
        ]
        return pa.array(rows, pa.list_(pa.struct([("encoding", pa.string()), ("length", pa.int32()), ("bin", pa.int32())])))

    counted = docs.select(F.explode(binned(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("c")).groupBy("c.encoding", "c.length", "c.bin").count()
    counts: dict[tuple[str, int], np.ndarray] = {}
    for r in counted.collect():  # at most encodings x length classes x bins
        counts.setdefault((r["encoding"], r["length"]), np.zeros(BINS))[r["bin"]] = r["count"]
    return {k: bar for k, c in counts.items() if (bar := _bar(c, k[1], rate)) is not None}


def _bar(counts: np.ndarray, length: int, rate: float) -> float | None:
    above = np.cumsum(counts[::-1])[::-1]  # with a p-value from the bin's lower edge on
    truly = 2 * above[BINS // 2]
    prior = math.exp(-(length - 16) / 8)
    for k in range(1, BINS // 2):
        others = max(0.0, above[k] - truly * (1 - k / BINS))
        if above[k] > 0 and (others + prior) / above[k] <= rate:
            return k / BINS
    return None


def found(spark, bar: dict[tuple[str, int], float], text_col: str = "text") -> Column:
    """An array of (kind, start, end, exact) by start, then kind as in KINDS."""
    shared = spark.sparkContext.broadcast(bar)

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,exact:boolean>>")
    def spans(text: pa.Array) -> pa.Array:
        bar, rows = shared.value, []
        for t in text.to_pylist():
            base = exact_spans(t)
            row = [(s, KINDS.index(k), e, True) for k, s, e in base]
            order = sorted((a, b) for _, a, b in base)
            starts, reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))
            behind = 0
            for s, e, encoding, length, p in candidates(t) if bar else ():
                if s >= behind and p >= bar.get((encoding, length), 2):
                    j = bisect_left(starts, e)
                    if j == 0 or reach[j - 1] <= s:
                        row.append((s, 3, e, False))
                        behind = e
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "exact": x} for s, k, e, x in sorted(row)])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = docs.select("doc_id", found(spark, bars(docs)).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.filter("s", lambda s: s["exact"])).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )
