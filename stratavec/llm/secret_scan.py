"""Secret scanning: fixed patterns, and a battery of randomness tests on the other long tokens.

The patterns (kinds assign, access, hex) find what has a known form. Every other token of 20 characters or more is
tried for the encoding it may be in (hex, base32, base64, base64url, alphanumeric) and tested:

* chi-squared: symbol counts against the uniform distribution over the encoding's alphabet; as a token has few symbols for
  its alphabet, the tail is the exact one of the statistic up to EXACT symbols of the alphabet, and beyond that of
  the gamma distribution with the statistic's own mean, variance and skewness,
* runs: Wald-Wolfowitz runs above and below the alphabet's middle,
* serial correlation of neighbouring symbols.

A token that any test rejects as random (Bonferroni over the three) is left. For those that remain, the null hypothesis
is "this is written text", for each alphabet in its own way. Over the alphabets of 62 and 64 symbols the chi-squared
statistic of written text has a non-central distribution whose shift grows with the length (index of coincidence of
written language), which gives a p-value. Hex and base32 hold letters of one case, some of them and some of the digits
only; there p is the likelihood ratio of written against uniform symbols, given which places hold letters and which
digits: letters by the frequencies of a written language, whichever of LANGUAGES explains them best, and so that it
counts that text seldom stays within the alphabet. Such a ratio is under r with a probability of at most r; p is that
bound, sharpened by the ratio's normal spread under uniform symbols. Over all documents these are held
against a length-weighted Benjamini-Hochberg threshold: longer tokens carry more weight, weights average one. The
threshold comes from a histogram of p-values (rounded up, so the control is conservative), never from collected candidates.
Lengths count as they are; p-values below the last bin count as found at any number of candidates.

Plan: one scan for the histogram, one for the spans; both are map-only but for the histogram's partial counts.

Rows: a null text counts as empty; very long texts are scanned whole, in time that grows with their length; null ids stay;
repeated rows each get their own result (and count in the threshold as often as they occur); an empty table gives an
empty result; extra columns are not read (redacted() hands them on), so clashing names do not matter. Offsets are code
points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, saved, slices, table

KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
ALPHA = 0.001
#: Length of a token, in alphabets, up to which the uniformity test's tail is exact.
EXACT = 2
MIN_TOKEN = 20
#: Index of coincidence of written European languages.
COINCIDENCE = 0.0655
#: Letters of written languages, a to z, in hundredths of a per cent: English, French, German, Spanish.
LANGUAGES = (
    (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7),
    (764, 90, 326, 367, 1472, 107, 87, 74, 753, 61, 7, 546, 297, 710, 580, 252, 136, 669, 795, 724, 631, 184, 5, 43, 13, 33),
    (652, 189, 273, 508, 1640, 166, 301, 458, 655, 27, 142, 344, 253, 978, 259, 67, 2, 700, 727, 615, 417, 85, 192, 3, 4, 113),
    (1153, 222, 402, 501, 1218, 69, 177, 70, 625, 49, 1, 497, 316, 671, 868, 251, 88, 687, 798, 463, 293, 114, 2, 22, 101, 47),
)
#: Share of letters that follow no language: names, abbreviations.
ANY_LETTER = 0.1
#: Histogram bins: hundredths of -log10(p/weight), from 0.
BINS = 30_000

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ with 16 or more
#: A whole run of token characters. '=' bounds it like any other character; it belongs to it only as base64 padding at its end.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    ("hex", _DIGIT + "abcdef"),
    ("HEX", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("alphanumeric", _UPPER + _LOWER + _DIGIT),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
)
_PLACES = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]


def _log_ratios(chars: str) -> tuple[float, list[tuple[dict[str, float], float, float]]]:
    """The share of digits that chars holds, and for each language: log(probability in written text / uniform over the
    letters of chars) of each letter, and the mean and variance of one uniform letter's."""
    letters = [c for c in chars if c not in _DIGIT]
    out = []
    for counts in LANGUAGES:
        share = {c: (1 - ANY_LETTER) * k / sum(counts) + ANY_LETTER / 26 for c, k in zip(_LOWER, counts)}
        ratios = {c: math.log(share[c.lower()] * len(letters)) for c in letters}
        mean = sum(ratios.values()) / len(letters)
        out.append((ratios, mean, sum((v - mean) ** 2 for v in ratios.values()) / len(letters)))
    return (len(chars) - len(letters)) / 10, out


_WRITTEN = {name: _log_ratios(chars) for name, chars in ALPHABETS if name in ("hex", "HEX", "base32")}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=4096)
def _pair_tails(n: int, k: int) -> np.ndarray:
    """P(pairs >= s) for s = 0, 1, ..: the number of pairs of equal symbols among n uniform ones over an alphabet of k.

    Exactly: n!/k^n times the coefficient of x^n y^s in (sum over c of x^c y^(c(c-1)/2) / c!)^k, by squaring; numbers of
    pairs far beyond the mean share the last place."""
    mean = n * (n - 1) / 2 / k
    most = min(n * (n - 1) // 2, int(mean + 14 * math.sqrt(mean) + 40))
    shape = (2 * n + 2, 2 * most + 2)

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        product = np.fft.irfft2(np.fft.rfft2(a, shape) * np.fft.rfft2(b, shape), shape)
        return np.maximum(product[: n + 1, : most + 1], 0.0)

    # x stands for x * n / k: coefficients near the n-th stay near one.
    one = np.zeros((n + 1, most + 1))
    for c in range(n + 1):
        if c * (c - 1) // 2 <= most:
            one[c, c * (c - 1) // 2] = math.exp(c * math.log(n / k) - math.lgamma(c + 1) - n / k)
    power, result = one, None
    for bit in bin(k)[:1:-1]:
        if bit == "1":
            result = power if result is None else times(result, power)
        power = times(power, power)
    share = result[n] / math.exp(n * math.log(n) - math.lgamma(n + 1) - n)  # of each number of pairs up to most
    return np.clip(1 - np.concatenate([[0.0], np.cumsum(share)]), 0.0, 1.0)


def _pairs_tail(pairs: int, n: int, k: int) -> float:
    """P(as many pairs of equal symbols or more among n uniform ones). The chi-squared statistic over equal expected counts
    is 2 k pairs / n + k - n, so this is its upper tail."""
    if n <= EXACT * k:
        tails = _pair_tails(n, k)
        return float(tails[min(pairs, len(tails) - 1)])
    p, two, three = 1 / k, n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    mean, var = two * p, two * p * (1 - p)
    skew = (two * p * (1 - p) * (1 - 2 * p) + 6 * three * p * p * (1 - p)) / var**1.5
    shape = 4 / skew**2  # of a gamma distribution moved to the mean
    x = shape + 2 / skew * (pairs - 0.5 - mean) / math.sqrt(var)
    return 1.0 if x <= 0 else _normal_tail(((x / shape) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape))


def _ratio_tail(x: list[float], mean: float, variance: float) -> float:
    """Probability that written letters have a log ratio as low as the sum of x, whose mean and variance are those of
    one uniform letter: tilting to uniform letters, where the sum is near normal, gives E[exp(ratio); ratio <= sum]."""
    ratio, sd = sum(x), math.sqrt(len(x) * variance)
    if ratio >= 0:
        return 1.0
    z = (len(x) * mean - ratio) / sd
    y = min(z + sd, 37.0)
    return math.exp(ratio) * min(1.0, math.exp((y * y - z * z) / 2) * _normal_tail(y))


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that the token fits, if it mixes kinds of characters as encoded bytes do."""
    chars = set(token)
    if not (chars & set(_DIGIT) or (chars & set(_UPPER) and chars & set(_LOWER))):
        return None
    if chars <= set(_DIGIT):
        return None
    return next(((name, places) for name, places in _PLACES if chars <= places.keys()), None)


def battery(token: str) -> tuple[float, float] | None:
    """(p that it is random, p that it is written text), or None if no encoding fits."""
    body = token.rstrip("=")
    if len(body) < MIN_TOKEN or not (found := encoding(body)):
        return None
    name, places = found
    k, n = len(places), len(body)
    x = [places[c] for c in body]
    squares = sum(v * v for v in Counter(x).values())
    chi = squares * k / n - n
    p_chi = _pairs_tail((squares - n) // 2, n, k)
    high = [v >= k / 2 for v in x]
    n1 = sum(high)
    n0 = n - n1
    if n0 and n1:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * n0 * n1 / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    mu = sum(x) / n
    var = sum((v - mu) ** 2 for v in x)
    r = sum((a - mu) * (b - mu) for a, b in zip(x, x[1:])) / var if var else 1.0
    p_serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    if name in _WRITTEN:
        stay, languages = _WRITTEN[name]
        letters = [c for c in body if c not in _DIGIT]
        p_text = stay ** (n - len(letters)) * max(_ratio_tail([ratios[c] for c in letters], mean, variance) for ratios, mean, variance in languages)
    else:
        shift = n * (k * COINCIDENCE - 1)
        p_text = _normal_tail((k - 1 + shift - chi) / math.sqrt(2 * (k - 1) + 4 * shift))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial)), max(p_text, 1e-290)


def random_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p of being written text) of the tokens outside base that no test rejects as random."""
    out, at, reach, n = [], 0, 0, len(base)  # reach: the farthest end of base spans that begin before the token's end
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while at < n and base[at][0] < e:
            reach, at = max(reach, base[at][2]), at + 1
        if reach > s:
            continue
        p = battery(m.group())
        if p and p[0] >= ALPHA:
            out.append((s, e, p[1]))
    return out


def _bin(p: float, weight: float) -> int:
    return max(0, min(BINS - 1, math.floor(-100 * math.log10(min(1.0, p / weight)))))


def fit_threshold(docs: DataFrame, fdr: float = FDR, text: str = "text") -> dict:
    """{'mean': mean length of the candidates, 'bin': the least bin that counts as found} over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                if (t := value.as_py()):
                    for s, e, p in random_tokens(t, base_spans(t)):
                        found[e - s, _bin(p, 1.0)] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["length", "bin", "n"])

    # Weights need the mean length, which is known only after the scan: so counts are kept by length and bin.
    counts = saved(docs.select(text).mapInArrow(count, "length int, bin int, n bigint").groupBy("length", "bin").agg(F.sum("n").alias("n")), "p_values")
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.col("length") * F.col("n")).alias("chars")).first()
    if not total.n:
        return {"mean": 1.0, "bin": BINS}
    mean = total.chars / total.n
    moved = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col("bin") + 100 * F.log10(F.col("length") / F.lit(mean)))))
    bins = {r.b: r.n for r in counts.groupBy(moved.cast("int").alias("b")).agg(F.sum("n").alias("n")).collect()}  # at most BINS
    discard(counts)
    rejected, cut = 0, BINS
    for b in sorted(bins, reverse=True):
        rejected += bins[b]
        if total.n * 10 ** (-b / 100) <= fdr * rejected:
            cut = b
    return {"mean": mean, "bin": cut}


def spans_of(text: str | None, threshold: dict) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of all secrets in a text."""
    if not text:
        return []
    base = base_spans(text)
    found = []
    for s, e, p in random_tokens(text, base):
        moved = math.floor(_bin(p, 1.0) + 100 * math.log10((e - s) / threshold["mean"]))
        if min(BINS - 1, max(0, moved)) >= threshold["bin"]:
            found.append((s, 3, e))
    return sorted(base + found) if found else base


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per document: doc_id and spans, an array of (kind, start, end) by start."""
    threshold = fit_threshold(docs, fdr)

    def each(_, ids, texts):
        for i, t in zip(ids, texts):
            yield i, [(KINDS[k], s, e) for s, k, e in spans_of(t, threshold)]

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>", each)


def redact(text: str | None, threshold: dict, mark: str = "[SECRET]") -> str | None:
    """text with every run of overlapping secrets replaced by mark."""
    spans = spans_of(text, threshold)
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """The documents with all their columns, secrets in text replaced by mark, and n_chars, if there, counted anew."""
    threshold = fit_threshold(docs, fdr)
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8_000_000):
            texts = [redact(t, threshold, mark) for t in part.column(columns.index("text")).to_pylist()]
            new = dict(zip(columns, part.columns)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in new:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.column(columns.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays([new[c] for c in columns], names=columns)

    return docs.mapInArrow(run, schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("random").alias("n_random"),
    )
