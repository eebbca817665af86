"""Quality by importance resampling: target and raw text as hashed n-gram models, sampled by Gumbel top-k.

Words and word pairs are hashed to BUCKETS. The raw model counts all documents, the target model the documents of a
bounded sample of those labelled good. A document's log importance is the log ratio of its probability under the two
models: the sum of its n-grams' smoothed log ratios. (An option, off by default, tempers it for long texts: the mean log
ratio times at most `effective` n-grams.) Adding Gumbel noise, fixed by seed and doc_id, and keeping the k largest keys
samples k documents without replacement in proportion to their importance.

Plan: one scan counts (each task sends one vector of BUCKETS per model), one scan scores. The k-th largest key is found
on the saved keys by a histogram of fixed size that is refined until one value is left; rows that tie there are divided by
id in the same way, and equal rows by the number that they were saved under. Nothing is sorted, and no key reaches the
driver but the bounds of bins.

Rows: null and empty texts have no n-grams and log importance 0; very long texts are read whole; null ids are a key like
any other; repeated rows have equal keys and fall on the same side unless the sample's edge lies between them, where
any of the equal rows is taken; no good label at all makes all ratios 0 (a uniform sample); labels with a null id or
label are not used; an empty table gives an empty result; extra columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table
from .hashing import K1, K2, mixed

BUCKETS = 10_000
#: The target model's bound: labelled rows in the sample.
SAMPLE_ROWS = 20_000
SMOOTHING = 1.0
SLICE_BYTES = 200_000

_CLASS = np.array([1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0 if b in b" \t\n\r\0" else 2 for b in range(256)], np.uint8)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def ngram_buckets(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word and word pair, number of the text that it is in). Words are runs of letters and digits
    (A-Z folded) or of other printable characters."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    kind = _CLASS[data]
    word_start = np.flatnonzero((kind > 0) & (np.concatenate([[0], kind[:-1]]) != kind))
    if not len(word_start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_of = np.cumsum((kind > 0) & (np.concatenate([[0], kind[:-1]]) != kind)) - 1
    inside = kind > 0
    at = np.flatnonzero(inside)
    place = (at - word_start[word_of[at]]).astype(np.uint64)
    value = mixed((_FOLD[data[at]].astype(np.uint64) + np.uint64(1)) * K1 + place * K2)
    cut = np.flatnonzero(np.concatenate([[True], word_of[at][1:] != word_of[at][:-1]]))
    h = np.add.reduceat(value, cut)
    doc = np.searchsorted(starts, word_start, side="right") - 1
    together = doc[1:] == doc[:-1]
    pair = mixed(h[:-1] * K1 + h[1:])[together]
    return np.concatenate([mixed(h) % np.uint64(buckets), pair % np.uint64(buckets)]).astype(np.int64), np.concatenate([doc, doc[1:][together]])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) per bucket."""
    good = labels.where(F.col(label) > 0).select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("_good", F.lit(True))
    flagged = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in slices(batches, SLICE_BYTES):
            at, doc = ngram_buckets(part.column(0).to_pylist(), buckets)
            raw += np.bincount(at, minlength=buckets)
            good = np.array(part.column(1).to_pylist(), bool)
            target += np.bincount(at[good[doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    got = flagged.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in got:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if not any(r.target for r in got):
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 0, effective: int | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_importance, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            ids = part.column(0).to_pylist()
            at, doc = ngram_buckets(part.column(1).to_pylist(), len(ratio))
            n = np.bincount(doc, minlength=len(ids))
            log_w = np.bincount(doc, ratio[at], len(ids))
            if effective is not None:
                log_w *= np.minimum(n, effective) / np.maximum(n, 1)
            row = np.array([(0x5851F42D4C957F2D if i is None else i) & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64)
            u = (mixed(mixed(row + K1) + np.uint64(seed)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(log_w), pa.array(log_w - np.log(-np.log(u)))], names=["doc_id", "n_ngrams", "log_importance", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_ngrams bigint, log_importance double, key double")


def _kth(rows: DataFrame, column: str, k: int, bins: int) -> tuple:
    """(t, n): the k-th largest value of a column without nulls, and how many are larger; 1 <= k <= rows."""
    a, b = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while a < b:
        # Bins by rounded quotients: whatever the rounding, a larger value is never in a smaller bin.
        at = F.least(F.lit(bins - 1), F.floor((F.col(column).cast("double") - float(a)) / max((float(b) - float(a)) / bins, 5e-324))).cast("int")
        inside = rows.where(F.col(column).between(F.lit(a), F.lit(b)))
        found = {r.b: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("z")).collect()}
        if len(found) == 1:  # values that are too close for doubles: halve between them
            middle = a + (b - a) // 2 if isinstance(a, int) else a
            n = inside.where(F.col(column) > F.lit(middle)).count()
            a, b, above = (middle + 1, b, above) if above + n >= k else (a, middle, above + n)
            continue
        for bin_ in sorted(found, reverse=True):
            if above + found[bin_].n >= k:
                a, b = found[bin_].a, found[bin_].z
                break
            above += found[bin_].n
    return a, above


def top_k(keys: DataFrame, k: int, bins: int = 4096) -> DataFrame:
    """The k rows of largest key, ties to the smaller doc_id (null first), then to the smaller row (saved row number)."""
    n = keys.count()
    if k >= n:
        return keys
    if k <= 0:
        return keys.limit(0)
    key, above = _kth(keys, "key", k, bins)
    rest, tied = k - above, keys.where(F.col("key") == F.lit(key))
    sure, nulls = F.col("key") > F.lit(key), tied.where("doc_id IS NULL").count()
    edge = F.col("key") == F.lit(key)
    if rest <= nulls:
        edge &= F.col("doc_id").isNull()
    else:
        ids = tied.where("doc_id IS NOT NULL").withColumn("back", F.bitwise_not("doc_id"))  # the smaller the id, the larger
        last, before = _kth(ids, "back", rest - nulls, bins)
        sure |= edge & (F.col("doc_id").isNull() | (F.col("doc_id") < F.lit(~last)))
        edge &= F.col("doc_id") == F.lit(~last)
        rest -= nulls + before
    row, _ = _kth(keys.where(edge).withColumn("row", -F.col("row")), "row", rest, bins)
    return keys.where(F.coalesce(sure | (edge & (F.col("row") <= F.lit(-row))), F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 0, effective: int | None = None) -> DataFrame:
    """The sampled documents: doc_id, n_ngrams, log_importance, key. The sample's size is fraction of the rows; by
    default the share of good ones among the labels."""
    if fraction is None:
        got = labels.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
        fraction = 1.0 if got is None else got
    keys = saved(score(docs, fit(docs, labels), seed, effective).withColumn("row", F.monotonically_increasing_id()), "importance")
    return top_k(keys, round(fraction * keys.count())).drop("row")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
