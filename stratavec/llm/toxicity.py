"""Toxicity: cumulative-link ordinal regression over sparse word features.

Severity y has ordered grades 0..K. One weight vector is shared by all thresholds:
P(y <= k) = sigmoid(theta_k - w.x), theta_1 < ... < theta_K, and the output is the expected severity.

Labels that are only 0 and 1 carry no severity. Then toxic documents of the training sample are graded 1..K by the
sum of their features below (equal thirds for K = 3); labels with more values are used as they are.

Features: log(1 + count) of the indicative words, those whose document frequency differs between toxic and clean
sample rows by a z-score of MIN_Z or more (at most MAX_FEATURES). So a long document does not gather noise.

Plan: the fit uses the SAMPLE_ROWS labelled ids of smallest hash, with one text for each, which bounds what is broadcast
and what reaches the driver; scoring is one map over all whole texts with the weights as a closure of bounded size.

Rows: a null or empty text has no features and gets the score of an empty text; very long texts are read whole; null ids
stay; repeated rows each get their own result; in the fit, an id with several texts counts with the least one, an id
with several labels with the largest; labels that are null, below 0 or of a null id are not used; with no toxic or no
clean label at all every document scores 0; an empty table gives an empty result; extra columns are not read, so
clashing names do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filter_rows, map_rows, saved, table
from .decontaminate import words

#: The fit's bound: labelled rows in the sample.
SAMPLE_ROWS = 20_000
MAX_FEATURES = 4096
MIN_Z = 6.0
GRADES = 3
#: Documents are called toxic from this probability of any grade above 0.
THRESHOLD = 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and y of the documents with the labels of smallest id hash; at most `rows` rows, one for each id."""
    found = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().where("y >= 0").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, n0, n1: clean and toxic sample rows that have the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                found[y.as_py() > 0].update(set(words(text.as_py())))
        keys = list(found[0].keys() | found[1].keys())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([found[0][k] for k in keys], pa.int64()), pa.array([found[1][k] for k in keys], pa.int64())], names=["word", "n0", "n1"])

    return sample.mapInArrow(count, "word binary, n0 bigint, n1 bigint").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def indicative_words(sample: DataFrame, n0: int, n1: int) -> dict[bytes, int]:
    """word -> feature number; the words with the largest z-score for a difference in document frequency."""
    p = (F.col("n0") + F.col("n1")) / F.lit(n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    best = _word_counts(sample).where("n0 + n1 >= 5").select("word", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_FEATURES)
    return {bytes(r.word): i for i, r in enumerate(best.collect())}


def features(text: str | None, known: dict[bytes, int]) -> dict[int, float]:
    found = Counter(w for w in words(text) if w in known)
    return {known[w]: float(np.log1p(n)) for w, n in found.items()}


def fit_ordinal(rows: list[dict[int, float]], y: np.ndarray, n_features: int, grades: int, l2: float = 1e-5, steps: int = 400, rate: float = 0.05) -> dict:
    """Weights (not below zero: each feature indicates toxicity) and thresholds, by Adam on the mean log-likelihood."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([j for r in rows for j in r], np.int64)
    val = np.array([v for r in rows for v in r.values()])
    w, theta = np.zeros(n_features), np.concatenate([[1.0], np.zeros(grades - 1)])  # theta: first threshold, log gaps
    m = [np.zeros_like(w), np.zeros_like(theta)]
    v = [np.zeros_like(w), np.zeros_like(theta)]
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = np.bincount(at, val * w[col], len(rows)) if len(col) else np.zeros(len(rows))
        c = 1 / (1 + np.exp(-np.clip(cuts[None] - s[:, None], -40, 40)))  # P(y <= k), k = 0..K-1
        up = np.concatenate([c, np.ones((len(s), 1))], 1)[np.arange(len(s)), y]
        down = np.concatenate([np.zeros((len(s), 1)), c], 1)[np.arange(len(s)), y]
        p = np.maximum(up - down, 1e-12)
        slope = c * (1 - c)
        du = np.concatenate([slope, np.zeros((len(s), 1))], 1)[np.arange(len(s)), y]
        dd = np.concatenate([np.zeros((len(s), 1)), slope], 1)[np.arange(len(s)), y]
        g_s = (du - dd) / p / len(s)  # of the loss, by s
        g_w = np.bincount(col, val * g_s[at], n_features) + l2 * w if len(col) else l2 * w
        g_c = np.zeros(grades)
        np.add.at(g_c, y[y < grades], -(du / p)[y < grades] / len(s))
        np.add.at(g_c, y[y > 0] - 1, (dd / p)[y > 0] / len(s))
        g_t = np.concatenate([[g_c.sum()], np.exp(theta[1:]) * np.cumsum(g_c[::-1])[::-1][1:]])
        for i, (x, g) in enumerate(((w, g_w), (theta, g_t))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        np.maximum(w, 0, out=w)
    return {"w": w, "cuts": np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, grades: int = GRADES) -> dict | None:
    """The model: {'known', 'w', 'cuts'}; None if the sample has one class only."""
    sample = saved(labelled_sample(docs, labels, label, rows), "labelled")
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), sum(n for y, n in counts.items() if y > 0)
    if not n0 or not n1:
        return None
    known = indicative_words(sample, n0, n1)

    def each(_, texts, ys):
        for t, y in zip(texts, ys):
            x = features(t, known)
            yield list(x), list(x.values()), y

    got = map_rows(sample, ["text", "y"], "j array<int>, v array<double>, y int", each).collect()  # at most `rows`
    discard(sample)
    got.sort(key=lambda r: (r.y, r.j, r.v))
    x = [dict(zip(r.j, r.v)) for r in got]
    y = np.array([r.y for r in got])
    if y.max() == 1:
        total = np.array([sum(r.v) for r in got])
        edges = np.quantile(total[y == 1], np.arange(1, grades) / grades)
        y = np.where(y == 1, 1 + np.searchsorted(edges, total, side="right"), 0)
    else:
        grades = int(y.max())
    return {"known": known} | fit_ordinal(x, y, max(1, len(known)), grades)


def grade_probabilities(model: dict | None, x: dict[int, float]) -> list[float]:
    """P(y > k), k = 0..K-1. Their sum is the expected severity."""
    if model is None:
        return [0.0]
    s = sum(model["w"][j] * v for j, v in x.items())
    return [float(1 / (1 + np.exp(np.clip(c - s, -40, 40)))) for c in model["cuts"]]


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, severity (expected), p_toxic, grade (the likeliest), toxic."""

    def each(_, ids, texts):
        for i, t in zip(ids, texts):
            over = grade_probabilities(model, features(t, model["known"]) if model else {})
            p = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
            yield i, sum(over), over[0], max(range(len(p)), key=lambda k: (p[k], -k)), over[0] >= threshold

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, severity double, p_toxic double, grade int, toxic boolean", each)


def without_toxic(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that are not called toxic."""
    if model is None:
        return docs
    return filter_rows(docs, "text", lambda _, t: grade_probabilities(model, features(t, model["known"]))[0] < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
