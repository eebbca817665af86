"""Approximate nearest neighbours by cosine: balanced posting lists around centroids.

Index: centroids come from a balanced split of a bounded sample (halving at the median of the main direction, then a
few rounds of means). Every row is indexed, in the list of its nearest centroid and, if it lies near a border, in up to
REPLICAS lists: those within BORDER times the nearest distance, unless an accepted centroid is nearer to the new one than
the vector is. Search: a walk of an in-memory neighbour graph over the centroids takes up, for each query, those within
RATIO times the nearest distance found so far (and the LEAST nearest ones); neighbours of centroids farther than that are
never looked at, and their lists are pruned.

Lists are meant to hold LIST_ROWS rows. Where that takes over MAX_LISTS lists, the index has two levels: the lists become
cells, each with centroids and a graph of its own, fitted on a bounded sample of the cell by the tasks that hold it.
Rows and queries go down both levels by the same rules. So lists stay small up to MAX_LISTS**2 * LIST_ROWS rows
(2 * 10**9), and what is broadcast has a fixed bound.

Whatever was pruned, a query has its k neighbours: those that end with fewer than k different ids, though there are more,
are compared with all rows, in blocks.

Skew: list lengths and the numbers of queries per list are counted. A list over BLOCK rows is dealt out in blocks, and
so are its queries, so a task compares at most BLOCK rows with BLOCK queries, however many equal vectors there are.
What reaches the driver is the sample.

Scores are cosines in double precision of the original vectors, summed in one fixed order, so equal vectors tie; vectors
are scaled by powers of two beforehand, so that no square overflows or vanishes.

Rows: vectors that are null, empty, zero, or that hold a null or non-finite component take no part, nor do null ids.
Vectors of different lengths have no cosine and are not compared; those of another length than most are compared with all
of their own length, in blocks. A query takes no candidate of its own id; repeated rows of one id count once (the best
score), and rows of one id that differ take one place among the k. Ties go to the smaller id. Fewer candidates than
k: all of them. An empty table gives an empty result; extra columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_bytes, saved, table

#: The index's bounds: vectors in the sample that centroids are fitted on, for the table and for a cell.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64_000_000
MAX_LISTS = 4096
LIST_ROWS = 128
REPLICAS = 4
BORDER = 1.05
RATIO = 1.27
LEAST = 16
DEGREE = 16
BLOCK = 4096
MODEL_BYTES = 64_000_000


def usable(vectors: Column) -> Column:
    good = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vectors, lambda x: x != 0), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def balanced_centroids(x: np.ndarray, n_lists: int, rounds: int = 3) -> np.ndarray:
    """About n_lists unit centroids of unit vectors x."""
    parts = [np.arange(len(x))]
    while len(parts) < n_lists:
        parts.sort(key=len)
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        c = x[p] - x[p].mean(0)
        d = c[np.argmax((c * c).sum(1))]
        for _ in range(5):
            d = c.T @ (c @ d)
            d /= np.linalg.norm(d) + 1e-30
        order = p[np.argsort(c @ d, kind="stable")]
        parts += [order[: len(p) // 2], order[len(p) // 2 :]]
    c = _unit(np.array([x[p].mean(0) for p in parts]))
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, _unit(total), c)
    return np.unique(c.astype(np.float32), axis=0)


def centroid_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones, and a ring that makes all reachable."""
    n = len(c)
    near = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, 1 : degree + 1]
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n, (np.arange(n) * 7 + 3) % n], 1)
    return np.concatenate([near, ring], 1).astype(np.int32)


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, ratio: float, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each unit query, (ids, distances) of the centroids within `ratio` of the nearest, and of the `least` nearest ones,
    nearest first. All queries go in lockstep: each takes up its nearest centroids that are within these bounds and not
    taken up yet, and looks at their neighbours."""
    n, least = len(c), min(least, len(c))
    entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
    square = np.full((len(q), n), np.inf)  # squared distances of the centroids that were looked at
    square[:, entry] = np.maximum(2 - 2 * (q @ c[entry].T), 0)
    taken, width = np.zeros(square.shape, bool), 4
    while True:
        limit = np.maximum(ratio**2 * square.min(1), np.partition(square, least - 1, 1)[:, least - 1]) + 1e-9
        open_ = np.where(taken | (square > limit[:, None]), np.inf, square)
        some = min(width, n)
        at = np.argpartition(open_, some - 1, 1)[:, :some]
        row, k = np.nonzero(np.isfinite(np.take_along_axis(open_, at, 1)))
        if not len(row):
            break
        at = at[row, k]
        taken[row, at] = True
        new = np.zeros(square.shape, bool)
        new[row[:, None], graph[at]] = True
        row, at = np.nonzero(new & np.isinf(square))
        for i in range(0, len(row), 100_000):
            r, j = row[i : i + 100_000], at[i : i + 100_000]
            square[r, j] = np.maximum(2 - 2 * np.einsum("ij,ij->i", q[r], c[j]), 0)
        width = min(2 * width, 64)
    out = []
    for row, bound in zip(square, limit):
        ids = np.flatnonzero(row <= bound)
        ids = ids[np.argsort(row[ids], kind="stable")]
        out.append((ids, np.sqrt(row[ids])))
    return out


def home_lists(near: np.ndarray, far: np.ndarray, c: np.ndarray) -> list[int]:
    """Of a row's near centroids, nearest first, those whose list it goes to."""
    chosen = [int(near[0])]
    for j, d in zip(near[1:], far[1:]):
        if len(chosen) == REPLICAS or not d <= BORDER * far[0]:
            break
        if all(2 - 2 * float(c[j] @ c[k]) > d * d for k in chosen):
            chosen.append(int(j))
    return chosen


def lists_of(x: np.ndarray, c: np.ndarray, graph: np.ndarray, probe: bool) -> list[list[int]]:
    """The lists that vectors are kept in, or with probe those that are searched for them."""
    x = _unit(x)
    if probe:
        return [ids.tolist() for ids, _ in walk(x, c, graph, RATIO, LEAST)]
    return [home_lists(*near, c) for near in walk(x, c, graph, BORDER, 4 * REPLICAS)]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def fit_index(vectors: DataFrame) -> dict | None:
    """{'c': centroids, 'graph', 'dim', 'rows': usable rows} from a sample of the usable rows, bounded in rows and bytes.
    dim is the commonest length of vectors, of several such the least."""
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return None
    dim, n = lengths
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    got = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toPandas().embedding
    x = _unit(np.stack(got).astype(np.float64))
    c = balanced_centroids(x, max(1, min(MAX_LISTS, n // LIST_ROWS, len(x))))
    return {"c": c, "graph": centroid_graph(c), "dim": dim, "rows": n}


_LISTED = "vec_id bigint, list bigint, embedding array<double>"


def _assign(vectors: DataFrame, model, probe: bool) -> DataFrame:
    """vec_id, list, embedding: the lists that each row is kept in, or with probe those it searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, graph = model.value["c"].astype(np.float64), model.value["graph"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = lists_of(_matrix(part.column(1)), c, graph, probe)
                take = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array([j for x in lists for j in x], pa.int64()), part.column(1).take(take)], names=["vec_id", "list", "embedding"])

    return vectors.mapInArrow(run, _LISTED)


def fit_cells(postings: DataFrame) -> DataFrame:
    """list, n, c (centroids, one after the other): the second level, fitted on a bounded sample of each cell."""
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"))
    rows = postings.join(sizes, "list")
    rows = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), "n") < F.lit(SAMPLE_ROWS // 4))  # about so many of a cell
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("list").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("at") <= SAMPLE_ROWS)

    def fit(cell: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(cell.embedding))
        n = int(cell.n.iloc[0])
        c = balanced_centroids(x, max(1, min(MAX_LISTS, n // LIST_ROWS, len(x))))
        return pd.DataFrame({"list": [int(cell["list"].iloc[0])], "n": [n], "c": [c.astype(np.float64).ravel()]})

    return rows.select("list", "n", "embedding").groupBy("list").applyInPandas(fit, "list bigint, n bigint, c array<double>")


def _assign_in_cells(rows: DataFrame, cells: DataFrame, probe: bool) -> DataFrame:
    """vec_id, list, embedding of rows that are in cells, by the cells' own centroids; a task holds at most BLOCK rows."""
    blocks = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = rows.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")
    right = cells.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "c")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "list": np.zeros(0, np.int64), "embedding": []})
        x = np.stack(left.embedding)
        c = right.c.iloc[0].reshape(-1, x.shape[1])
        graph, base = centroid_graph(c), int(left["list"].iloc[0]) * MAX_LISTS
        lists = [part for at in range(0, len(x), 512) for part in lists_of(x[at : at + 512], c, graph, probe)]
        take = np.repeat(np.arange(len(x)), [len(p) for p in lists])
        return pd.DataFrame({"vec_id": left.vec_id.to_numpy()[take], "list": [base + j for p in lists for j in p], "embedding": left.embedding.to_numpy()[take]})

    key = ["list", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, _LISTED)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows, in one fixed order of summation."""
    q, x = _scaled(q), _scaled(x)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _nearest(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of each query's k nearest of x, ties to the smaller id."""
    s = _unit(q) @ _unit(x).T
    s[q_ids[:, None] == x_ids[None]] = -np.inf
    order = np.argsort(x_ids, kind="stable")
    first = np.flatnonzero(np.diff(x_ids[order], prepend=x_ids[order[0]] - 1))
    best = s if len(first) == len(x_ids) else np.maximum.reduceat(s[:, order], first, axis=1)  # of each id
    kth = np.partition(best, max(0, best.shape[1] - k), 1)[:, max(0, best.shape[1] - k)]
    a, b = np.nonzero((s >= kth[:, None] - 1e-9) & np.isfinite(s))
    score = np.empty(len(a))
    for i in range(0, len(a), 50_000):
        score[i : i + 50_000] = exact_scores(q[a[i : i + 50_000]], x[b[i : i + 50_000]])
    order = np.lexsort((x_ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    same = np.concatenate([[False], (a[1:] == a[:-1]) & (x_ids[b][1:] == x_ids[b][:-1])]) if len(a) else np.zeros(0, bool)
    a, b, score = a[~same], b[~same], score[~same]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    top = rank < k
    return q_ids[a[top]], x_ids[b[top]], score[top]


def _compare(k: int):
    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        found = _nearest(left.vec_id.to_numpy(), np.stack(left.embedding), right.vec_id.to_numpy(), np.stack(right.embedding), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    return run


def _compared(postings: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: in each list, and block of it, the k nearest rows of each query that searches it."""
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = saved(blocks(postings, "blocks").join(blocks(probes, "q_blocks"), "list"), "lists")
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = postings.join(both, "list").withColumn("block", dealt("blocks")).withColumn("q_block", every("q_blocks")).drop("blocks", "q_blocks")
    q = probes.join(both, "list").withColumn("q_block", dealt("q_blocks")).withColumn("block", every("blocks")).drop("blocks", "q_blocks")
    key = ["list", "block", "q_block"]
    return q.groupBy(*key).cogroup(x.groupBy(*key)).applyInPandas(_compare(k), "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which `queries` holds."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").dropDuplicates()
    rows = saved(rows, "rows").withColumn("embedding", F.col("embedding").cast("array<double>"))
    model = fit_index(rows)
    if model is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = broadcast_bytes(spark, model, model["c"].nbytes + model["graph"].nbytes, MODEL_BYTES, "centroids and graph")
    indexed = rows.where(F.size("embedding") == model["dim"])
    postings, probes = saved(_assign(indexed, shared, False), "postings"), saved(_assign(indexed.where(queries), shared, True), "probes")
    if model["rows"] > MAX_LISTS * LIST_ROWS:
        cells = saved(fit_cells(postings), "cells")
        postings, probes = saved(_assign_in_cells(postings, cells, False), "postings"), saved(_assign_in_cells(probes, cells, True), "probes")
    whole = rows.select("vec_id", (-F.size("embedding")).cast("bigint").alias("list"), "embedding")  # one list for each length
    odd = whole.where(F.col("list") != -model["dim"])
    best = saved(_best(_compared(postings.unionByName(odd), probes.unionByName(odd.where(queries)), k), k), "best")
    ids = whole.groupBy("list").agg(F.countDistinct("vec_id").alias("ids"))
    asked = whole.where(queries).join(ids, "list").groupBy("vec_id").agg(F.max("ids").alias("ids"))
    has = best.groupBy("query_id").agg(F.count("*").alias("has")).withColumnRenamed("query_id", "vec_id")
    short = asked.join(has, "vec_id", "left").where(F.coalesce("has", F.lit(0)) < F.least(F.lit(k), F.col("ids") - 1)).select("vec_id")
    short = saved(whole.join(short, "vec_id", "left_semi"), "short")
    if short.isEmpty():
        return best
    again = _best(_compared(whole, short, k), k)
    return best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
