"""Near-duplicate classes by Order MinHash and banded alignment.

Similarity of two texts: their words are aligned in text order (longest common subsequence); the similarity is
aligned / (all - aligned), an order-sensitive Jaccard of words. Texts are linked from SIMILARITY. Texts without words
are linked to exact copies only.

Sketch (Order MinHash): the k-mers are shingles of five words, each labelled with its number of earlier occurrences. Each
of REPEATS hash functions takes the LEVELS[0] smallest and keeps them in their order in the text; equal tuples are a
bucket. Texts of similarity 0.8 have about 0.39 or more of their shingles in common wherever the edits are, so two of a
text's smallest k-mers agree with probability 0.15 a function, and all 32 miss with 0.6 %; at 0.85 with 0.005 %. A
five-word shingle is too long for short texts: those under SHORT words have tuples of three labelled word pairs instead
(and those near that length both).

Candidates: within a bucket every text is compared with one pivot, the member whose buckets are largest in sum (the
centre of a group of edited copies). What is linked then merges to components, and only buckets that still hold several
components go on: those of at most CROWD texts are compared in full; larger ones, such as those of a passage that many
unlike texts share, are split by longer tuples of the same function (LEVELS), which unlike texts rarely share, and each
part that is still large has a pivot of its own. This only merges cheaply what it can.

The rest of the crowded buckets, those that hold several components even then, is joined exactly: all pairs of their texts
of different components that can be similar are verified. Similar texts have so many words in common (repeated words
counted as often as both have them) that, all words in one fixed order, rare ones first, their first fifths have one in
common, and at places that leave enough words behind (prefix and position filter). A word's list of over CELL_ROWS rows is
dealt to cells of CELL_ROWS by CELL_ROWS rows, but never the largest component of such a list against itself. Pairs whose lengths rule the
similarity out are dropped beforehand, which is exact.

Verification aligns words: by a longest increasing subsequence where none of them repeats, else by a bit-parallel common
subsequence in a band about the diagonal, widened until no alignment good enough could leave it.

Plan: exact copies collapse first (by content hash, combined before the shuffle); sketches are small rows; only texts
that share a bucket are shuffled. Texts meet their pivot in blocks of at most BLOCK_ROWS texts and about BLOCK_WORDS words,
sorted so that a task holds a pivot and a slice of rows at a time. Pivots, bucket sizes and components are grouped
aggregates that combine before the shuffle; no task holds a whole bucket, and the driver sees no links. Ids that pick the
texts are broadcast if they are few, and shuffled with the texts beyond that.

Rows: nodes are contents, not ids. One row per doc_id; repeated rows count once; the classes of the contents of one id
are joined, so that classes divide the ids. Null ids are left out; null counts as the empty text; very long texts are
compared whole; ties (pivots of one score, copies of one id) go to the least; extra columns are not read, so clashing
names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, saved, slices, table
from .components import connected_components
from .hashing import K1, K2, mixed, shingles_of, texts_words, word_hashes

SIMILARITY = 0.8
WIDTH = 5
REPEATS = 32
#: K-mers to a tuple; the later ones split crowded buckets.
LEVELS = (2, 5, 16)
SHORT_WIDTH, SHORT_REPEATS, SHORT_SIZE = 2, 24, 3
#: Words: texts under SHORT have tuples of word pairs, those from LONG tuples of shingles.
SHORT, LONG = 64, 48
CROWD = 16
#: Of a word's list in the exact join; counters that order the words; words with longer lists than a cell, at most.
CELL_ROWS, SLOTS, HOT_WORDS = 1000, 1 << 16, 100_000
BLOCK_ROWS, BLOCK_WORDS = 100, 200_000
SLICE_BYTES = 300_000

_ODD = mixed(np.arange(1, REPEATS + SHORT_REPEATS + 1, dtype=np.uint64) * K1) | np.uint64(1)


def tuples(kmers: np.ndarray, functions: np.ndarray, size: int) -> np.ndarray:
    """For each function, a hash of the `size` smallest labelled k-mers in their order in the text."""
    out, size = [], min(size, len(kmers))
    step = max(1, 2_000_000 // len(kmers))
    for at in range(0, len(functions), step):
        part = functions[at : at + step]
        smallest = np.sort(np.argpartition(kmers[None] * _ODD[part, None], size - 1, 1)[:, :size], 1)
        h = mixed((part.astype(np.uint64) + np.uint64(1)) * K2 + np.uint64(size))
        for k in range(size):
            h = mixed(h * K1 + kmers[smallest[:, k]])
        out.append(h)
    return np.concatenate(out)


def _kmers(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text, its labelled shingles, and its labelled word pairs if it is short."""
    h, counts = word_hashes(texts)
    long = shingles_of(h, counts, WIDTH, labelled=True)
    is_short = counts < SHORT
    short = shingles_of(h[np.repeat(is_short, counts)], counts[is_short], SHORT_WIDTH, labelled=True)
    pairs: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for i, s in zip(np.flatnonzero(is_short).tolist(), short):
        pairs[i] = s
    return counts, long, pairs


def _buckets(n_words: int, shingles: np.ndarray, pairs: np.ndarray, functions: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(functions that apply to a text, their tuples)."""
    wide = functions[functions < REPEATS] if n_words >= LONG else functions[:0]
    narrow = functions[functions >= REPEATS] if 0 < n_words < SHORT else functions[:0]
    found = [tuples(shingles, wide, LEVELS[level])] if len(wide) else []
    if len(narrow):
        found.append(tuples(pairs, narrow, SHORT_SIZE + LEVELS[level] - LEVELS[0]))
    return np.concatenate([wide, narrow]), np.concatenate(found) if found else np.zeros(0, np.uint64)


def _banded(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of a and b over a band that holds all places with |i - j| <= band.

    Bits of x are places of b, 0 where the length grows (Hyyro's bit-parallel recurrence). Rows go in blocks whose window
    of b moves on with them; what leaves a window is counted, what is beyond it has only ones yet."""
    rows = max(64, band)
    x, low, high, length = 0, 0, 0, 0
    for start in range(0, len(a), rows):
        first, end = min(len(b), max(low, start - band)), min(len(b), start + rows + band)
        gone = first - low
        length += gone - (x & ((1 << gone) - 1)).bit_count()
        x = (x >> gone) | (((1 << (end - high)) - 1) << (high - first))
        low, high = first, end
        places: dict[int, int] = {}
        for j in range(low, high):
            places[b[j]] = places.get(b[j], 0) | 1 << (j - low)
        full = (1 << (high - low)) - 1
        for value in a[start : start + rows]:
            if hit := places.get(value, 0) & x:
                x = ((x + hit) | (x - hit)) & full
    return length + high - low - x.bit_count()


def common_length(a: np.ndarray, b: np.ndarray, spare: int) -> int:
    """Length of the longest common subsequence of a and b, or some lesser one if it leaves over `spare` elements out."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    left, right = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    band = min(64, spare)
    while True:  # a subsequence that leaves d elements out never is more than d off the diagonal
        found = _banded(left, right, band)
        if band >= spare or len(left) + len(right) - 2 * found <= band:
            return head + found + tail
        band = min(4 * band, spare)


class Words:
    """A text's words, with what comparisons need of them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.distinct, self.first, self.counts = np.unique(words, return_index=True, return_counts=True)


def aligned_similarity(a: Words, b: Words, at_least: float = SIMILARITY) -> float:
    """aligned / (all - aligned) of two texts' words; 0 where it is below at_least."""
    n = len(a.words) + len(b.words)
    if not n or min(len(a.words), len(b.words)) < at_least * max(len(a.words), len(b.words)) - 1e-9:
        return 0.0
    need = at_least * n / (1 + at_least)  # aligned words that are necessary
    common, at_a, at_b = np.intersect1d(a.distinct, b.distinct, assume_unique=True, return_indices=True)
    n_a, n_b = a.counts[at_a], b.counts[at_b]
    if np.minimum(n_a, n_b).sum() < need - 1e-9:
        return 0.0
    if n_a.max() == 1 and n_b.max() == 1:
        j = b.first[at_b][np.argsort(a.first[at_a])]
        if np.any(np.diff(j) < 0):
            tails: list[int] = []
            for x in j.tolist():
                k = bisect_left(tails, x)
                tails[k : k + 1] = [x]
            aligned = len(tails)
        else:
            aligned = len(j)
    else:
        left, right = a.words[np.isin(a.words, common)], b.words[np.isin(b.words, common)]
        aligned = common_length(left, right, max(0, int(len(left) + len(right) - 2 * need + 1e-6)))
    s = aligned / (n - aligned)
    return s if s >= at_least - 1e-9 else 0.0


def _content(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (content hash), n_words, buckets."""
    functions = np.arange(REPEATS + SHORT_REPEATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            counts, shingles, pairs = _kmers(part.column(2).to_pylist())
            found = [_buckets(n, s, p, functions, 0)[1].view(np.int64) for n, s, p in zip(counts.tolist(), shingles, pairs)]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int32()), lists], names=["doc_id", "node", "n_words", "buckets"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), _content(_text()).alias("node"), _text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, node binary, n_words int, buckets array<bigint>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, f (the function), node, n_words of the buckets that several contents have."""
    f = F.col("pos") + F.when(F.col("n_words") < LONG, F.lit(REPEATS)).otherwise(F.lit(0))
    members = nodes.select("node", "n_words", F.posexplode("buckets").alias("pos", "bucket")).select("bucket", f.cast("tinyint").alias("f"), "node", "n_words")
    return _crowded(members)


def _crowded(members: DataFrame) -> DataFrame:
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(several, "bucket")


def candidate_texts(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, text of the contents that are in some bucket; read by the least id that has the content."""
    needed = saved(nodes.select("node", "doc_id").join(members.select("node").distinct(), "node", "left_semi").select("doc_id").distinct(), "needed")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), _text().alias("text"))
    found = rows.join(broadcast_if_small(needed, 16), "doc_id", "left_semi").select(_content(F.col("text")).alias("node"), "text")
    return found.groupBy("node").agg(F.min("text").alias("text"))  # rows may repeat


def pivot_pairs(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """pivot, node, n_words: whom each content is to be compared with; distinct. The pivot is the member of most
    neighbours."""
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    ranked = members.join(score, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("score", "node", "n_words")).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.n_words").alias("p_words"))
    pairs = members.join(pivots, "bucket").where("pivot <> node").where(_lengths_fit("n_words", "p_words")).select("pivot", "node", "n_words").distinct()
    if roots is None:
        return pairs
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r_{name}"))
    open_ = pairs.join(of("node"), "node", "left").join(of("pivot"), "pivot", "left")
    return open_.where(F.coalesce("r_node", "node") != F.coalesce("r_pivot", "pivot")).select("pivot", "node", "n_words")


def _lengths_fit(a: str, b: str) -> Column:
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-9


_LINKS = "a binary, b binary"


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def pivot_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs (pivot, node) that are similar."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    rows = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(1).alias("place"), "node")
    own = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("place"), F.col("pivot").alias("node"))
    meet = rows.unionByName(own).join(texts, "node").select("pivot", "block", "place", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, words = None, None
        for part in slices(batches, SLICE_BYTES):
            found = []
            keys, nodes = part.column(0).to_pylist(), part.column(3).to_pylist()
            for key, place, node, w in zip(keys, part.column(2).to_pylist(), nodes, map(Words, texts_words(part.column(4).to_pylist()))):
                if not place:  # a block begins with its pivot
                    pivot, words = key, w
                elif key == pivot and aligned_similarity(words, w):
                    found.append((key, node))
            yield _links(found)

    return meet.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "place").mapInArrow(run, _LINKS)


def crowd_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of similar members (bucket, node, root) of buckets of at most CROWD texts; equal buckets count once."""
    lists = members.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("m")).select(F.xxhash64("m").alias("crowd"), "m")
    rows = lists.dropDuplicates(["crowd"]).select("crowd", F.explode("m").alias("m")).select("crowd", "m.node", "m.root").join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd, held = None, []
        for part in slices(batches, SLICE_BYTES):
            found = []
            columns = [c.to_pylist() for c in part.columns[:3]]
            for key, node, root, w in zip(*columns, map(Words, texts_words(part.column(3).to_pylist()))):
                if key != crowd:
                    crowd, held = key, []
                for other in held:
                    if other[1] != root and aligned_similarity(other[2], w):
                        found.append((other[0], node))
                        was = other[1]
                        for o in held:
                            if o[1] == was:
                                o[1] = root
                held.append([node, root, w])
            yield _links(found)

    return rows.select("crowd", "node", "root", "text").repartition("crowd").sortWithinPartitions("crowd").mapInArrow(run, _LINKS)


def split_buckets(members: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """bucket, f, node, n_words by the tuples of a later level, of the same functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            counts, shingles, pairs = _kmers(part.column(1).to_pylist())
            out: list[list] = [[], [], [], []]
            for node, fs, n, s, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), counts.tolist(), shingles, pairs):
                f, bucket = _buckets(n, s, p, np.array(sorted(fs)), level)
                for column, values in zip(out, (bucket.view(np.int64).tolist(), f.tolist(), [node] * len(f), [n] * len(f))):
                    column += values
            types = (pa.int64(), pa.int8(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["bucket", "f", "node", "n_words"])

    per_node = members.groupBy("node").agg(F.collect_set("f").alias("fs"))  # at most one of each function
    found = per_node.join(texts, "node").select("node", "text", "fs").mapInArrow(run, "bucket bigint, f tinyint, node binary, n_words int")
    return found


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """bucket, f, node, n_words, root, n: the members of the buckets that hold several components."""
    members = members.select("bucket", "f", "node", "n_words")
    members = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("z"), F.count("*").alias("n")).where("x < z").select("bucket", "n")
    return members.join(several, "bucket")


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64) % SLOTS


def word_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of the labelled words of column text, by slots of their hashes. They only put frequent words last, so
    words that share a slot do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for part in slices(batches, SLICE_BYTES):
            words = np.concatenate(shingles_of(*word_hashes(part.column(0).to_pylist()), 1, labelled=True))
            counts += np.bincount(_slots(words), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for slot, n in texts.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out


def rare_words(rest: DataFrame, counts: np.ndarray) -> DataFrame:
    """word, place, node, root, n_words: of each text (node, root, text) as many of the rarest labelled words as a similar
    text may lack, and one more, with their places in the order."""
    shared = rest.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            texts = shingles_of(*word_hashes(part.column(2).to_pylist()), 1, labelled=True)
            kept = [words[np.lexsort((words, shared.value[_slots(words)]))[: int((1 - SIMILARITY) * len(words) + 1e-6) + 1]] for words in texts]
            n = [len(k) for k in kept]
            row = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.concatenate([np.arange(k) for k in n])
            columns = [pa.array(np.concatenate(kept).view(np.int64)), pa.array(place, pa.int32()), part.column(0).take(row), part.column(1).take(row)]
            lengths = pa.array(np.repeat([len(words) for words in texts], n), pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, lengths], names=["word", "place", "node", "root", "n_words"])

    return rest.select("node", "root", "text").mapInArrow(run, "word bigint, place int, node binary, root binary, n_words int")


def long_lists(words: DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of the words with more rows than a cell has, in order: the word, its most frequent root, and into how many blocks its
    other rows (0 if it has none) and those of that root are dealt. Cells grow with the table, so that these words are HOT_WORDS
    at most."""
    cell = max(CELL_ROWS, -(-words.count() // HOT_WORDS))
    per_root = words.groupBy("word", "root").agg(F.count("*").alias("n"))
    lists = per_root.groupBy("word").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).where(F.col("n") > cell)
    found = sorted(lists.select("word", F.col("main.root").alias("root"), (F.col("n") - F.col("main.n")).alias("others"), F.col("main.n").alias("mains")).collect())
    blocks = lambda column: -(-np.array([r[column] for r in found], np.int64) // cell)
    return np.array([r[0] for r in found], np.int64), [bytes(r[1]) for r in found], blocks("others"), blocks("mains")


def dealt_words(words: DataFrame) -> DataFrame:
    """words with block, others, mains: the block of its list that a row is in, and how many the list has of other roots and,
    beyond these, of its most frequent root. Short lists are one block; long ones of one root, which have no pairs, are left out.

    The long lists are looked up in a broadcast, as a join would shuffle and give every row of the table for them."""
    shared = words.sparkSession.sparkContext.broadcast(long_lists(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, main, others, mains = shared.value
        for part in batches:
            n = part.num_rows
            block, n_others, n_mains = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
            rows = np.flatnonzero(np.isin(part.column(0).to_numpy(), long))
            if len(rows):
                at = np.searchsorted(long, part.column(0).to_numpy()[rows])
                node = np.frombuffer(b"".join(part.column(2).take(pa.array(rows)).to_pylist()), np.uint64)[::2]  # of 16 bytes
                is_main = np.array([root == main[k] for root, k in zip(part.column(3).take(pa.array(rows)).to_pylist(), at.tolist())])
                of_main, of_others = (node % blocks[at].clip(1).astype(np.uint64) for blocks in (mains, others))
                block[rows] = np.where(is_main, others[at] + of_main.astype(np.int64), of_others.astype(np.int64))
                n_others[rows], n_mains[rows] = others[at], mains[at]
            columns = [*part.columns, *(pa.array(c, pa.int32()) for c in (block, n_others, n_mains))]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "block", "others", "mains"]).filter(pa.array(n_others > 0))

    columns = words.select("word", "place", "node", "root", "n_words")
    return columns.mapInArrow(run, "word bigint, place int, node binary, root binary, n_words int, block int, others int, mains int")


def pairs_of_rare_words(words: DataFrame) -> DataFrame:
    """pivot, node, n_words: all pairs of texts of different roots that may be similar by a rare word of both; distinct.

    Of a long list, the rows of its most frequent root (blocks from `others` on) meet the others only."""
    rows = saved(dealt_words(words), "cells")
    of = lambda end: [F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "n_words", "place")]
    a = rows.where("block < others").select("word", F.col("block").alias("low"), F.explode(F.expr("sequence(block, others + mains - 1)")).alias("high"), *of("a"))
    b = rows.select("word", F.explode(F.expr("sequence(0, least(block, others - 1))")).alias("low"), F.col("block").alias("high"), *of("b"))
    left = F.least(F.col("n_words_a") - F.col("place_a"), F.col("n_words_b") - F.col("place_b"))
    enough = left >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_words_a") + F.col("n_words_b")) - 1e-6
    met = a.join(b, ["word", "low", "high"]).where("root_a <> root_b AND (low < high OR node_a < node_b)").where(enough)
    return met.select(F.col("node_a").alias("pivot"), F.col("node_b").alias("node"), F.col("n_words_b").alias("n_words")).distinct()


def exact_links(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of all similar texts of different roots in rest (node, root)."""
    rest = saved(rest.join(texts, "node"), "rest")
    words = saved(rare_words(rest, word_counts(rest)), "words")
    pairs = saved(pairs_of_rare_words(words), "pairs")
    discard(words, rest)
    found = saved(pivot_links(pairs, texts), "links")
    discard(pairs)
    return found


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after more links (a, b)."""
    if roots is None:
        return saved(connected_components(links), "roots")
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = saved(connected_components(ends.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))), "moved")
    new = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return saved(known.unionByName(moved.join(roots, "node", "left_anti")), "roots")


def content_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_words, buckets of all rows; node, root of the contents that are linked to others)."""
    rows = saved(sketches(docs), "sketches")
    nodes = saved(rows.groupBy("node").agg(F.min(F.struct("doc_id", "n_words", "buckets")).alias("r")).select("node", "r.*"), "nodes")
    members = saved(shared_buckets(nodes), "buckets")
    texts = saved(candidate_texts(docs, nodes, members), "texts")

    def by_pivots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        pairs = saved(pivot_pairs(members, roots), "pairs")
        found = saved(pivot_links(pairs, texts), "links")
        discard(pairs)
        return found

    roots = merged(None, by_pivots(members, None))
    links, crowded, last = [], None, members
    for level in range(len(LEVELS)):  # at level 0 all have met a pivot
        members = last if not level else split_buckets(many, texts, level)
        open_ = saved(_open(members, roots), "open")
        if last is not crowded:
            discard(last)
        few, many, last = open_.where(F.col("n") <= CROWD), open_.where(F.col("n") > CROWD), open_
        crowded = crowded if level else open_
        if not few.isEmpty():
            links.append(saved(crowd_links(few, texts), "links"))
        if many.isEmpty():
            break
        if level:
            links.append(by_pivots(many, roots))
    if links:
        roots = merged(roots, _union(links))
    rest = saved(_open(crowded.where(F.col("n") > CROWD), roots).select("node", "root").distinct(), "rest")
    if not rest.isEmpty():
        roots = merged(roots, exact_links(rest, texts))
    discard(texts, nodes, rest)
    return rows, roots


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of each document's class."""
    rows, roots = content_classes(docs)
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = saved(rows.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").select("a", "b"), "same_id")
    if not same_id.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same_id))
    classed = _with_root(rows, roots)
    least = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return classed.join(least, "root").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class of contents, with all its columns: that of the smallest doc_id, of its contents in the class
    the one of least hash, and of equal ids and contents the row of least hash. An id whose contents are in several
    classes keeps a row for each, so no content goes without a near duplicate that stays. Rows with a null id stay."""
    rows, roots = content_classes(docs)
    first = _with_root(rows, roots).groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("r")).select("r.*")
    repeated = rows.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    first = saved(first.join(repeated, ["doc_id", "node"]).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), "n"), "first")
    mine = (F.col("doc_id").cast("bigint") == F.col("__id")) & (_content(_text()) == F.col("__node"))
    kept = docs.join(broadcast_if_small(first.where("n = 1").drop("n"), 64), mine, "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    several = first.where("n > 1").drop("n")
    if several.isEmpty():
        return kept
    least = docs.join(several, mine).groupBy("__id", "__node").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
    return kept.unionByName(least.select("r.*"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
