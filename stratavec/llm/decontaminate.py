"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``width`` consecutive words of a benchmark item; an item with fewer words, but not none, is one window.
For exact containment all words of a window must occur in the document, so the necessary prefix is a single word: the
window's rarest one, where rarity is the word's document frequency over all documents. Occurrences of that word give
the only possible window start (positional bound), which must leave room for the whole window (length bound); then
the words are compared.

Plan: the benchmark's windows are made, rid of repeats and given their rarest word by jobs over the benchmark; for that
one scan counts documents per benchmark word (partial counts per task, so what is shuffled is at most a vocabulary per
task). Windows, not items or rows, are dealt to blocks by hash, so a block is bounded however long an item is and however
often it repeats; a block's size is measured on what is broadcast. A scan matches the documents, which are never
shuffled. A benchmark of several blocks has a scan for each, whose tasks hold that block only; the hits of equal rows
are then put together by id and text hash.

Rows: a null or empty text has no words and gets zeros and empty lists; null ids stay; very long texts are matched whole;
repeated rows each get their own result; items without words never match; rows of one item id are one item; a null item_id
counts as an item without a name: it is in the count, but not in the list of names. An empty benchmark leaves all
documents clean, an empty table gives an empty result; extra columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_bytes, filter_rows, map_rows, saved, table

WIDTH = 10
#: Bytes of windows, and of words, that one block is planned for; what is broadcast may be up to BLOCK_LIMIT times that.
BLOCK_BYTES = 16_000_000
BLOCK_LIMIT = 8
#: Bytes that a window takes in a block beside its text, about.
WINDOW_BYTES = 100

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = "doc_id bigint, n_words bigint, starts array<int>, ends array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8: runs of digits, a-z and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(item_words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    if len(item_words) <= width:
        return {tuple(item_words)} if item_words else set()
    return {tuple(item_words[i : i + width]) for i in range(len(item_words) - width + 1)}


def _planned(rows: DataFrame, n_bytes, block_bytes: int) -> int:
    return max(1, -(-(rows.agg(F.sum(n_bytes)).first()[0] or 0) // block_bytes))


def _block(rows: DataFrame, columns: list[str], n_blocks: int, b: int) -> DataFrame:
    return rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64(*columns), F.lit(n_blocks)) == b)


def document_frequency(docs: DataFrame, vocabulary: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, n: over all documents, in how many each word of the vocabulary (word) occurs; a scan for each block of it."""

    def counts(known) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, found = known.value, Counter()
            for batch in batches:
                for text in batch.column(0):
                    if (t := text.as_py()):
                        found.update(wanted.intersection(words(t)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

    n_blocks = _planned(vocabulary, F.octet_length("word") + 40, block_bytes)
    out = None
    for b in range(n_blocks):
        known = pickle.dumps(frozenset(bytes(r.word) for r in _block(vocabulary, ["word"], n_blocks, b).collect()))  # one block
        part = counts(broadcast_bytes(docs.sparkSession, pickle.loads(known), len(known), BLOCK_LIMIT * block_bytes, "block of words"))
        out = part if out is None else out.unionByName(part)
    return out


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id (string), window (its words, joined by blanks): distinct."""

    def each(_, ids, texts):
        for i, text in zip(ids, texts):
            for w in windows(words(text), width):
                yield i, b" ".join(w)

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).distinct()
    return map_rows(items, ["item_id", "text"], "item_id string, window binary", each).distinct()


def prefixed_windows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, window, word, place: the windows all of whose words occur in some document, with the rarest and its place."""

    def split(_, texts):
        for w in texts:
            for place, word in enumerate(w.split()):
                yield w, place, word

    found = saved(benchmark_windows(benchmark, width), "windows")
    places = saved(map_rows(found.select("window").distinct(), ["window"], "window binary, place int, word binary", split), "places")
    rarity = document_frequency(docs, places.select("word").distinct(), block_bytes)
    rarest = places.join(rarity, "word", "left").groupBy("window").agg(F.min(F.struct("n", "word", "place")).alias("r"), F.count_if(F.col("n").isNull()).alias("lost"))
    rarest = rarest.where("lost = 0").select("window", "r.word", "r.place")
    return saved(found.join(rarest, "window").select("item_id", "window", "word", "place"), "prefixed")


def _index(rows) -> dict:
    """rarest word -> [(its place in the window, the window's words, its items)]."""
    owners: dict[tuple, list] = defaultdict(list)
    for item, window, word, place in rows:
        owners[bytes(word), place, bytes(window)].append(item)
    index = defaultdict(list)
    for (word, place, window), ids in owners.items():
        index[word].append((place, window.split(), ids))
    return dict(index)


def _match(ws: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items = [], set()
    present = index.keys() & set(ws)
    if present:
        n = len(ws)
        for i, word in enumerate(ws):
            if word in present:
                for at, window, ids in index[word]:
                    s, e = i - at, i - at + len(window)
                    if s >= 0 and e <= n and ws[s:e] == window:
                        spans.append((s, e))
                        items.update(ids)
    return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def broadcast_indexes(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark's windows by their rarest word in docs: one broadcast per block of windows."""
    rows = prefixed_windows(docs, benchmark, width, block_bytes)
    n_blocks = _planned(rows, F.octet_length("window") + WINDOW_BYTES, block_bytes)
    blocks = []
    for b in range(n_blocks):
        index = _index(_block(rows, ["window", "item_id"], n_blocks, b).collect())  # one block
        blocks.append(broadcast_bytes(docs.sparkSession, index, len(pickle.dumps(index)), BLOCK_LIMIT * block_bytes, "block of windows"))
    return blocks


def _named(items: set) -> list:
    return sorted(i for i in items if i is not None) + [None] * (None in items)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, the merged hit spans as word positions (starts, ends), and the hit items' ids; a null
    one comes last."""
    blocks = broadcast_indexes(docs, benchmark, width, block_bytes)

    def each(index, ids, texts):
        for i, text in zip(ids, texts):
            ws = words(text)
            spans, items = _match(ws, index)
            spans = _merge(spans)
            yield i, len(ws), [s for s, _ in spans], [e for _, e in spans], _named(items)

    if len(blocks) == 1:
        return map_rows(docs, ["doc_id", "text"], HITS, each, setup=lambda: blocks[0].value)
    key = F.xxhash64("doc_id").alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")  # equal rows have equal hits
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *key)
    hits = None
    for block in blocks:
        found = _hits_of_block(rows, block)
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("i", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # one per block
    counted = map_rows(rows, ["doc_id", "text", "i", "t"], "doc_id bigint, n_words bigint, i bigint, t string", lambda _, ids, texts, i, t: zip(ids, (len(words(x)) for x in texts), i, t))

    def merge(_, ids, n_words, spans, items):
        for i, n, s, found in zip(ids, n_words, spans, items):
            merged = _merge([(x["s"], x["e"]) for x in s or []])
            yield i, n, [a for a, _ in merged], [b for _, b in merged], _named(set(found or []))

    return map_rows(counted.join(hits, ["i", "t"], "left"), ["doc_id", "n_words", "spans", "items"], HITS, merge)


def _hits_of_block(rows: DataFrame, block) -> DataFrame:
    """i, t, spans, items of the rows that one block hits; once for equal rows."""

    def each(index, i, t, texts):
        for a, b, text in zip(i, t, texts):
            spans, items = _match(words(text), index)
            if spans:
                yield a, b, [{"s": s, "e": e} for s, e in _merge(spans)], list(items)

    schema = "i bigint, t string, spans array<struct<s:int,e:int>>, items array<string>"
    return map_rows(rows, ["i", "t", "text"], schema, each, setup=lambda: block.value).dropDuplicates(["i", "t"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window occurs; one filter after the other for several blocks."""
    for block in broadcast_indexes(docs, benchmark, width, block_bytes):
        docs = filter_rows(docs, "text", lambda index, text: not _match(words(text), index)[0], setup=lambda block=block: block.value)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
lens AS (SELECT DISTINCT n FROM x),
p AS (SELECT rid, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n),
g AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM p),
h AS (SELECT g.rid, g.n, g.i, x.item_id FROM g JOIN x ON g.n = x.n AND g.g = x.g),
hw AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
