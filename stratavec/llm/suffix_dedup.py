"""Removal of repeated byte strings, by sorting suffixes.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. So each
place that such a string starts at needs the least doc_id among equal strings: they lie next to each other when the
suffixes are sorted to LENGTH bytes.

What is sorted where: every window of LENGTH bytes is keyed by the least hash of the SEED-byte strings in it, so equal
windows have equal keys, and neighbouring windows mostly share one (a run of about 14 windows). Only keys that two documents
have can matter; a grouped minimum finds them, and the texts' runs with such keys go to the key's task as one short
string each. There equal strings collapse, and the suffixes of those left are sorted by deep-shallow sorting: a multikey
quicksort down to SHALLOW bytes (characters of eight bytes, three-way partition about a median, in lockstep over all groups;
groups of up to SMALL are finished by one plain sort), then blind tries for the groups that are still equal: a suffix
goes down by branching bytes alone, is compared once with the leaf that it comes to, and branches off where they differ.

Skew: a key with over HOT runs does not go to one task. Its strings collapse by a grouped minimum (combined before the
shuffle); the windows of the distinct ones are dealt out by their hash, so that equal windows meet in one split and all
splits are alike, sorted there in the same way, and what is found goes back by joins that AQE splits. So a passage or a
copy that a third of all documents hold is never gathered.

Rows: a null text is empty; null ids take no part in matches and nothing is removed from them; repeated rows never match each other,
as no id is smaller (an id must not have several different texts); texts of under LENGTH bytes stay whole; very long ones
are read whole; an empty table gives an empty result; extra columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, slices, table
from .hashing import K1, mixed

LENGTH = 50
SEED = 24
SHALLOW = 16
SMALL = 1000
HOT = 20_000
#: Windows of hot keys that a split is meant to have.
SPLIT_ROWS = 200_000
SLICE_BYTES = 2_000_000
CHUNK_ROWS = 60_000
#: Windows that are hashed at a time, so that the arrays stay in the processor's cache.
KEYS_AT_ONCE = 50_000

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * K1)
_B = [np.uint64(pow(0x2545F4914F6CDD1D, k, 2**64)) for k in range(33)]


def window_keys(data: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the least hash of its SEED-byte strings."""
    h = {1: _BYTE[data]}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * _B[k] + h[k][k:]
    seed = h[16][:-8] * _B[8] + h[8][16:]
    n = LENGTH - SEED + 1  # seeds in a window
    least, width = seed, 1
    while 2 * width <= n:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[: len(least) - (n - width)], least[n - width :])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start in it, windows, key) of the maximal runs of windows with one key, cut at
    LENGTH - SEED + 1 windows."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    keys = np.empty(len(data) - LENGTH + 1, np.uint64)
    for at in range(0, len(keys), KEYS_AT_ONCE):
        keys[at : at + KEYS_AT_ONCE] = window_keys(data[at : at + KEYS_AT_ONCE + LENGTH - 1])
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    n_windows = np.maximum(lengths - LENGTH + 1, 0)
    new = np.empty(len(keys) + LENGTH, bool)
    new[0], new[1 : len(keys)], new[len(keys) :] = True, keys[1:] != keys[:-1], True
    new[begin[begin < len(new)]] = True
    new[(begin + n_windows)[n_windows > 0]] = True  # what follows reaches into the next text
    first = np.flatnonzero(new)
    doc = np.searchsorted(begin, first, side="right") - 1
    good = first - begin[doc] < n_windows[doc]
    n = np.diff(np.append(first, len(new)))[good]
    first, doc = first[good], doc[good]
    longest = LENGTH - SEED + 1
    if n.max(initial=0) > longest:
        pieces = -(-n // longest)
        within = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * longest
        first, doc, n = np.repeat(first, pieces) + within, np.repeat(doc, pieces), np.minimum(np.repeat(n, pieces) - within, longest)
    return doc, first - begin[doc], n, keys[first]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("d"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))


def document_keys(texts: DataFrame, distinct: bool) -> DataFrame:
    """d, key of the runs of each document; distinct: a key once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            doc, _, _, key = runs(part.column(1).to_pylist())
            if len(doc):
                if distinct:
                    order = np.lexsort((key, doc))
                    doc, key = doc[order], key[order]
                    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
                    doc, key = doc[first], key[first]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(key.view(np.int64))], names=["d", "key"])

    return texts.mapInArrow(run, "d bigint, key bigint")


def shared_keys(texts: DataFrame) -> DataFrame:
    """key, hot: the keys that occur in two documents or more."""
    found = document_keys(texts, False).groupBy("key").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("n"))
    return found.where("a < z").select("key", (F.col("n") > HOT).alias("hot"))


def wanted_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """d, keys: the shared keys (key, hot) of each document, as many as it has."""
    return document_keys(texts, True).join(keys, "key").groupBy("d").agg(F.collect_list(F.struct("key", "hot")).alias("keys"))


def shared_runs(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, hot, d, start, x: the runs whose key is shared, as the bytes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            raw = part.column(1).to_pylist()
            doc, start, n, key = runs(raw)
            lists = part.column(2)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            want, hot = flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("hot").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(raw)), np.diff(ends))
            keep = np.flatnonzero(np.isin(key, want))
            if not len(keep):
                continue
            # (document, key) pairs by a common code, then whether the run's pair is wanted
            codes = np.unique(want)
            have = owner * len(codes) + np.searchsorted(codes, want)
            order = np.argsort(have)
            have, hot = have[order], hot[order]
            mine = doc[keep] * len(codes) + np.searchsorted(codes, key[keep])
            at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
            good = have[at] == mine
            keep, at = keep[good], at[good]
            x = [raw[i][s : s + c + LENGTH - 1] for i, s, c in zip(doc[keep].tolist(), start[keep].tolist(), n[keep].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[keep].view(np.int64)), pa.array(hot[at]), part.column(0).take(pa.array(doc[keep])), pa.array(start[keep].astype(np.int32)), pa.array(x, pa.binary())],
                names=["key", "hot", "d", "start", "x"],
            )

    return texts.join(wanted, "d").select("d", "text", "keys").mapInArrow(run, "key bigint, hot boolean, d bigint, start int, x binary")


def _quicksort(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows sorted by group and key, groups being together already, and which begin another (group, key).
    Three-way partition about a median of three, in lockstep over the groups of over SMALL rows."""
    order = np.arange(len(key))
    new = np.concatenate([[True], group[1:] != group[:-1]])
    done = np.zeros(len(key), bool)  # rows that equalled a pivot
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        big = (size > SMALL) & ~done[first]
        if not big.any():
            break
        at, size = first[big], size[big]
        a, b, c = key[order[at]], key[order[at + size // 2]], key[order[at + size - 1]]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        live = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
        k = key[order[live]]
        side = (k >= pivot).astype(np.int64) + (k > pivot)
        code = np.repeat(np.arange(len(at)), size) * 3 + side
        within = np.argsort(code, kind="stable")
        order[live], code = order[live][within], code[within]
        new[live[1:]] |= code[1:] != code[:-1]
        done[live] = code % 3 == 1
    block = np.cumsum(new)
    rest = np.flatnonzero(~done)
    within = np.lexsort((key[order[rest]], block[rest]))
    order[rest] = order[rest][within]
    k, g = key[order], group[order]
    new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    return order, new


class _Branch:
    """A node of a blind trie: the place where its suffixes differ first, and what follows by the byte there."""

    __slots__ = ("place", "kids")

    def __init__(self, place: int, kids: dict):
        self.place, self.kids = place, kids


def blind_trie(suffixes: list[bytes]) -> list[list[int]]:
    """The numbers of the suffixes, which have one length, in sorted order; those of equal ones together."""
    length = len(suffixes[0])
    top = [suffixes[0], 0]  # a leaf: a suffix, and the numbers of all that equal it
    for i in range(1, len(suffixes)):
        s, node = suffixes[i], top
        while type(node) is _Branch:  # blindly: what lies between the branches is not looked at
            kids = node.kids
            node = kids.get(s[node.place]) or next(iter(kids.values()))
        t = node[0]
        if s == t:
            node.append(i)
            continue
        place = length - 1 - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() - 1) // 8
        above, node = None, top
        while type(node) is _Branch and node.place < place:
            above, node = node, node.kids[s[node.place]]
        if type(node) is _Branch and node.place == place:
            node.kids[s[place]] = [s, i]
            continue
        branch = _Branch(place, {t[place]: node, s[place]: [s, i]})
        if above is None:
            top = branch
        else:
            above.kids[s[above.place]] = branch
    out, open_ = [], [top]
    while open_:
        node = open_.pop()
        if type(node) is _Branch:
            open_ += [node.kids[byte] for byte in sorted(node.kids, reverse=True)]
        else:
            out.append(node[1:])
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes at starts sorted by their first `depth` bytes, all of which must be there, and which
    of the sorted differ from the one before."""
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    if not len(starts):
        return order, new
    new[0] = True
    characters = sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    for at in range(0, shallow, 8):  # shallow: eight bytes to a character
        group = np.cumsum(new) - 1
        live = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(live):
            return order, new
        key = characters[starts[order[live]] + at].view(">u8")[:, 0].astype(np.uint64)
        within, first = _quicksort(key, group[live])
        order[live] = order[live][within]
        new[live] |= first
    group = np.cumsum(new) - 1
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(live):
        return order, new
    # Deep. Tries of one leaf and of two, which are most of them, are built in lockstep: all suffixes of a group are
    # compared with its first one, and the others with the first that differs from it.
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[live]) > 0]))
    size = np.diff(np.append(first, len(live)))
    own = starts[order[live]]
    tail = sliding_window_view(data, depth - shallow)[own + shallow]
    equal = (tail == np.repeat(tail[first], size, 0)).all(1)
    branched = ~np.logical_and.reduceat(equal, first)
    rows = np.flatnonzero(np.repeat(branched, size))
    if not len(rows):
        return order, new
    live, own, tail, equal, size = live[rows], own[rows], tail[rows], equal[rows], size[branched]
    first = np.cumsum(size) - size
    number = np.repeat(np.arange(len(first)), size)
    other = np.flatnonzero(~equal)
    other = other[np.concatenate([[True], np.diff(number[other]) > 0])]  # the first of each group
    place = (tail[first] != tail[other]).argmax(1)
    swap = tail[first, place] > tail[other, place]
    two = np.logical_and.reduceat(equal | (tail == np.repeat(tail[other], size, 0)).all(1), first)
    side = equal == swap[number]  # of the leaf that comes second
    rows = np.flatnonzero(two[number])
    code = number[rows] * 2 + side[rows]
    within = np.argsort(code, kind="stable")
    order[live[rows]] = order[live[rows][within]]
    new[live[rows][1:]] |= (np.diff(code[within]) == 1) & (code[within][1:] % 2 == 1)
    for k in np.flatnonzero(~two).tolist():
        rows = live[first[k] : first[k] + size[k]]
        sorted_ = blind_trie([t.tobytes() for t in tail[first[k] : first[k] + size[k]]])
        order[rows] = order[rows][[i for same in sorted_ for i in same]]
        new[rows[np.cumsum([len(same) for same in sorted_[:-1]])]] = True
    return order, new


def _hits(key: np.ndarray, d: np.ndarray, start: np.ndarray, x: pa.Array) -> tuple[np.ndarray, ...]:
    """(d, start, end) of the removed bytes, from whole groups of runs sorted by key and x."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8)
    new_x = np.concatenate([[True], pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) | (key[1:] != key[:-1])])
    first = np.flatnonzero(new_x)
    x_of = np.cumsum(new_x) - 1
    least = np.minimum.reduceat(d, first)
    size = np.diff(offsets)
    x_key = key[first]
    several = np.zeros(len(first), bool)
    several[1:] |= x_key[1:] == x_key[:-1]
    several[:-1] |= x_key[1:] == x_key[:-1]
    # a key with one string only: all its windows have the same documents
    plain = np.flatnonzero(~several[x_of] & (least[x_of] < d))
    out = [(d[plain], start[plain], start[plain] + size[plain])]
    if several.any():
        mixed_x = np.flatnonzero(several)
        n = size[first[mixed_x]] - LENGTH + 1
        begin = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(mixed_x)), n)
        at = np.arange(len(owner)) - begin[owner]
        order, new = deep_shallow(data, offsets[first[mixed_x]][owner] + at)
        cut = np.flatnonzero(new)
        best = np.empty(len(owner), np.int64)
        best[order] = np.repeat(np.minimum.reduceat(least[mixed_x][owner[order]], cut), np.diff(np.append(cut, len(order))))
        number = np.full(len(first), -1)
        number[mixed_x] = np.arange(len(mixed_x))
        rows = np.flatnonzero(several[x_of])
        which = number[x_of[rows]]
        row = np.repeat(np.arange(len(rows)), n[which])
        place = np.arange(len(row)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
        out.append(_spans(d[rows], start[rows], row, place, best[begin[which[row]] + place] < d[rows][row]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _spans(d: np.ndarray, start: np.ndarray, row: np.ndarray, place: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
    row, place = row[hit], place[hit]
    if not len(row):
        return row, row, row
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return d[row[first]], start[row[first]] + place[first], start[row[first]] + place[last] + LENGTH


_SPANS = "d bigint, s int, e int"


def _batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32))], names=["d", "s", "e"])


def cold_spans(found: DataFrame) -> DataFrame:
    """Removed bytes by the keys that are not hot: all runs of a key in one task, many keys to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                c = t.combine_chunks()
                yield _batch(_hits(c["key"].to_numpy(), c["d"].to_numpy(), c["start"].to_numpy().astype(np.int64), c["x"]))

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                whole = pa.concat_tables(held)
                key = whole["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                yield from flush(whole.slice(0, cut))
                held, n = [whole.slice(cut)], whole.num_rows - cut
        if held:
            yield from flush(pa.concat_tables(held))

    return found.where("NOT hot").select("key", "d", "start", "x").repartition("key").sortWithinPartitions("key", "x").mapInArrow(run, _SPANS)


def _collapsed(w: pa.Array, least: np.ndarray) -> pa.RecordBatch:
    """The distinct windows, sorted, with the least document of each."""
    order, new = deep_shallow(np.frombuffer(b"".join(w.to_pylist()), np.uint8), np.arange(len(w)) * LENGTH)
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([w.take(pa.array(order[first])), pa.array(np.minimum.reduceat(least[order], first))], names=["w", "least"])


def least_by_window(windows: DataFrame) -> DataFrame:
    """w, best: the least document of each window, from (w, least). Batches collapse where they are, so that a window of all
    strings is one row of each; what is left is dealt to splits by hash, each sorted as a whole."""

    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _collapsed(batch.column(0), batch.column(1).to_numpy())

    def split_by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = None, []

        def whole() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return _collapsed(t["w"].combine_chunks(), t["least"].to_numpy()).rename_columns(["w", "best"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    if held and numbers[a] != split:
                        yield whole()
                        held = []
                    split = numbers[a]
                    held.append(batch.slice(a, z - a))
        if held:
            yield whole()

    few = saved(windows.mapInArrow(batch_by_batch, "w binary, least bigint"), "windows")
    splits = max(1, -(-few.count() // SPLIT_ROWS))
    dealt = few.select(F.pmod(F.xxhash64("w"), F.lit(splits)).alias("split"), "w", "least")
    return dealt.repartition("split").sortWithinPartitions("split").mapInArrow(split_by_split, "w binary, best bigint")


def hot_spans(found: DataFrame) -> DataFrame:
    """Removed bytes by the hot keys: grouped minimums over distinct strings, then sorted splits of their windows."""
    hot = found.where("hot")
    strings = saved(hot.groupBy("x").agg(F.min("d").alias("least")), "strings")
    windows = strings.select("x", "least", F.explode(F.sequence(F.lit(1), F.length("x") - LENGTH + 1)).alias("at")).withColumn("w", F.expr(f"substring(x, at, {LENGTH})"))
    best = least_by_window(windows.select("w", "least"))
    by_string = windows.join(best, "w").groupBy("x").agg(F.collect_list(F.struct("at", "best")).alias("windows"))  # at most LENGTH - SEED + 1
    hits = hot.join(by_string, "x").select("d", "start", F.transform(F.filter(F.array_sort("windows"), lambda v: v["best"] < F.col("d")), lambda v: v["at"]).alias("at")).where(F.size("at") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            place = lists.flatten().to_numpy() - 1
            yield _batch(_spans(b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), row, place.astype(np.int64), np.ones(len(row), bool)))

    return hits.mapInArrow(run, _SPANS)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (as bytes), spans: the merged removed byte ranges of each document."""
    texts = _texts(docs)
    keys = saved(shared_keys(texts), "keys")
    wanted = saved(wanted_keys(texts, keys), "wanted")
    any_hot = not keys.where("hot").isEmpty()
    found = saved(shared_runs(texts, wanted), "runs")
    discard(keys, wanted)
    spans = saved(cold_spans(found).unionByName(hot_spans(found)) if any_hot else cold_spans(found), "spans")
    discard(found)
    spans = spans.groupBy("d").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # as many as the document has
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    return whole.join(spans, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", F.coalesce("spans", F.array()).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                merged = merge_spans([(x["s"], x["e"]) for x in spans]) if spans else []
                kept, at = [], 0
                for s, e in merged:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rows.append((len(text), sum(e - s for s, e in merged), len(merged), b"".join(kept)))
            if rows:
                a, b, c, k = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeated_spans(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, doc_id, i, b[i + 1:i + 50] AS s FROM (SELECT rid, doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
g AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT rid, i FROM w JOIN g USING (s) WHERE m < doc_id),
cut AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit),
grp AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM cut),
r AS (SELECT rid, min(i) AS s, max(i) + 50 AS e FROM grp GROUP BY rid, k),
seg AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS a, s AS z FROM r
        UNION ALL SELECT d.rid, coalesce(max(e), 0), any_value(octet_length(b)) FROM d LEFT JOIN r ON d.rid = r.rid GROUP BY d.rid),
kept AS (SELECT seg.rid, string_agg(CASE WHEN z > a THEN hex(b[a + 1:z]) ELSE '' END, '' ORDER BY a) AS h FROM seg JOIN d ON d.rid = seg.rid GROUP BY seg.rid),
n AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans FROM r GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept ON d.rid = kept.rid LEFT JOIN n ON d.rid = n.rid
"""
