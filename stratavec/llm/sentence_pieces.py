"""Sampled segmentation into the pieces of a published vocabulary, by forward filtering and backward sampling.

A text's lattice has an edge for every vocabulary piece that matches at a place. A piece's weight falls with its rank,
log p = -sharpness * log(rank + 1), as the vocabulary file orders pieces by merge rank. The forward pass sums, for each place,
the weight of all segmentations that reach it; the backward pass draws the last piece with its exact posterior
probability, then the one before, and so on, so that each segmentation comes with its probability under the model.
Draws come from a counter-based generator over (seed, row key, place in the text), and a place's posteriors are summed from
its own edges only and rounded to 2**-40, in integers: results depend on nothing else, so a task that runs again, another
partitioning, or other texts before give the same pieces bit for bit.

Encoding is lossless: nothing is normalised, no prefix is added; a space is the piece mark, and characters without a
piece (a literal mark included) become byte pieces. decode() gives back the exact text.

No piece joins a non-space to a following space or a line break (checked when the vocabulary is read), so the lattice falls
apart into words without loss, and the forward pass runs once per distinct word of a slice of rows, in lockstep over
words; the backward pass runs in lockstep over all occurrences. Everything is map-only.

Rows: a null text gives null ids, an empty one none; very long texts are segmented whole; repeated rows with equal keys give
equal pieces; null keys are a key like any other; an empty table gives an empty result; extra columns are not read, so
clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_bytes, release_memory, slices, table
from .hashing import K1, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHARPNESS = 0.4
#: Stand inside the lattice for a literal mark of the text and for the gap between words. Lone surrogates are in no text.
_LITERAL, _GAP = "\ud800", "\ud801"
VOCABULARY_BYTES = 16_000_000
SLICE_BYTES = 500_000
#: Lattices of words are kept between slices up to about so many edges.
KEPT_EDGES = 2_500_000
LATTICE_WORDS = 10_000
#: Bits that probabilities are rounded to where a piece is drawn.
PRECISION = 40
_KEPT = {"first": np.int64, "rank": np.int32, "start": np.int32, "search": np.int64, "tokens": np.int32, "cut": np.int32, "last": np.int32}


def read_vocabulary(model: str = MODEL) -> list[tuple[int, str, bool]]:
    """(id, piece, whether it is a byte piece), without control and unknown pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(i, m.id_to_piece(i), m.is_byte(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


class Sampler:
    """sharpness 0 makes all pieces alike; the greater it is, the more the early merges are preferred."""

    def __init__(self, vocabulary: list[tuple[int, str, bool]], sharpness: float = SHARPNESS, seed: int = 0):
        import ahocorasick

        self.seed = seed
        self.bytes_of: dict[int, bytes] = {}
        self.byte_ids = [0] * 256
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single = np.full(0x110000, -1, np.int32)
        self.ids, self.lengths, weights = [], [], []
        size = max(i for i, _, _ in vocabulary) + 1
        for i, piece, is_byte in vocabulary:
            if is_byte:
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
                continue
            if re.search(f"[^{MARK}][{MARK}\n]|\n.", piece):
                raise ValueError(f"piece {i} crosses a word's end")
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
            if len(piece) == 1:  # these are looked up by their code point
                self.single[ord(piece)] = len(self.ids)
            else:
                self.trie.add_word(piece, len(self.ids))
            self.ids.append(i)
            self.lengths.append(len(piece))
            weights.append(-sharpness * np.log(i + 1.0))
        self.trie.make_automaton()
        self.byte_weight = -sharpness * np.log(size + 1.0)
        self.ids, self.lengths, self.weights = np.array(self.ids), np.array(self.lengths), np.array(weights)
        self._words = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.extra: list[bytes] = []
        self.used = dict.fromkeys(_KEPT, 0) | {"first": 1}
        if not hasattr(self, "kept") or len(self.kept["start"]) != KEPT_EDGES * 3 // 2 + 1:
            self.kept = {x: np.empty(KEPT_EDGES * 3 // 2 + 1, kind) for x, kind in _KEPT.items()}  # pages count once they are written
        self.kept["first"][0] = 0

    def _learn(self, words: list[str]) -> None:
        """Adds the lattices of new words to those that are kept; some words at a time, as a lattice in the making takes
        several times what is kept of it."""
        for at in range(0, len(words), LATTICE_WORDS):
            g, extra, used = self.lattice(words[at : at + LATTICE_WORDS]), len(self.extra), self.used
            moved = {
                "first": g["first"][1:] + self.kept["first"][used["first"] - 1], "rank": np.where(g["rank"] >= 0, g["rank"] + used["cut"], -1)[:-1], "start": g["start"] + used["rank"], "search": g["search"] + (used["cut"] << PRECISION),
                "tokens": np.where(g["tokens"] < 0, g["tokens"] - extra, g["tokens"]), "cut": g["cut"] + used["start"], "last": g["last"] + used["start"],
            }
            for x, v in moved.items():
                n = used[x] + len(v)
                if n > len(self.kept[x]):
                    self.kept[x] = np.concatenate([self.kept[x][: used[x]], np.empty(n - used[x] + len(v), v.dtype)]).astype(_KEPT[x])
                self.kept[x][used[x] : n] = v
                used[x] = n
            self.extra += g["extra"]

    def lattice(self, words: list[str]) -> dict:
        """Nodes and edges of all words, one after the other, with the forward pass's posterior of each edge."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(sizes + 1)])  # each word's first node; the last one is its end
        joined = _GAP.join(words)  # one character between words: its node is the next word's first
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        alone = self.single[code]
        places = np.flatnonzero(alone >= 0)
        odd = np.flatnonzero((alone < 0) & (code != ord(_GAP)))
        extra = [(MARK if joined[o] == _LITERAL else joined[o]).encode() for o in odd.tolist()]
        ends, which = np.fromiter(chain.from_iterable(self.trie.iter(joined)), np.int64).reshape(-1, 2).T
        ends, which = np.concatenate([ends, places]), np.concatenate([which, alone[places]])
        end, start = ends + 1, ends + 1 - self.lengths[which]
        weight, tokens_at = self.weights[which], which
        end, start = np.concatenate([end, odd + 1]), np.concatenate([start, odd])
        weight = np.concatenate([weight, np.array([len(b) for b in extra]) * self.byte_weight if extra else []])
        tokens_at = np.concatenate([tokens_at, -1 - np.arange(len(extra))])
        order = np.argsort(end, kind="stable")
        end, start, weight, tokens_at = end[order], start[order], weight[order], tokens_at[order]
        place = end - np.repeat(first[:-1], sizes + 1)[end]
        alpha = np.zeros(first[-1])
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        value = np.empty(len(end))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e = by_place[a:b]  # of one place in each word; by end node, as the sort is stable
            v = alpha[start[e]] + weight[e]
            nodes = end[e]
            cut = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            top = np.maximum.reduceat(v, cut)
            per = np.diff(np.append(cut, len(v)))
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, per)), cut))
            alpha[nodes[cut]] = total
            value[e] = np.exp(v - np.repeat(total, per))
        # Per end node, edges are together: the node's number above a running sum of its own serves all searches.
        cut = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        per = np.diff(np.append(cut, len(end)))
        run = value.copy()
        for k in range(1, per.max(initial=0)):  # from edge to edge, in all nodes at once
            at = cut[per > k] + k
            run[at] += run[at - 1]
        rank = np.repeat(np.arange(len(cut)), per)
        node_rank = np.full(first[-1] + 1, -1, np.int64)
        node_rank[end[cut]] = np.arange(len(cut))
        last = cut + per - 1
        return {"first": first, "start": start, "search": (rank << PRECISION) + np.minimum(run * 2.0**PRECISION, 2.0**PRECISION - 1).astype(np.int64), "rank": node_rank, "cut": cut, "last": last, "tokens": tokens_at, "extra": extra, "alpha": alpha}

    def encode(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        """Sampled ids for each text."""
        if self.used["start"] > KEPT_EDGES:
            self._forget()
        known = self.known
        had = len(known)
        which, counts = [], []
        for t in texts:
            found = [known.setdefault(w, len(known)) for w in self._words.findall(t.replace(MARK, _LITERAL).replace(" ", MARK))]
            which += found
            counts.append(len(found))
        if len(known) > had:
            self._learn(list(islice(known, had, None)))
        if not which:
            return [np.zeros(0, np.int32) for _ in texts]
        return self._backward(np.array(which), np.array(counts), keys)

    def _backward(self, which: np.ndarray, counts: np.ndarray, keys: list) -> list[np.ndarray]:
        salt = np.array([int.from_bytes(hashlib.blake2b(f"{self.seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)
        g = {x: v[: self.used[x]] for x, v in self.kept.items()}
        sizes = np.diff(g["first"])[which] - 1
        doc = np.repeat(np.arange(len(counts)), counts)
        before = np.cumsum(sizes) - sizes
        doc_first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        doc_start = np.append(before, sizes.sum())[doc_first]
        offset = (before - doc_start[doc]).astype(np.uint64)
        base = g["first"][which]
        node, live = base + sizes, np.argsort(which, kind="stable")  # by word: neighbours search the same places
        steps, edges_of, word_of = np.zeros(len(which), np.int64), [], []
        while len(live):
            at = node[live]
            place = offset[live] + (at - base[live]).astype(np.uint64)
            u = _uniform(salt[doc[live]], place)
            r = g["rank"][at]
            e = np.minimum(np.maximum(np.searchsorted(g["search"], (r.astype(np.int64) << PRECISION) + u, side="right"), g["cut"][r]), g["last"][r])
            edges_of.append(e)
            word_of.append(live)
            steps[live] += 1
            node[live] = g["start"][e]
            live = live[node[live] > base[live]]
        ends = np.cumsum(steps)
        edges = np.empty(ends[-1], np.int64)
        for k, (e, w) in enumerate(zip(edges_of, word_of)):
            edges[ends[w] - 1 - k] = e
        tokens = g["tokens"][edges]
        own = np.repeat(doc, steps)
        out = np.where(tokens >= 0, self.ids[np.maximum(tokens, 0)], 0)
        odd = np.flatnonzero(tokens < 0)
        if len(odd):
            longer = np.ones(len(tokens), np.int64)
            raw = [self.extra[-1 - t] for t in tokens[odd].tolist()]
            longer[odd] = [len(b) for b in raw]
            out, own = np.repeat(out, longer), np.repeat(own, longer)
            places = np.cumsum(longer) - longer
            fill = np.array([self.byte_ids[v] for b in raw for v in b])
            out[np.repeat(places[odd], longer[odd]) + _ramp(longer[odd])] = fill
        return np.split(out.astype(np.int32), np.searchsorted(own, np.arange(1, len(counts))))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()

    def log_probability(self, word: str, ids: list[int]) -> float:
        """log of the model's probability that the word is segmented so (for tests)."""
        w = {i: x for i, x in zip(self.ids.tolist(), self.weights.tolist())}
        total = self.lattice([word])["alpha"][len(word)]
        return sum(w.get(i, self.byte_weight) for i in ids) - total


def _ramp(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whole numbers below 2**PRECISION, by a finaliser over key and place."""
    return (mixed(key + (place + np.uint64(1)) * K1) >> np.uint64(64 - PRECISION)).astype(np.int64)


def sample_pieces(docs: DataFrame, model: str = MODEL, sharpness: float = SHARPNESS, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, ids, and whether decoding the ids gave back the text."""
    vocabulary = read_vocabulary(model)
    shared = broadcast_bytes(docs.sparkSession, vocabulary, sum(len(p.encode()) + 16 for _, p, _ in vocabulary), VOCABULARY_BYTES, "vocabulary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        sampler = Sampler(shared.value, sharpness, seed)
        for part in slices(batches, SLICE_BYTES):
            texts = part.column(1).to_pylist()
            ids = sampler.encode(part.column(0).to_pylist(), [t or "" for t in texts])
            good = [t is None or sampler.decode(x.tolist()) == t for t, x in zip(texts, ids)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            nulls = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)), mask=nulls)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(good)], names=["doc_id", "ids", "lossless"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, lossless boolean")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_pieces(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids", "lossless")
