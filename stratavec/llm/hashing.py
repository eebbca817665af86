"""Hashes of words and word shingles for many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words per text). A word is a run of digits, letters A-Z (folded) and non-ASCII."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside)
    word_of = (np.cumsum(begins) - 1)[at]
    value = mixed((_FOLD[data[at]] + np.uint64(1)) * K1 + (at - first[word_of]).astype(np.uint64) * K2)
    cut = np.searchsorted(word_of, np.arange(len(first)))
    return mixed(np.add.reduceat(value, cut)), np.diff(np.searchsorted(first, starts))


def shingles_of(h: np.ndarray, counts: np.ndarray, width: int, labelled: bool = False) -> list[np.ndarray]:
    """Per text, hashes of its shingles in text order, from word_hashes; labelled: each with how often it occurred before,
    so that no two of a text are equal. A text of fewer than `width` words, but not none, is one shingle."""
    n_texts, ends = len(counts), np.cumsum(counts)
    if not len(h):
        return [np.zeros(0, np.uint64) for _ in range(n_texts)]
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    doc = np.repeat(np.arange(n_texts), out_counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(out_counts) - out_counts, out_counts) + (ends - counts)[doc]
    s = np.zeros(len(doc), np.uint64)
    for k in range(width):
        s = mixed(s * K1 + np.where(at + k < ends[doc], padded[at + k], np.uint64(0)) + K3)
    if not labelled:
        return np.split(s, np.cumsum(out_counts)[:-1])
    order = np.lexsort((at, s, doc))
    same = np.concatenate([[False], (s[order][1:] == s[order][:-1]) & (doc[order][1:] == doc[order][:-1])])
    run = np.flatnonzero(~same)
    label = np.empty(len(s), np.uint64)
    label[order] = (np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))).astype(np.uint64)
    return np.split(mixed(s + label * K2), np.cumsum(out_counts)[:-1])


def texts_words(texts: list[str | None]) -> list[np.ndarray]:
    """Per text, hashes of its words in text order."""
    h, counts = word_hashes(texts)
    return np.split(h, np.cumsum(counts)[:-1])
