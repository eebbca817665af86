"""Repeated strings against a direct count of windows, on both ways of grouping."""

import random

import numpy as np
import pytest

from stratavec.llm import suffix_dedup as S
from tests.llm.helpers import docs_of, sentence


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d) if d is not None else first.get(w, np.inf)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                hit[i : i + 50] = b"\1" * 50
        spans = sum(hit[i] and (i == 0 or not hit[i - 1]) for i in range(len(hit)))
        out.append((d, len(b), sum(hit), spans, bytes(c for c, h in zip(b, hit) if not h)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "chunk"), [(5000, 60_000), (2, 50)])
def test_against_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(S, "SPLIT_ROWS", 4 * hot)
    rng = random.Random(5)
    passages = [sentence(rng, 12), "é" * 40, "a" * 300, "ab" * 90, sentence(rng, 40)]
    rows = [(None, passages[0]), (3, None), (4, ""), (5, "short"), (900, "x" * 49), (901, "x" * 50), (902, "x" * 50)]
    for i in range(60):
        t = sentence(rng, rng.randrange(1, 60))
        for _ in range(rng.randrange(3)):
            t += rng.choice([" ", "", "\n"]) + rng.choice(passages) + rng.choice(["", "z", sentence(rng, 4)])
        rows.append((rng.randrange(10, 800) * 10 + i, t))
    rows += [(d + 10_000, t) for d, t in rows[-5:]] + [rows[-1]]
    got = S.remove_repeats(docs_of(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert S.remove_repeats(docs_of(spark, [])).count() == 0


def test_deep_shallow_orders_suffixes():
    rng = random.Random(6)
    text = b"".join(rng.choice([b"abc" * 20, b"abd" * 25, bytes(rng.choices(b"ab", k=70)), b"\x00\xff" * 40]) for _ in range(60)) + b"end" * 20
    data = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text) - 49)
    order, new = S.deep_shallow(data, starts)
    suffixes = [text[i : i + 50] for i in starts[order].tolist()]
    assert suffixes == sorted(suffixes)
    assert new.tolist() == [i == 0 or suffixes[i] != suffixes[i - 1] for i in range(len(suffixes))]


def test_blind_trie_sorts():
    rng = random.Random(8)
    for n in (2, 3, 50, 400):
        words = [bytes(rng.choices(b"\x00ab\xff", k=6)) for _ in range(n)]
        got = S.blind_trie(words)
        assert [words[i] for same in got for i in same] == sorted(words)
        assert len(got) == len(set(words)) and all(len({words[i] for i in same}) == 1 for same in got)


def test_quicksort_sorts_groups():
    rng = np.random.default_rng(9)
    group = np.sort(rng.integers(0, 5, 5000))
    for key in (rng.integers(0, 2**63, 5000), rng.integers(0, 3, 5000), np.zeros(5000)):
        key = key.astype(np.uint64)
        order, new = S._quicksort(key, group)
        pairs = list(zip(group[order].tolist(), key[order].tolist()))
        assert pairs == sorted(zip(group.tolist(), key.tolist()))
        assert new.tolist() == [i == 0 or pairs[i] != pairs[i - 1] for i in range(5000)]


def test_equal_windows_have_equal_keys():
    rng = random.Random(7)
    w = bytes(rng.choices(b"abcdef ", k=50))
    keys = {int(S.window_keys(np.frombuffer(bytes(rng.choices(b"xyz", k=k)) + w + b"tail" * 5, np.uint8))[k]) for k in range(1, 40)}
    assert len(keys) == 1
