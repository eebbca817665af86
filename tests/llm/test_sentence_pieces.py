"""Sampled segmentation: lossless, reproducible, and in the right proportions."""

import itertools
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from stratavec.llm import sentence_pieces as S
from stratavec.llm.common import release_memory, slices
from tests.llm.helpers import docs_of

TOY = [(i, p, False) for i, p in enumerate(["a", "b", "▁", "ab", "ba", "▁a", "aba", "▁▁"])] + [(10 + v, f"<0x{v:02X}>", True) for v in range(256)]


def all_ways(word, weights):
    pieces = [p for _, p, b in TOY if not b]
    out = {}

    def go(at, ids):
        if at == len(word):
            out[tuple(ids)] = math.exp(sum(weights[i] for i in ids))
        for i, p in enumerate(pieces):
            if word.startswith(p, at):
                go(at + len(p), [*ids, i])

    go(0, [])
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_follow_the_lattice():
    s = S.Sampler(TOY, sharpness=0.5, seed=3)
    n = 20_000
    for word in ("▁abab", "ababa", "▁▁aba"):
        found = Counter(tuple(x.tolist()) for x in s.encode(list(range(n)), [word.replace("▁", " ")] * n))
        exact = all_ways(word, s.weights)
        assert set(found) <= set(exact)
        for ids, p in exact.items():
            assert abs(found[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
            assert math.exp(s.log_probability(word, list(ids))) == pytest.approx(p)


@pytest.fixture(scope="module")
def sampler():
    return S.Sampler(S.read_vocabulary())


TEXTS = ["", "hello world", "  two  spaces\n\nlines\n", "▁ literal ▁▁mark▁", "日本語 🙂 \x00 \t\r", "x" * 5000, "ééé ñ ß", " ", "\n", "ab"]


def test_lossless_and_reproducible(sampler):
    keys = list(range(len(TEXTS)))
    ids = sampler.encode(keys, TEXTS)
    assert [sampler.decode(x.tolist()) for x in ids] == TEXTS
    other = S.Sampler(S.read_vocabulary())
    for k, t, x in list(zip(keys, TEXTS, ids))[::-1]:
        assert np.array_equal(other.encode([k], [t])[0], x)
    again = sampler.encode([k + 100 for k in keys], TEXTS)
    assert any(not np.array_equal(a, b) for a, b in zip(ids, again))


def test_kept_lattices_can_be_dropped(sampler, monkeypatch):
    texts = [f"word{i} and more {i * 7}" for i in range(300)]
    one = sampler.encode(list(range(300)), texts)
    monkeypatch.setattr(S, "KEPT_EDGES", 10)
    parts = list(itertools.chain(*(sampler.encode(list(range(i, i + 50)), texts[i : i + 50]) for i in range(0, 300, 50))))
    assert all(np.array_equal(a, b) for a, b in zip(one, parts))


def test_rows(spark):
    got = {r.doc_id: r for r in S.sample_pieces(docs_of(spark, [None, *TEXTS], [None, *range(1, len(TEXTS) + 1)]).selectExpr("*", "1 AS ids")).collect()}
    assert len(got) == len(TEXTS) + 1 and all(r.lossless for r in got.values())
    assert got[None].ids is None and got[1].ids == []
    assert S.sample_pieces(docs_of(spark, [])).count() == 0


def test_crossing_pieces_are_refused():
    with pytest.raises(ValueError, match="crosses"):
        S.Sampler([(0, "a▁b", False)])


def test_other_words_before_change_nothing(sampler):
    import random

    rng = random.Random(5)
    texts = ["The quick brown fox jumps over the lazy dog; naïve façade.", "wordless " * 30, "internationalisation"]
    first = S.Sampler(S.read_vocabulary()).encode([1, 2, 3], texts)
    late = S.Sampler(S.read_vocabulary())
    late.encode([9], [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(100_000))])
    after = late.encode([1, 2, 3], texts)
    assert all(a.tolist() == b.tolist() for a, b in zip(first, after))
    one, other = S.Sampler(S.read_vocabulary()), late
    words = ["▁quick", "▁brown", "naïve"]
    for s in (one, other):
        s.found = s.lattice(words)
    for k in ("start", "search", "tokens"):
        assert np.array_equal(one.found[k], other.found[k])
    kept = lambda s, w: s.kept["search"][s.kept["cut"][s.kept["rank"][s.kept["first"][s.known[w] + 1] - 1]]] & (1 << S.PRECISION) - 1
    one.encode([1], [texts[0]])
    assert kept(one, "▁quick") == kept(late, "▁quick")


def test_repeated_rows_and_extra_columns(spark):
    docs = docs_of(spark, ["same text here", "same text here", "x" * 50_000], [4, 4, 5]).selectExpr("*", "'a' AS ids", "1 AS lossless")
    got = S.sample_pieces(docs).orderBy("doc_id").collect()
    assert got[0].ids == got[1].ids and all(r.lossless for r in got)
    assert S.sample_pieces(docs_of(spark, [])).count() == 0


def test_memory_of_a_slice_and_what_a_worker_gives_back():
    import tracemalloc

    rng = np.random.default_rng(5)
    words = [f"{'abcdefghij'[i % 10]}{i}" for i in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 400)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(texts)], names=["doc_id", "text"])
    sampler = S.Sampler(S.read_vocabulary())
    sampler.encode([0], [" ".join(["", *words])])  # lattices are known: what follows is a slice's own
    tracemalloc.start()
    try:
        for part in slices([batch], S.SLICE_BYTES):
            sampler.encode(part.column(0).to_pylist(), part.column(1).to_pylist())
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()

    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1])
    blocks = [bytes(1000) for _ in range(100_000)]
    few = blocks[::50]  # pins the heap's end
    del blocks
    before = held()
    release_memory()
    assert before - held() > 50_000 and len(few) == 2000
