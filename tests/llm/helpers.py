"""Small tables for the operators' tests."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdefg'[rng.randrange(7)]}" for _ in range(n))


def words_of(text):
    """Words by a plain pattern: digits, letters A-Z folded, anything beyond ASCII."""
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def common(a, b):
    """Length of the longest common subsequence, by whole-row bit operations."""
    places = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def alike(x, y):
    """Share of the words of both texts that align."""
    a, b = words_of(x), words_of(y)
    if not a and not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)) - 1e-9:
        return 0.0
    m = common(a, b)
    return m / (len(a) + len(b) - m)


def classes(rows):
    """Least id of the class of each id in (id, text): equal texts, texts alike, texts of one id."""
    rows = sorted({(d, t or "") for d, t in rows if d is not None})
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            if root(d) != root(e) and (t == u or alike(t, u) >= 0.8 - 1e-9):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d in parent}
