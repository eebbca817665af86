"""Near duplicates against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from stratavec.llm import near_dedup as N
from stratavec.llm.components import connected_components
from stratavec.llm.hashing import texts_words
from tests.llm.helpers import alike, classes, docs_of, sentence


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def similarity(x, y):
    return N.aligned_similarity(*map(N.Words, texts_words([x, y])))


def found(spark, rows):
    docs = docs_of(spark, [t for _, t in rows], [d for d, _ in rows]).selectExpr("*", "1 AS hash", "2 AS class_id", "3 AS node")
    return {r.doc_id: r.class_id for r in N.near_duplicate_classes(docs).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    rng = random.Random(1)
    rows = [(None, "x"), (1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One two!"), (6, "one two three"), (7, "!!!")]
    for g in range(10):
        base = sentence(rng, rng.choice([12, 60, 150, 300]))
        rows += [(len(rows) + 10, edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 25))) for _ in range(rng.choice([1, 3, 25]))]
    rows += [(len(rows) + 10, sentence(rng, 100)) for _ in range(20)]
    rows += [(1000 + i, rows[20][1]) for i in range(5)] + [rows[-1], (2000, "word " * 20_000), (2001, "word " * 20_001)]
    if small:
        for name, value in (("BLOCK_ROWS", 3), ("CROWD", 2), ("SLICE_BYTES", 2000)):
            monkeypatch.setattr(N, name, value)
    assert found(spark, rows) == classes(rows)


@pytest.mark.parametrize("crowd", [16, 3])
def test_a_passage_that_unlike_texts_share(spark, monkeypatch, crowd):
    rng = random.Random(8)
    monkeypatch.setattr(N, "CROWD", crowd)
    passage = sentence(rng, 120)
    rows = []
    for _ in range(60):
        own = sentence(rng, 60)
        rows += [(len(rows), f"{passage} {own}"), (len(rows) + 1, edited(rng, f"{passage} {own}", rng.randrange(1, 9)))]
    rows += [(len(rows), passage)]
    assert alike(rows[0][1], rows[2][1]) < 0.8
    assert found(spark, rows) == classes(rows)


def passage_with_copies(rng, n):
    """n unlike texts with a long common passage and a copy of each, every other word of its own part edited: no shingle but
    the passage's is common to both, so all their common buckets are crowded, whatever the tuples' length."""
    passage, texts = sentence(rng, 126), []
    for _ in range(n):
        own = sentence(rng, 34).split()
        copy = [w if i % 2 else f"new{rng.randrange(10**6)}" for i, w in enumerate(own)]
        texts += [f"{passage} {' '.join(own)}", f"{passage} {' '.join(copy)}"]
    return list(enumerate(texts))


@pytest.mark.parametrize("cell", [1000, 7])
def test_links_that_only_crowded_buckets_hold(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL_ROWS", cell, raising=False)
    rows = passage_with_copies(random.Random(11), 30)
    expected = classes(rows)
    assert expected == {i: i - i % 2 for i, _ in rows}
    assert found(spark, rows) == expected


@pytest.mark.parametrize("cell, hot", [(1000, 100_000), (8, 100_000), (8, 3)])
def test_rare_words_meet_in_one_join_by_cells(spark, monkeypatch, cell, hot):
    """All pairs of different roots come out, whether lists are long or short, and no join has a row for each row of the words."""
    rng = random.Random(13)
    rows = [(w, rng.randrange(4), bytes([i]) * 16, bytes([root]) * 16, 20) for w, n, roots in [(1, 60, 60), (2, 60, 2), (-3, 40, 1), (4, 5, 5), (5, 3, 1), (6, 9, 2)] for i in range(n) for root in [i % roots if roots != 2 else int(i < 4)]]
    plans, write = [], N.saved
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    monkeypatch.setattr(N, "HOT_WORDS", hot, raising=False)
    monkeypatch.setattr(N, "saved", lambda df, name: plans.append(df) or write(df, name))
    words = spark.createDataFrame(rows, "word bigint, place int, node binary, root binary, n_words int")
    pairs = N.pairs_of_rare_words(words)
    enough = lambda x, y: min(x[4] - x[1], y[4] - y[1]) >= 0.8 / 1.8 * (x[4] + y[4]) - 1e-6
    expected = {frozenset((x[2], y[2])) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3] and enough(x, y)}
    got = [frozenset((bytes(r.pivot), bytes(r.node))) for r in pairs.collect()]
    assert set(got) == expected and len(expected) > 1000
    joins = [line for df in [*plans, pairs] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and "low" in joins[0] and "high" in joins[0]


def test_the_pipelines_stage_drops_copies_in_crowded_buckets(spark):
    rows = passage_with_copies(random.Random(12), 30)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, [t for _, t in rows]), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == rows[::2]


def test_share_of_edited_copies_that_is_found(spark):
    """Copies with words replaced, dropped and put in at random; 4 to 10 % of them."""
    rng = random.Random(9)
    rows, pairs = [], []
    for i in range(400):
        w = sentence(rng, rng.choice([30, 50, 100, 250]), 5000).split()
        copy = list(w)
        for _ in range(max(1, round(len(w) * rng.uniform(0.04, 0.1)))):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"] * rng.randrange(2)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
        if alike(*(t for _, t in rows[-2:])) >= 0.8:
            pairs.append(2 * i)
    got = found(spark, rows)
    assert len(pairs) > 350 and sum(got[i + 1] == i for i in pairs) >= 0.985 * len(pairs)
    assert all(got[i] == i for i in range(0, 800, 2)) and all(got[i] >= i - 1 for i in got)


def test_one_of_each_class(spark):
    t = sentence(random.Random(2), 80)
    docs = docs_of(spark, [t, t, t + " more", "other text here", None, t], [5, 3, 9, 7, 8, None])
    assert sorted((r.doc_id or -1) for r in N.one_of_each_class(docs).collect()) == [-1, 3, 7, 8]
    assert N.near_duplicate_classes(docs_of(spark, [])).count() == 0 and N.one_of_each_class(docs_of(spark, [])).count() == 0


def test_no_content_is_lost(spark):
    rng = random.Random(7)
    a, b = sentence(rng, 90), sentence(rng, 90)
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (9, None), (9, None)]
    assert found(spark, rows) == {3: 3, 5: 3, 7: 3, 9: 9}
    docs = docs_of(spark, [t for _, t in rows], [d for d, _ in rows])
    kept = N.one_of_each_class(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(3, a), (5, b)] and len(kept) == 3


def test_repeated_rows_leave_one(spark):
    rng = random.Random(10)
    t = sentence(rng, 70)
    docs = docs_of(spark, [t] * 5 + [t + " x"] * 3 + [None] * 2, [4] * 5 + [6] * 3 + [None] * 2)
    docs = docs.union(docs_of(spark, [t], [4]).selectExpr("doc_id", "text", "'fr'", "source", "n_chars"))
    kept = sorted(N.one_of_each_class(docs).collect(), key=str)
    assert [r.doc_id for r in kept if r.doc_id is not None] == [4] and len(kept) == 3
    assert kept == sorted(N.one_of_each_class(docs.repartition(3)).collect(), key=str)


def test_alignment_heeds_order():
    a = [f"w{i}" for i in range(100)]
    one = " ".join(a)
    assert similarity(one, one) == 1.0
    assert similarity(one, " ".join(a[50:] + a[:50])) == 0.0
    assert similarity(one, " ".join(a[:95] + a[96:] + a[95:96])) == pytest.approx(99 / 101)
    assert similarity(one, " ".join(a[:80] + [f"x{i}" for i in range(20)])) == 0.0


def test_tuples_keep_the_order_of_the_text():
    kmers = np.random.default_rng(1).integers(1, 2**63, 50).astype(np.uint64)
    functions = np.arange(N.REPEATS)
    same, back = N.tuples(kmers, functions, 2), N.tuples(kmers[::-1].copy(), functions, 2)
    assert not np.any(same == back)
    assert np.all(N.tuples(kmers, functions, 1) == N.tuples(kmers[::-1].copy(), functions, 1))
    some = np.array([3, 17, 30])
    assert np.all(N.tuples(kmers, some, 4) == N.tuples(kmers, functions, 4)[some])


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(None, 5), (7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {x: root(x) for x in parent}
    named = connected_components(df.selectExpr("CAST(lpad(a, 5, '0') AS binary) AS a", "CAST(lpad(b, 5, '0') AS binary) AS b"))
    assert {int(r.node): int(r.root) for r in named.collect()} == got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_alignment_of_repeated_lines():
    rng = random.Random(4)
    pairs = []
    for n, line, own in [(10, 20, 80), (10, 20, 60), (20, 20, 100), (30, 10, 40)]:
        head, parts = sentence(rng, line), [sentence(rng, own) for _ in range(n)]
        text = " ".join(f"{head} {p}" for p in parts)
        pairs.append((text, text[len(head) + 1 :]))
    for _ in range(300):
        few = [sentence(rng, rng.randrange(1, 9), 3) for _ in range(rng.randrange(1, 4))]
        lines = [rng.choice(few) for _ in range(rng.randrange(1, 60))]
        other = [x for x in lines if rng.random() > 0.06] + [rng.choice(few)] * rng.randrange(3)
        pairs.append((" ".join(lines), " ".join(other)))
    pairs.append(("a b c d e f " * 300 + "x y z " * 200, "a b c d e f " * 290 + "y x z " * 20 + "x y z " * 200))
    linked = 0
    for x, y in pairs:
        true = alike(x, y)
        got = similarity(x, y)
        assert got == (pytest.approx(true) if true >= N.SIMILARITY else 0.0)
        linked += got > 0
    assert all(similarity(*p) > 0.97 for p in pairs[:4]) and 60 < linked < 300


def test_copies_of_texts_with_repeated_lines(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        n, line, own = rng.choice([(5, 20, 20), (10, 20, 80), (10, 20, 60), (20, 20, 40), (30, 10, 40), (10, 40, 10), (4, 9, 12)])
        head, parts = sentence(rng, line), [sentence(rng, own) for _ in range(n)]
        whole = [w for p in parts for w in (head, p)]
        for drop in ([], [0], [2 * (n // 2)]):
            texts.append(" ".join(w for i, w in enumerate(whole) if i not in drop))
    rows = list(enumerate(texts))
    assert found(spark, rows) == classes(rows)


def test_an_id_with_several_texts_joins_their_classes(spark):
    rng = random.Random(6)
    t, u, v = (sentence(rng, 90) for _ in range(3))
    rows = [(10, t), (10, u), (10, u), (11, t + " x"), (12, u + " y"), (13, u), (14, sentence(rng, 90)), (20, v), (9, v + " z"), (21, v), (21, t + " w")]
    assert found(spark, rows) == classes(rows) == {9: 9, 10: 9, 11: 9, 12: 9, 13: 9, 14: 14, 20: 9, 21: 9}
    kept = N.one_of_each_class(docs_of(spark, [t for _, t in rows[:7]], [d for d, _ in rows[:7]])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(10, t), (10, u), rows[6]])


@pytest.mark.parametrize("every, least", [(20, 0.99), (12, 0.97), (10, 0.95)])
def test_share_of_evenly_edited_copies_with_a_bucket(every, least):
    """Sketches alone: every 10th word edited is the hardest case of 0.8 or more, as it leaves the fewest shingles."""
    rng = random.Random(10)
    texts = [sentence(rng, rng.choice([40, 100, 300, 1000]), 5000) for _ in range(400)]
    copies = [" ".join(f"n{rng.randrange(10**6)}" if i % every == every - 1 else w for i, w in enumerate(t.split())) for t in texts]
    assert min(map(similarity, texts, copies)) >= 0.8

    def buckets(some):
        functions = np.arange(N.REPEATS + N.SHORT_REPEATS)
        return [set(N._buckets(n, s, p, functions, 0)[1].tolist()) for n, s, p in zip(*N._kmers(some))]

    assert np.mean([bool(a & b) for a, b in zip(buckets(texts), buckets(copies))]) >= least
