"""Token rollup, chat formatting, quality sampling, toxicity, the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.llm import chat, quality, sentence_pieces, token_rollup, toxicity
from tests.llm.helpers import alike, docs_of, sentence, words_of

CHANGES = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, CHANGES)
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == {}
    one = make(("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, "de", "t1", None, None))
    assert r.commit("1", one) and not r.commit("1", one)
    assert totals(r) == {("a", "en", "t1"): (2, 15), (None, "de", "t1"): (1, 0)}
    assert r.commit("2/odd name", make(("revise", "a", "en", "t1", 7, 5), ("delete", "a", "en", "t1", 10, None), ("insert", "a", "en", "t2", 3, None), ("odd", "a", "en", "t1", 99, None)))
    expected = {("a", "en", "t1"): (1, 7), (None, "de", "t1"): (1, 0), ("a", "en", "t2"): (1, 3)}
    assert totals(r) == expected
    r.compact()
    assert totals(r) == expected and not r.commit("1", one)
    assert r.commit("3", make(("delete", None, "de", "t1", 0, None))) and r.commit("4", make().limit(0))
    del expected[None, "de", "t1"]
    assert totals(r) == expected
    r.compact()
    assert totals(token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")) == expected


def test_a_lost_attempt_is_not_read(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([("insert", "a", "en", "t", 1, None)], CHANGES)
    one.write.parquet(f"{tmp_path}/r/deltas/orphan")
    assert r.commit("1", one) and totals(r) == {("a", "en", "t"): (1, 1)}


def test_a_commit_that_dies_can_run_again(spark, tmp_path, monkeypatch):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([("insert", "a", "en", "t", 2, None), (None, "a", "en", "t", 9, None)], CHANGES)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(token_rollup.os, "link", dies)
        with pytest.raises(OSError):
            r.commit("1", one)
    assert totals(r) == {} and not r.committed("1")
    assert r.commit("1", one) and totals(r) == {("a", "en", "t"): (1, 2)}


@pytest.mark.parametrize("meanwhile", ["commit", "compact"])
def test_what_happens_during_a_compaction(spark, tmp_path, monkeypatch, meanwhile):
    make = lambda n: spark.createDataFrame([("insert", "a", "en", "t", n, None)], CHANGES)
    r, other = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    assert r.commit("1", make(1)) and r.commit("2", make(2))
    store = r._store

    def slow(delta):
        assert other.commit("3", make(4)) if meanwhile == "commit" else other.compact()
        return store(delta)

    monkeypatch.setattr(r, "_store", slow)
    assert r.compact() == (meanwhile == "commit")
    expected = {("a", "en", "t"): (3, 7) if meanwhile == "commit" else (2, 3)}
    assert totals(r) == expected and other.compact() and totals(r) == expected


def test_rollup_query_against_counts(spark, tmp_path):
    import base64

    import tiktoken

    with open(token_rollup.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["one text", "another, longer text", "one text", None, "", "one text", "x" * 20_000, None]
    docs = docs_of(spark, texts + texts[:1], [5, 6, 3, 7, 8, 9, 10, 11, 5]).selectExpr("*", "1 AS hash", "'x' AS estimate", "2 AS n")
    docs = docs.withColumn("source", F.when(F.col("doc_id") != 6, F.col("source")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    expected, least = {}, {}
    rows = docs.collect()
    for r in rows:
        least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    for r in rows:
        if r.doc_id == least[r.text or ""]:
            key = r.source, r.lang, "byte_bpe_50k"
            n, tokens = expected.get(key, (0, 0))
            expected[key] = n + 1, tokens + len(e.encode_ordinary(r.text or ""))
    got = token_rollup.op1_token_rollup(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == expected
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert token_rollup.op1_token_rollup(spark, str(tmp_path / "empty")).count() == 0


def test_token_counts_against_the_encoder(spark):
    import base64

    import tiktoken

    with open(token_rollup.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Hello <|endoftext|> world", "é" * 3000]
    got = token_rollup.count_tokens(docs_of(spark, texts), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(e.encode_ordinary(t or "")) for t in texts]


def test_chats_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "dd")]
    convs = {i: [rng.choice(turns) for _ in range(rng.randrange(1, 5))] for i in range(60)}
    convs[100] = [("user", str(k)) for k in range(40)]
    convs[101] = convs[100][:30]
    convs[102] = [(None, None), ("user", "x")]
    convs[103] = [("unknown", "")]
    rows = [(i, t, r, x) for i, c in convs.items() for t, (r, x) in enumerate(c)]
    rows += rows[:10] + [(None, 0, "user", "lost")]
    whole = {i: tuple((r or "unknown", x or "") for r, x in c) for i, c in convs.items()}
    first = {}
    for i in sorted(whole):
        first.setdefault(whole[i], i)
    kept = {i: c for c, i in first.items() if not any(len(o) > len(c) and o[: len(c)] == c for o in first)}
    expected = {i: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in c) for i, c in kept.items()}
    for size in (1024, 8):
        monkeypatch.setattr(chat, "CHUNK", size)
        got = {}
        for r in chat.format_chats(spark.createDataFrame(rows, CONVERSATIONS).withColumn("place", F.lit(9))).orderBy("conv_id", "part").collect():
            got[r.conv_id] = got.get(r.conv_id, "") + r.rendered
            assert r.n_turns == len(whole[r.conv_id])
        assert got == expected
    assert chat.format_chats(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_chats_of_odd_turn_numbers_against_sql(spark, tmp_path, monkeypatch):
    import duckdb

    rows = [(1, None, "user", "a"), (1, 0, "assistant", "b"), (2, 2000, "user", "a"), (2, 3100, "assistant", "c"), (3, -7, "user", "q"), (3, 2**62, "user", "r")]
    rows += [(4, 5, "user", f"t{i}") for i in range(1500)] + [(5, None, "user", f"t{i:05}") for i in range(2100)] + [(6, 1, "user", "a"), (7, 9, None, "z" * 100_000)]
    rows += [(4, 6, "user", None), (8, 0, "user", "a"), (8, 0, "user", "a")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = sorted(tuple(r) for r in chat.format_chats(df.selectExpr("*", "1 AS part", "2 AS chunk", "3 AS id")).collect())
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert got == sorted(con.execute(chat.OP4_SQL).fetchall())
    assert [r[1] for r in got if r[0] in (1, 2, 3)] == [0, 0, 0] and [r[1] for r in got if r[0] == 5] == [0, 1, 2]


@pytest.mark.parametrize("bins", [16, 4096])
def test_top_k_is_exact(spark, bins):
    rng = random.Random(2)
    keys = [(rng.choice([i, 7, -(2**63)]), rng.choice([rng.gauss(0, 1), 0.5, 1e9])) for i in range(1000)] + [(None, 0.5)] * 50 + [(2**63 - 1, 0.5)] * 40
    df = spark.createDataFrame([(*key, i) for i, key in enumerate(keys)], "doc_id bigint, key double, row bigint")
    order = sorted(((*key, i) for i, key in enumerate(keys)), key=lambda r: (-r[1], r[0] is not None, r[0] or 0, r[2]))
    last = sum(key[1] == 1e9 for key in keys)
    for k in (0, 1, last - 1, last + 30, last + 60, 800, len(keys) - 1, len(keys) + 1) if bins == 16 else (last + 10, 700):
        got = quality.top_k(df, k, bins=bins)
        assert sorted(got.collect(), key=str) == sorted(map(tuple, order[:k]), key=str)
    assert quality.top_k(df.limit(0), 5).count() == 0


def test_resampling_against_plain_counts(spark):
    """Counts, ratios, noise and choice by dictionaries and Python's integers."""
    import math
    import re

    rng = random.Random(12)
    texts = [None, "", "%% only 1 2 3", "Été ÉTÉ é", "w1a " * 5000] + [sentence(rng, rng.randrange(1, 60), 40) for _ in range(60)]
    ids = [None, 1, 2, 3, 4, *range(5, 65)]
    labels = [(i, i % 3 != 0, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (6, None, 0)]
    docs = docs_of(spark, texts + texts[5:8], ids + ids[5:8]).selectExpr("*", "1 AS key", "2 AS bucket", "3 AS row")
    rows = list(zip(ids, texts)) + list(zip(ids[5:8], texts[5:8]))

    def ngrams(text):
        words = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+|[^0-9a-zA-Z\x80-\U0010ffff \t\n\r\0]+", text or "")
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    bucket = {}
    for g in {g for _, t in rows for g in ngrams(t)}:
        bucket[g] = int(quality.ngram_buckets([g])[0][-1])
    good = {i for i, q, _ in labels if i is not None and q}
    raw, target = ([1] * quality.BUCKETS for _ in range(2))
    for i, t in rows:
        for g in ngrams(t):
            raw[bucket[g]] += 1
            target[bucket[g]] += i in good
    ratio = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw)]

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def key(i, t):
        u = ((mix(mix(((0x5851F42D4C957F2D if i is None else i) + 0x9E3779B97F4A7C15) % 2**64)) >> 11) + 0.5) * 2.0**-53
        return sum(ratio[bucket[g]] for g in ngrams(t)) - math.log(-math.log(u))

    expected = sorted(rows, key=lambda r: -key(*r))[:30]
    frame = spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    got = quality.resample(docs, frame, 30 / len(rows)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in expected), key=str)
    assert sorted(r.key for r in got) == pytest.approx(sorted(key(*r) for r in expected))


def test_ngram_buckets_stay_inside_texts():
    at, doc = quality.ngram_buckets(["One two", None, "", "one TWO one two"], 1000)
    each = [sorted(at[doc == d].tolist()) for d in range(4)]
    assert [len(e) for e in each] == [3, 0, 0, 7] and set(each[0]) <= set(each[3])


def test_importance_sampling_prefers_good_text(spark):
    rng = random.Random(3)
    good = [sentence(rng, 80, 50) for _ in range(150)]
    junk = [" ".join("%$#" + str(rng.randrange(99)) for _ in range(80)) for _ in range(50)]
    docs = docs_of(spark, good + junk + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 200, 2)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(docs, labels, 0.7).collect()}
    assert len(kept) == round(0.7 * 202) and len(kept & set(range(150))) > 130
    assert quality.resample(docs_of(spark, []), labels, 0.5).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() == 202


def test_gumbel_keys_sample_in_proportion():
    u = quality.mixed(quality.mixed(np.arange(200_000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0))
    u = (u >> np.uint64(11)).astype(float) * 2.0**-53
    w = np.tile(np.log([1.0, 2.0, 7.0]), 50_000)[:150_000].reshape(-1, 3)
    picked = np.argmax(w - np.log(-np.log(u[:150_000].reshape(-1, 3))), 1)
    assert np.allclose(np.bincount(picked) / 50_000, [0.1, 0.2, 0.7], atol=0.01)


def toxic_tables(spark, n=400):
    rng = random.Random(4)
    bad = ["vile", "rotten", "scummy"]
    texts, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.choice([30, 60, 500])).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.choice([2, 4, 8])):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper())
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return docs_of(spark, [*texts, None, ""]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model["cuts"]) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("severity", F.lit("x")), model).collect()}
    held = [i for i in range(400) if i % 2]
    assert np.mean([got[i].toxic for i in held if i % 5 == 0]) > 0.9
    assert not any(got[i].toxic for i in held if i % 5)
    assert not got[400].toxic and got[400].severity == got[401].severity
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(5)
    x = rng.poisson(1.0, (3000, 2))
    latent = 2.0 * x[:, 0] + 1.0 * x[:, 1] + rng.logistic(size=3000)
    y = np.searchsorted([2.0, 4.0, 7.0], latent)
    m = toxicity.fit_ordinal([{j: float(v) for j, v in enumerate(r) if v} for r in x], y, 2, 3)
    assert np.allclose(m["w"], [2, 1], atol=0.2) and np.allclose(m["cuts"], [2, 4, 7], atol=0.4)


def test_toxicity_without_classes(spark):
    docs = docs_of(spark, ["a", None])
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs, empty) is None
    assert [r.severity for r in toxicity.score(docs, None).collect()] == [0.0, 0.0]


def test_the_sample_is_bounded_by_labels(spark):
    docs = docs_of(spark, ["good text"] * 500 + ["bad text"] * 500 + [None, "other", "more"], [1] * 500 + [2] * 500 + [3, 3, 4])
    labels = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (2, None), (None, 1), (3, 1), (3, 0), (4, -1)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic").collect()
    assert sorted((r.text, r.y) for r in got) == [("", 1), ("bad text", 1), ("good text", 2)]


def test_scores_against_plain_sums(spark):
    import math

    docs, labels = toxic_tables(spark, 200)
    odd = docs_of(spark, ["vile " * 3000, "Vile rotten", None], [900, 900, None])
    docs = docs.unionByName(odd).selectExpr("*", "'x' AS grade", "1 AS p_toxic")
    model = toxicity.fit(docs, labels)
    for r, text in zip(toxicity.score(docs, model).collect(), [r.text for r in docs.collect()]):
        words = words_of(text)
        s = sum(model["w"][j] * math.log(1 + words.count(w.decode())) for w, j in model["known"].items() if w.decode() in words)
        over = [1 / (1 + math.exp(c - s)) for c in model["cuts"]]
        assert r.severity == pytest.approx(sum(over)) and r.p_toxic == pytest.approx(over[0]) and r.toxic == (over[0] >= toxicity.THRESHOLD)
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_pipeline_against_plain_code(spark, tmp_path):
    """Each stage's decisions by code of this test: a word list, all pairs, all windows, one pattern."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = toxic_tables(spark, 120)
    rng = random.Random(6)
    item, base = sentence(rng, 15), sentence(rng, 90)
    secret = "password = abcdefghijklmnop"
    texts = [f"{sentence(rng, 30)} {item} {sentence(rng, 10)}", base, base + " tail", f"{secret} {sentence(rng, 20)}", None, "", "one text", "one text", sentence(rng, 20_000)]
    ids = [1000, 1001, 1002, 1003, 1004, 1005, 1006, 1006, 1007]
    docs = docs.unionByName(docs_of(spark, [*texts, base], [*ids, None]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.ids, r.lossless) for r in pipeline.run(spark, str(tmp_path)).collect()]

    rows = {(r.doc_id, r.text) for r in docs.collect()}
    kept = []
    for i, t in sorted(rows, key=str):
        if {"vile", "rotten", "scummy"} & set(words_of(t)):
            continue
        if i is not None and any(j is not None and j < i and ((t or "") == (u or "") or alike(t, u) >= 0.8) for j, u in rows if not {"vile", "rotten", "scummy"} & set(words_of(u))):
            continue
        if f" {' '.join(words_of(item)[:10])} " in f" {' '.join(words_of(t))} ":
            continue
        kept.append((i, None if t is None else t.replace(secret, "[SECRET]")))
    sampler = sentence_pieces.Sampler(sentence_pieces.read_vocabulary())
    assert all(good for _, _, good in got)
    assert sorted(((i, None if ids is None else sampler.decode(ids)) for i, ids, _ in got), key=str) == sorted(kept, key=str)
    assert {1000, 1002}.isdisjoint(i for i, _ in kept) and len(kept) > 90


def test_pipeline_on_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = toxic_tables(spark, 5)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
