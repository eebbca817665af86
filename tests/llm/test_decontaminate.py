"""Decontamination against a direct search for every window."""

import random
import re

from pyspark.sql import functions as F

from stratavec.llm import decontaminate as D
from tests.llm.helpers import docs_of, sentence

ITEMS = "item_id bigint, text string"


def brute(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for t in texts:
        ws, hit, found = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(10, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for s in range(len(ws) - n + 1):
                    if ws[s : s + n] == iw[k : k + n]:
                        hit |= set(range(s, s + n))
                        found.add(None if item is None else str(item))
        out.append((len(ws), len(hit), sorted(found, key=lambda i: (i is None, i))))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.choice([3, 9, 10, 14, 30]), 30)) for i in range(12)] + [(100, "Été à la plage"), (None, "only here"), (7, None), (8, ""), (9, "!!"), (3, "another text of item three")]
    items += [items[0]] * 3 + [(50, " ".join(f"long{i}" for i in range(400)))]
    texts = [None, "", "...", "ONLY here, été À LA PLAGE"]
    for _ in range(40):
        t = sentence(rng, rng.randrange(1, 60), 30)
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "").upper() + ". " + sentence(rng, 5, 30)
        texts.append(t)
    texts += [items[0][1]] * 2 + ["another text of item three", " ".join(f"long{i}" for i in range(390))] * 2 + [sentence(rng, 20_000, 30)]
    bench = spark.createDataFrame(items, ITEMS)
    docs = docs_of(spark, texts).withColumn("starts", F.lit("clash")).withColumn("items", F.lit(1))
    expected = brute(texts, items)
    docs = docs.unionByName(docs.where("doc_id = 3"))  # a repeated row
    expected.insert(3, expected[3])
    for block in (D.BLOCK_BYTES, 10_000):
        got = D.find_contamination(docs, bench, block_bytes=block).orderBy("doc_id").collect()
        assert [(r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), r["items"]) for r in got] == expected
        kept = {r.doc_id for r in D.clean_documents(docs, bench, block_bytes=block).collect()}
        assert kept == {i for i, e in enumerate(brute(texts, items)) if not e[1]}


def test_empty_tables(spark):
    assert D.find_contamination(docs_of(spark, []), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
    got = D.find_contamination(docs_of(spark, ["a b"]), spark.createDataFrame([], ITEMS)).first()
    assert (got.n_words, got.starts, got["items"]) == (2, [], [])


def test_names_of_items(spark):
    docs, bench = docs_of(spark, ["one two three"]), spark.createDataFrame([(None, "one two"), (10, "two three"), (9, "three"), (None, "three")], ITEMS)
    got = D.find_contamination(docs, bench).first()
    assert got["items"] == ["10", "9", None]


def test_one_item_over_many_blocks(spark):
    rng = random.Random(2)
    long = sentence(rng, 3000, 10_000)
    bench = spark.createDataFrame([(1, long)] * 20, ITEMS)
    docs = docs_of(spark, [long[:5000], "clean text"])
    got = D.find_contamination(docs, bench, block_bytes=30_000).orderBy("doc_id").collect()
    assert len(D.broadcast_indexes(docs, bench, block_bytes=30_000)) > 2
    n = len(D.words(long[:5000].rsplit(" ", 1)[0]))
    assert got[0].starts == [0] and got[0].ends[0] in (n, n + 1) and got[0]["items"] == ["1"] and got[1].starts == []
