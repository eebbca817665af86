"""Histograms: time differences, resets, and the streaming form."""

import pandas as pd

from stratavec.operators import histograms as H
from stratavec.streaming.histograms import stream_time_diff

# Three snapshots of cumulative counts.
SNAPSHOTS = [
    [0, 1000, 1001, 1002, 1003, 2005, 2010, 3034, 4045, 5056, 6067, 7078],
    [3, 1004, 1006, 1008, 1009, 2012, 2020, 3056, 4070, 5090, 6101, 7150],
    [7, 1010, 1016, 1018, 1019, 2022, 2030, 3078, 4101, 5122, 6134, 7195],
]


def long_form(spark, snapshots):
    return spark.createDataFrame([("s", t, b, n) for t, row in enumerate(snapshots) for b, n in enumerate(row)], "series string, ts bigint, bucket int, n bigint")


def rows(df):
    out = {}
    for r in df.orderBy("ts", "bucket").collect():
        out.setdefault(r.ts, []).append(r.n)
    return list(out.values())


def test_time_diff_adds_up(spark):
    deltas = H.bucket_deltas(long_form(spark, SNAPSHOTS))
    back = rows(H.cumulative(H.time_diff(deltas)))
    expected = [[b - a for a, b in zip(p, n)] for p, n in zip([[0] * 12] + SNAPSHOTS, SNAPSHOTS)]
    assert back == expected
    assert not any(r.value_dropped for r in H.resets(deltas).collect())


def test_reset_keeps_the_new_count(spark):
    df = long_form(spark, [[9, 5], [4, 6]])
    assert rows(H.time_diff(df)) == [[9, 5], [4, 1]]
    assert [r.value_dropped for r in H.resets(df).orderBy("ts").collect()] == [False, True]


def test_time_diff_over_blocks(spark):
    snapshots = [[(t * 7 + b) % 11 for b in range(3)] for t in range(0, 40)]
    df = long_form(spark, snapshots).where("ts % 5 <> 2")
    for operator in (H.time_diff, H.resets):
        assert sorted(operator(df, span=3).collect()) == sorted(operator(df, span=1000).collect())


def test_packed(spark):
    got = H.packed(long_form(spark, [[1, 2, 3]]), 2.0, 1.5).first().histogram
    assert (got.initial, got.multiplier, got.buckets) == (2.0, 1.5, [1, 2, 3])


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for t, row in enumerate(SNAPSHOTS + [[0] * 12]):
        pd.DataFrame({"series": ["s"], "ts": [t], "n": [row]}).to_parquet(source / f"{t}.parquet")
    stream = spark.readStream.schema("series string, ts bigint, n array<bigint>").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    q = stream_time_diff(stream).writeStream.format("memory").queryName("diffs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM diffs ORDER BY ts").collect()
    assert [r.ts for r in got] == [0, 1, 2, 3]
    assert list(got[1].n) == [b - a for a, b in zip(SNAPSHOTS[0], SNAPSHOTS[1])]
    assert [r.value_dropped for r in got] == [False, False, False, True] and list(got[3].n) == [0] * 12


def test_stream_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratavec.streaming.histograms import stream_section_counts

    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        pd.DataFrame({"vec": ["v"] * 200, "pos": range(k * 200, k * 200 + 200), "v": [i % 4 for i in range(200)]}).to_parquet(source / f"{k}.parquet")
    stream = spark.readStream.schema("vec string, pos bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = stream_section_counts(stream, F.col("v") == 3).writeStream.format("memory").outputMode("complete").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.sect, r.n, r.hits) for r in spark.sql("SELECT * FROM counts ORDER BY sect").collect()] == [(0, 256, 64), (1, 144, 36)]


def test_section_sizes_take_one_shuffle(spark):
    from stratavec.operators import encoding as E

    df = spark.range(1000).selectExpr("'v' AS vec", "id AS pos", "id % 7 AS v")
    plan = E.section_bytes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_idle_series_are_forgotten(spark, tmp_path):
    import time

    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("series string, ts bigint, n array<bigint>").parquet(str(source))
    writer = stream_time_diff(stream, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c"))
    q = writer.trigger(processingTime="100 milliseconds").start()  # a query with such timeouts is never done by itself
    try:
        for k, (ts, series, n) in enumerate(((1, "a", [5]), (2, "b", [7]), (3, "a", [6])), 1):
            pd.DataFrame({"series": [series], "ts": [ts], "n": [n]}).to_parquet(tmp_path / f"{ts}.parquet")
            (tmp_path / f"{ts}.parquet").rename(source / f"{ts}.parquet")
            until = time.time() + 30
            while spark.table("idle").count() < k and time.time() < until:
                time.sleep(0.1)
            time.sleep(3)
    finally:
        q.stop()
    assert [(r.series, list(r.n)) for r in spark.sql("SELECT * FROM idle ORDER BY ts").collect()] == [("a", [5]), ("b", [7]), ("a", [6])]
