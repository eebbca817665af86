"""Vector fixtures: building, scanning, filtering, statistics, transforms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratavec.functions import bits
from stratavec.functions import predicates as P
from stratavec.functions.model import InvalidNumRows, WrongVectorType, require_type, unsigned
from stratavec.operators import encoding as E
from stratavec.operators import terminals as T
from stratavec.operators import transforms as X
from stratavec.plans.selectivity import most_selective_first
from stratavec.sources import vectors as S


def make(spark, values, kind="bigint", vec="v"):
    return spark.createDataFrame([(vec, i, v) for i, v in enumerate(values)], f"vec string, pos bigint, v {kind}").select("vec", "pos", "v")


def values(df):
    return [r.v for r in df.orderBy("pos").collect()]


def test_scan_and_unfinished_view(spark):
    df = make(spark, range(500))
    assert values(df) == list(range(500))
    assert T.null_sections(T.section_stats(df)).first()[1:] == (2, 0)
    assert S.flushed(df).count() == 256


def test_nulls_are_zeros(spark):
    df = S.append(S.append_nulls(make(spark, range(100)), 462), make(spark, range(50)))
    got = values(df)
    assert len(got) == 612 and got[100:562] == [0] * 462 and got[562:] == list(range(50))
    assert T.null_sections(T.section_stats(df)).first()[1:] == (3, 1)
    with_null = make(spark, [5, None, 0])
    assert T.count_hits(with_null, P.equals("v", 0)).first().n == 2
    assert T.count_hits(with_null, P.one_of("v", [0, 9])).first().n == 2
    assert values(X.add_constant(with_null, 7)) == [12, 7, 7]


def test_repeated_null_runs(spark):
    part = S.append_nulls(make(spark, range(300)), 350)
    df = S.append(part, part)
    assert df.count() == 1300
    assert T.null_sections(T.section_stats(df)).first()[1:] == (6, 2)


def test_counts_and_positions(spark):
    df = make(spark, [i % 4 + 1 for i in range(400)], "int")
    assert T.count_hits(df, P.equals("v", 3)).first().n == 100
    assert [r.pos for r in T.match_positions(df, P.equals("v", 3)).collect()] == list(range(2, 400, 4))
    twelve = make(spark, [i % 12 + 1 for i in range(400)])
    expected = [i for i in range(400) if i % 12 in (2, 4)]
    assert [r.pos for r in T.match_positions(twelve, P.one_of("v", [3, 5])).collect()] == expected
    assert sorted(r.pos for r in T.mask_positions(T.section_masks(twelve, P.one_of("v", [3, 5]))).collect()) == expected


def test_padding_counts_only_where_asked(spark):
    df = make(spark, [i % 4 + 1 for i in range(400)])
    assert T.count_hits(df, P.equals("v", 0)).first().n == 0
    assert T.padded_hits(df, P.equals("v", 0), P.matches_zero([0])).first().n == 112
    assert T.padded_hits(df, P.equals("v", 3), P.matches_zero([3])).first().n == 100


def test_positions_after_empty_words(spark):
    df = make(spark, [1 if i == 300 else 0 for i in range(512)])
    assert [r.pos for r in T.mask_positions(T.section_masks(df, P.equals("v", 1))).collect()] == [300]


def test_float_equality(spark):
    df = make(spark, [math.nan, 0.0, -0.0, 1.0], "float")
    assert T.count_hits(df, P.equals("v", math.nan)).first().n == 0
    assert [r.pos for r in T.match_positions(df, P.equals("v", 0.0)).collect()] == [1, 2]


def test_empty_list_empty_vector_and_conjunction(spark):
    df = make(spark, range(10))
    assert T.count_hits(df, P.one_of("v", [])).first().n == 0
    assert make(spark, []).count() == 0 and T.section_stats(make(spark, [])).count() == 0
    with pytest.raises(ValueError):
        P.all_of()
    short, long = make(spark, [1] * 300), make(spark, [1] * 600)
    assert T.matching_rows((long, P.equals("v", 1)), (short, P.equals("v", 1))).count() == 300
    both = most_selective_first(df, [F.col("v") >= 0, F.col("v") == 3])
    assert T.count_hits(df, both).first().n == 1


def test_finish_and_types(spark):
    df = make(spark, range(20))
    assert values(S.finish(df, 30)) == list(range(20)) + [0] * 10
    with pytest.raises(InvalidNumRows):
        S.finish(df, 10)
    with pytest.raises(InvalidNumRows):
        S.finish(df, 2**32)
    with pytest.raises(WrongVectorType):
        require_type(make(spark, [1], "int"), "v", "bigint")


def test_dense_positions(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10**9), 3000)
    got = S.with_positions(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k").orderBy("k").collect()
    assert [r.pos for r in got] == list(range(3000)) and [r.k for r in got] == sorted(keys)


@pytest.mark.parametrize("partitions", [8, 200])
def test_positions_do_not_depend_on_the_columns_read(spark, partitions):
    n = 2_000_000 if partitions == 8 else 300_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(n).select(((F.col("id") * 1_000_003) % n).alias("k"), F.sha1(F.col("id").cast("string")).alias("payload"))
        got = S.with_positions(df, "k")
        for columns in (["k"], ["k", "payload"]):
            one = got.select("pos", *columns).agg(F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.count_if(F.col("pos") != F.col("k"))).first()
            assert tuple(one) == (n, 0, n - 1, 0)
        tied = S.with_positions(df.withColumn("k", F.lit(1)).limit(5000), "k")
        assert tied.select("pos", "payload").agg(F.countDistinct("pos")).first()[0] == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_vectors_are_filled(spark):
    empty = make(spark, [])
    assert values(S.finish(empty, 10)) == [0] * 10 and S.finish(empty, 0).count() == 0
    assert values(S.append_nulls(empty, 3)) == [0] * 3
    sizes = spark.createDataFrame([("a", 2), ("b", 3)], "vec string, n bigint")
    assert S.densify(empty, sizes=sizes).count() == 5


def test_wide_unsigned_elements(spark):
    df = make(spark, [1, -1, 2**62, None])
    wrapped = X.add_constant_wrapping(df, 2**63 + 5, 64).withColumn("v", unsigned("v"))
    assert [int(v) for v in values(wrapped)] == [(v % 2**64 + 2**63 + 5) % 2**64 for v in (1, -1, 2**62, 0)]
    assert values(X.add_constant_wrapping(df, -1, 64)) == [0, -2, 2**62 - 1, -1]


def test_operators_read_nulls_as_zeros(spark):
    df = make(spark, [5, None, 3])
    assert values(X.running_sum(df)) == [5, 5, 8] and values(X.successive_delta(df)) == [5, 0, 3]
    assert T.fold(df, F.min("v").alias("m")).first().m == 0 and X.section_arrays(df).first()["values"] == [5, 0, 3]
    assert values(X.delta_from_least(df)) == [5, 0, 3] and values(X.xor_octets(df)) == [5, 0, 3]


def test_masks_combine(spark):
    a = T.section_masks(make(spark, [i % 4 for i in range(600)]), P.equals("v", 1))
    b = T.section_masks(make(spark, [i % 6 for i in range(400)]), P.equals("v", 1))
    at = lambda m: sorted(r.pos for r in T.mask_positions(m).collect())
    assert at(T.masks_and(a, b)) == [i for i in range(400) if i % 12 == 1]
    assert at(T.masks_or(a, b)) == sorted({i for i in range(600) if i % 4 == 1} | {i for i in range(400) if i % 6 == 1})
    assert at(T.filter_masks(a, lambda m: F.lit(0).cast("bigint"))) == []


def test_csv_lines_are_numbered_over_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\n2\n")
    (tmp_path / "b.csv").write_text("\n".join(map(str, range(3, 500))) + "\n")
    (tmp_path / "c.csv").write_text("500\n")
    got = S.csv_histograms(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ts, r.n) for r in got] == [(i, i + 1) for i in range(500)]


def test_csv_histograms(spark, tmp_path):
    (tmp_path / "h.csv").write_text("1,2,3\n4,6, 8\n")
    got = S.csv_histograms(spark, str(tmp_path)).orderBy("ts", "bucket").collect()
    assert [r.n for r in got] == [1, 2, 3, 4, 6, 8] and [r.bucket for r in got] == [0, 1, 2] * 2


def test_save_and_open(spark, tmp_path):
    S.save_vector(make(spark, range(300)), str(tmp_path / "v"))
    assert values(S.open_vector(spark, str(tmp_path / "v"), "bigint")) == list(range(300))
    with pytest.raises(WrongVectorType):
        S.open_vector(spark, str(tmp_path / "v"), "float")


@pytest.mark.parametrize("series", [[5, 3, 7], [0, 1000, 1001, 1002, 1003, 2005, 2010, 3034], sorted(random.Random(2).choices(range(2**40), k=700))])
def test_successive_delta(spark, series):
    got = X.successive_delta(make(spark, series))
    expected = [max(b - a, 0) for a, b in zip([0] + series, series)]
    assert values(got) == expected
    total, sums = 0, []
    for d in expected:
        total += d
        sums.append(total)
    assert values(X.running_sum(got)) == sums


def test_lags_and_totals_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BITS", 4)
    v = random.Random(3).choices(range(1000), k=100)
    assert values(X.running_sum(make(spark, v))) == [sum(v[: i + 1]) for i in range(100)]
    assert values(X.running_xor(X.xor_previous(make(spark, v)))) == v
    assert [r.prev for r in X.with_previous(make(spark, v)).orderBy("pos").collect()] == [0] + v[:-1]


def test_xor_forms(spark):
    v = [0.0, 0.5, 2.5, 10.0, 25.0, 100.0]
    df = make(spark, v, "double").withColumn("v", bits.double_bits(F.col("v")))
    back = X.running_xor(X.xor_previous(df)).withColumn("v", bits.bits_double(F.col("v")))
    assert values(back) == v
    f = make(spark, [x / 2.8 for x in range(280)], "float")
    b = f.withColumn("v", bits.float_bits(F.col("v")))
    restored = X.undo_xor_octets(X.xor_octets(b)).withColumn("v", bits.bits_float(F.col("v")))
    assert values(restored) == values(f)


def test_delta_from_least(spark):
    v = [10_000 + i for i in range(300)]
    d = X.delta_from_least(make(spark, v))
    assert values(d)[:3] == [0, 1, 2] and values(X.undo_delta_from_least(d)) == v


def test_wrapping_add(spark):
    assert values(X.add_constant_wrapping(make(spark, [2**32 - 1, None]), 3, 32)) == [2, 3]


@pytest.mark.parametrize(
    ("v", "t"), [([23000] * 256, "Constant"), ([0] * 256, "Null"), (list(range(256)), "NibblePackedMedium"), (list(range(10000, 10256)), "DeltaNPMedium")]
)
def test_section_types(spark, v, t):
    assert E.section_types(T.section_stats(make(spark, v))).first().t == t


def test_float_section_types(spark):
    kind = lambda v: E.float_section_types(T.section_stats(make(spark, v, "float"))).first().t
    assert kind([3.5] * 256) == "Constant" and kind([0.0] * 256) == "Null" and kind([x / 1.6 for x in range(256)]) == "XorNPMedium"
    assert kind([3.0, 1.0, math.nan] + [1.0] * 253) == "XorNPMedium"
    assert kind([1.0, math.nan] + [1.0] * 254) == "XorNPMedium"


def test_delta_range(spark):
    got = T.section_bits(T.section_stats(make(spark, [1_700_000_000_000 + i for i in range(256)]))).first()
    assert got.delta_range == 256
    assert E.section_bytes(make(spark, [1_700_000_000_000 + i for i in range(256)])).first().bytes < 350
    assert E.section_bytes(make(spark, [400] * 256)).first().bytes == 9
    E.section_bytes(make(spark, [2**62] + [0] * 255)).collect()
