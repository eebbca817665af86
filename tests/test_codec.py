"""The byte format: known bytes, round trips, and agreement with the encoding advisor."""

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavec.functions.model import InvalidFormat, InputTooShort, InvalidNumRows, WrongVectorType
from stratavec.operators import encoding as E
from stratavec.sources import codec as C
from tests.test_vectors import make


def test_known_bytes():  # fixed values of the format
    assert C.pack_octet([0] * 8) == b"\0"
    even = C.pack_octet([0xFEDCBA0000] * 8)
    assert len(even) == 26 and even[:5] == bytes.fromhex("ff54badcfe")
    odd = bytes.fromhex("3e4521322333444354455566436507")  # five elements of five nibbles
    values, end = C.unpack_octet(odd)
    assert end == len(odd) and sum(v != 0 for v in values) == 5 and C.pack_octet(values) == odd
    got = C.pack([0, 0, -1, -2, 0, -100234, 0, 0])
    assert len(got) == 26 and got[:2] == bytes.fromhex("2cf0")


def test_streams():
    rising = [0, 1000, 1001, 1002, 1003, 2005, 2010, 3034, 4045, 5056, 6067, 7078]
    assert C.unpack(C.pack(rising), 12)[0][:12] == rising
    assert C.unpack_deltas(C.pack_deltas(rising), 12)[:12] == rising
    doubles = [0, 0.5, 2.5, 10, 25, 100]
    assert C.unpack_doubles(C.pack_doubles(doubles), 6) == doubles
    with pytest.raises(InputTooShort):
        C.pack_doubles([])
    with pytest.raises(InputTooShort):
        C.unpack(C.pack([65535] * 8)[:-3], 8)


@pytest.mark.parametrize("v", [[0, 0, 0, 0, 1152921504606846976, 0, 0, 1], [0, 0, 0, 0, 0, 0, 1, 16], [0, 0], [1, 1, 256], [65535] * 8])
def test_seeds(v):
    assert C.unpack(C.pack(v), len(v))[0][: len(v)] == v


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 2**64 - 1), st.integers(0, 2**20)), max_size=60))
def test_round_trip(v):
    assert C.unpack(C.pack(v), len(v))[0][: len(v)] == v


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(allow_nan=True, width=64), min_size=1, max_size=40))
def test_doubles_round_trip(v):
    bits = lambda x: [struct.pack("<d", a) for a in x]
    assert bits(C.unpack_doubles(C.pack_doubles(v), len(v))) == bits(v)


def test_vectors():
    for kind, v in (("u64", list(range(500))), ("u32", [i % 4 + 1 for i in range(400)]), ("u64", [0] * 700 + [2] + [5] * 300), ("f32", [struct.unpack("<f", struct.pack("<f", x / 2.8))[0] for x in range(280)])):
        data = C.encode_vector(kind, v)
        assert C.decode_vector(data, kind) == v and C.open_bytes(data)[1] == len(v)
    data = C.encode_vector("u32", [1, 2, 3])
    with pytest.raises(WrongVectorType):
        C.decode_vector(data, "u64")
    with pytest.raises(InvalidNumRows):
        C.encode_vector("u32", [1, 2, 3], 2)
    assert C.decode_vector(C.encode_vector("u64", [1, None], 5)) == [1, 0, 0, 0, 0]
    odd = [3.0, 1.0, math.nan] + [1.0] * 253
    got = C.decode_vector(C.encode_vector("f32", odd))
    assert got[:2] == [3.0, 1.0] and math.isnan(got[2]) and got[3:] == [1.0] * 253


def test_large_vector_over_64k():
    rng = random.Random(4)
    v = [rng.randrange(2**60) for _ in range(20_000)]
    assert C.decode_vector(C.encode_vector("u64", v)) == v


def test_matching_in_encoded_bytes():
    v = [0] * 600 + [7] * 256 + [i % 12 for i in range(500)]
    data = C.encode_vector("u64", v)
    for wanted in ({0}, {7}, {3, 5}, set()):
        assert list(C.matching_positions(data, wanted)) == [i for i, x in enumerate(v) if x in wanted]


def test_advisor_agrees_with_bytes(spark):
    rng = random.Random(5)
    v = [0] * 256 + [9] * 256 + [10**6 + rng.randrange(300) for _ in range(256)] + [rng.choice([0, rng.randrange(2**40)]) for _ in range(300)]
    data = C.encode_vector("u64", v)
    sizes = [end - at for _, at, end in C.sections(data, "u64")]
    names = {C.NULL: "Null", C.CONSTANT: "Constant", C.PACKED: "NibblePackedMedium", C.DELTA: "DeltaNPMedium"}
    types = [names[code] for code, _, _ in C.sections(data, "u64")]
    got = E.section_bytes(make(spark, v)).orderBy("sect").collect()
    assert [r.bytes for r in got] == sizes and [r.t for r in got] == types
    assert E.vector_stats(make(spark, v)).first().bytes == len(data)


def test_files(spark, tmp_path):
    for name, v in (("a", [1, 2, 3, 1]), ("b", [1] * 300)):
        (tmp_path / name).write_bytes(C.encode_vector("u32", v))
    got = C.read_binary_vectors(spark, str(tmp_path), "u32")
    assert got.count() == 304
    assert C.read_matching(spark, str(tmp_path), "u32", [1]).count() == 302
    encoded = C.encode_sections(make(spark, list(range(300))), "u64").orderBy("sect").collect()
    assert bytes(encoded[0].encoded) == C.encode_section("u64", list(range(256)))


def test_histogram_bytes():
    data = C.pack_histogram(2.0, 1.5, [1, 0, 5, 9] * 4)
    assert data[:5] == bytes.fromhex("0112001000") and len(data) > 21
    assert C.unpack_histogram(data) == (2.0, 1.5, [sum(([1, 0, 5, 9] * 4)[: i + 1]) for i in range(16)])
    with pytest.raises(InputTooShort):
        C.unpack_histogram(data[:10])


def test_variable_sections():
    parts = [(bytes([i]) * 8, 8) for i in range(40)]
    data = C.write_chunks(parts, C.PACKED, max_elements=256)
    got = list(C.read_chunks(data))
    assert [(c, n) for c, n, _ in got] == [(C.PACKED, 256), (C.PACKED, 64)]
    assert b"".join(b for _, _, b in got) == b"".join(b for b, _ in parts)
    assert [n for _, n, _ in C.read_chunks(C.write_chunks([(b"x" * 40_000, 1)] * 3, C.PACKED, 256))] == [1, 1, 1]
    assert C.write_chunks([], C.PACKED, 256) == b""
    with pytest.raises(InvalidNumRows):
        C.write_chunks([(b"x" * 70_000, 1)], C.PACKED, 256)
    with pytest.raises(InputTooShort):
        list(C.read_chunks(data[:-1]))


def test_wide_values_and_files(spark, tmp_path):
    v = [2**64 - 1, 2**63, 5, 0] * 200
    (tmp_path / "w").write_bytes(C.encode_vector("u64", v))
    got = [r.v % 2**64 for r in C.read_binary_vectors(spark, str(tmp_path), "u64").orderBy("pos").collect()]
    assert got == v
    assert C.read_matching(spark, str(tmp_path), "u64", [2**63]).count() == 200
    assert C.read_matching(spark, str(tmp_path), "u64", [-(2**63)]).count() == 200


def test_too_many_nibbles_for_32_bits():
    wide = C.pack([2**40 - 1] * 8)
    assert C.unpack(wide, 8)[0] == [2**40 - 1] * 8
    with pytest.raises(InvalidFormat):
        C.unpack(wide, 8, most_nibbles=C.NARROW)
    section = C.encode_section("u64", list(range(2**40, 2**40 + 255)) + [1])
    with pytest.raises(InvalidFormat):
        C.decode_section("u32", section, section[0], 0)


def test_another_encoder(spark):
    plain = lambda kind, v: bytes([C.PACKED]) + struct.pack("<H", len(C.pack(v))) + C.pack(v)
    v = list(range(10_000, 10_300))
    data = C.encode_vector("u64", v, encoder=plain)
    assert [code for code, _, _ in C.sections(data, "u64")] == [C.PACKED] * 2 and C.decode_vector(data) == v
    encoded = C.encode_sections(make(spark, v), "u64", plain)
    assert {r.encoded[0] for r in encoded.collect()} == {C.PACKED}
    assert [r.v for r in C.decode_sections(encoded, "u64").orderBy("pos").collect()] == v


@pytest.mark.parametrize("n", [256, 300, 5, 511])
def test_float_sizes_agree_with_bytes(spark, n):
    v = [struct.unpack("<f", struct.pack("<f", (i % 37) / 2.8))[0] for i in range(n)]
    data = C.encode_vector("f32", v)
    got = E.float_section_bytes(make(spark, v, "float")).orderBy("sect").collect()
    assert [r.bytes for r in got] == [end - at for _, at, end in C.sections(data, "f32")] and sum(r.n for r in got) == n
    assert E.float_vector_stats(make(spark, v, "float")).first().bytes == len(data)
    with_nan = make(spark, [0.0, float("nan")] + [0.0] * 254 + [2.5] * 256, "float")
    assert [r.bytes for r in E.float_section_bytes(with_nan).orderBy("sect").collect()][1] == 5


def counted(kind):
    """A function that makes objects of a class under kind, and a list with the number of those that are alive."""
    alive = [0]

    class Counted(kind):
        def __del__(self):
            alive[0] -= 1

    def make_one(content):
        alive[0] += 1
        return Counted(content)

    return make_one, alive


def test_few_encoded_sections_are_held_at_a_time(spark):
    make_one, alive = counted(bytes)
    df = spark.range(0, 256 * 1500, 1, 1).select(F.lit("v").alias("vec"), F.col("id").alias("pos"), F.col("id").alias("v")).coalesce(1)
    encoded = C.encode_sections(df, "u64", lambda kind, v: make_one(alive[0].to_bytes(4)))
    held = [int.from_bytes(r.encoded) for r in encoded.collect()]
    assert len(held) == 1500 and max(held) <= C.SECTIONS_AT_ONCE


def test_few_unpacked_lists_are_held_at_a_time(spark, monkeypatch):
    make_one, alive = counted(list)
    monkeypatch.setitem(C.STREAMS, "double", (C.STREAMS["double"][0], lambda data, n: make_one([float(alive[0])] * n)))
    df = spark.range(0, 1500, 1, 1).select("id", F.lit(C.pack_doubles([1.5] * 256)).alias("packed"), F.lit(256).alias("n"))
    held = [r.unpacked[0] for r in C.unpack_streams(df, "packed", "n", "double").collect()]
    assert len(held) == 1500 and max(held) <= C.SECTIONS_AT_ONCE


def test_pieces():
    n = C.ELEMENTS_AT_ONCE
    assert list(C.pieces([])) == [] and list(C.pieces([0])) == [(0, 1)] and list(C.pieces([None, n, 1])) == [(0, 2), (2, 3)]
    assert list(C.pieces([3 * n, 1, n - 1, 1, 2 * n])) == [(0, 1), (1, 3), (3, 4), (4, 5)]


@pytest.mark.parametrize("form", ["plain", "delta", "double"])
def test_streams_of_any_length_in_pieces(spark, form):
    kind = "double" if form == "double" else "bigint"
    number = float if form == "double" else int
    lists = [[number(i + k) for i in range(n)] for k, n in enumerate([0, 1, 70_000, 8, 300, 0, 66_000] + [256] * 600)]
    lists[3:3] = [None]
    df = spark.createDataFrame(list(enumerate(lists)), f"id int, l array<{kind}>").coalesce(1).withColumn("n", F.size("l"))
    back = C.unpack_streams(C.pack_streams(df, "l", form), "packed", "n", form)
    assert [r.unpacked for r in back.orderBy("id").collect()] == lists
