"""The binary interchange format: nibble-packed octets, sections of 256 elements, vectors, and f64 streams.

An octet is a mask byte (bit i: element i is not zero), and unless that is 0 a byte with (nibbles - 1) << 4 | trailing zero
nibbles, then the non-zero elements, shifted right by the trailing nibbles, each in that many nibbles, low ones first.
Python's integers serve as bit strings here; the codec is for interchange, not for the hot path. In tables, u64 elements
are bigints with the same 64 bits (see model.unsigned)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import OCTET, SECTION, InputTooShort, InvalidFormat, InvalidNumRows, MAX_ROWS, WrongVectorType, whole

#: Fixed values of the format.
NULL, PACKED, DELTA, CONSTANT, XOR = 0, 1, 3, 5, 6
FIXED_SECTION_256 = 0x10
SUBTYPES = {"u64": 0x10, "u32": 0x11, "f32": 0x12}
WIDTHS = {"u64": 8, "u32": 4, "f32": 4}
HEADER = "<IBBHIHH"
HEADER_BYTES = 16
MASK = 2**64 - 1
#: Half bytes that an element of 32 bits has.
NARROW = 8
#: Sections that readers decode at a time.
SECTIONS_AT_ONCE = 256
#: Elements that are Python objects at a time where lists become bytes or the other way round; a single list may have more.
ELEMENTS_AT_ONCE = SECTIONS_AT_ONCE * SECTION


def pack_octet(values: list[int]) -> bytes:
    values = [v & MASK for v in values]
    live = [v for v in values if v]
    mask = sum(1 << i for i, v in enumerate(values) if v)
    if not live:
        return b"\0"
    union = 0
    for v in live:
        union |= v
    low = ((union & -union).bit_length() - 1) // 4
    width = (union.bit_length() + 3) // 4 - low
    text = 0
    for i, v in enumerate(live):
        text |= (v >> 4 * low) << 4 * width * i
    return bytes([mask, (width - 1) << 4 | low]) + text.to_bytes((width * len(live) + 1) // 2, "little")


def unpack_octet(data: bytes, at: int = 0, most_nibbles: int = 16) -> tuple[list[int], int]:
    """(eight values, where the next octet begins). most_nibbles is what an element may have: NARROW for 32 bits."""
    if at >= len(data):
        raise InputTooShort("no octet")
    mask = data[at]
    if not mask:
        return [0] * OCTET, at + 1
    if at + 2 > len(data):
        raise InputTooShort("octet without widths")
    width, low = (data[at + 1] >> 4) + 1, data[at + 1] & 15
    if width > most_nibbles:
        raise InvalidFormat(f"an octet of {width} nibbles, at most {most_nibbles} fit")
    end = at + 2 + (width * mask.bit_count() + 1) // 2
    if end > len(data):
        raise InputTooShort("octet is cut off")
    text, out, k = int.from_bytes(data[at + 2 : end], "little"), [], 0
    for i in range(OCTET):
        if mask >> i & 1:
            out.append((text >> 4 * width * k & (1 << 4 * width) - 1) << 4 * low & MASK)
            k += 1
        else:
            out.append(0)
    return out, end


def pack(values: Iterable[int]) -> bytes:
    """A stream of any length, padded with zeros to whole octets."""
    values = list(values)
    values += [0] * (-len(values) % OCTET)
    return b"".join(pack_octet(values[i : i + OCTET]) for i in range(0, len(values), OCTET))


def unpack(data: bytes, n: int, at: int = 0, most_nibbles: int = 16) -> tuple[list[int], int]:
    """(n values rounded up to whole octets, where the stream ends)."""
    out: list[int] = []
    while len(out) < n:
        octet, at = unpack_octet(data, at, most_nibbles)
        out += octet
    return out, at


def pack_deltas(values: Iterable[int]) -> bytes:
    """Successive differences, 0 where the series falls."""
    out, last = [], 0
    for v in values:
        out.append(max(v - last, 0))
        last = v
    return pack(out)


def unpack_deltas(data: bytes, n: int) -> list[int]:
    out, total = [], 0
    for v in unpack(data, n)[0]:
        total = total + v & MASK
        out.append(total)
    return out


def _double(v: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", v))[0]


def pack_doubles(values: Iterable[float]) -> bytes:
    """The first value as it is, then each one's bits XOR those before."""
    bits = [_double(v) for v in values]
    if not bits:
        raise InputTooShort("a stream of doubles needs a value")
    return struct.pack("<Q", bits[0]) + pack(a ^ b for a, b in zip(bits[1:], bits))


def unpack_doubles(data: bytes, n: int) -> list[float]:
    if len(data) < 8:
        raise InputTooShort("no first value")
    last = struct.unpack_from("<Q", data)[0]
    out = [last]
    for v in unpack(data, n - 1, 8)[0] if n > 1 else []:
        last ^= v
        out.append(last)
    return [struct.unpack("<d", struct.pack("<Q", v))[0] for v in out[:n]]


def _to_bits(kind: str, v) -> int:
    return struct.unpack("<I", struct.pack("<f", v))[0] if kind == "f32" else int(v) & (MASK if kind == "u64" else 0xFFFFFFFF)


def _from_bits(kind: str, v: int):
    return struct.unpack("<f", struct.pack("<I", v & 0xFFFFFFFF))[0] if kind == "f32" else v


def _nibbles(v: int) -> int:
    return (v.bit_length() + 3) // 4


def encode_section(kind: str, values: list) -> bytes:
    """256 elements in the section type that suits them. Sections with a NaN are always packed, so none is lost."""
    bits = [_to_bits(kind, v) for v in values]
    if kind == "f32":
        if len(set(bits)) == 1 or all(v == 0 for v in values):
            return bytes([NULL]) if values[0] == 0 else bytes([CONSTANT]) + struct.pack("<I", bits[0])
        body = pack(b ^ (bits[i - OCTET] if i >= OCTET else 0) for i, b in enumerate(bits))
        return bytes([XOR]) + struct.pack("<H", 3 + len(body)) + body
    least, most = min(bits), max(bits)
    if least == most:
        return bytes([NULL]) if not most else bytes([CONSTANT]) + most.to_bytes(WIDTHS[kind], "little")
    if _nibbles(most - least) < _nibbles(most):
        body = pack(b - least for b in bits)
        return bytes([DELTA]) + struct.pack("<HB", len(body), (most - least).bit_length()) + least.to_bytes(8, "little") + body
    body = pack(bits)
    return bytes([PACKED]) + struct.pack("<H", len(body)) + body


def sections(data: bytes, kind: str) -> Iterator[tuple[int, int, int]]:
    """(type, start, end) of each section after the header, without decoding."""
    at = HEADER_BYTES
    while at < len(data):
        code = data[at]
        if code == NULL:
            end = at + 1
        elif code == CONSTANT:
            end = at + 1 + WIDTHS[kind]
        elif at + 3 > len(data):
            raise InputTooShort("section without its length")
        else:
            n = struct.unpack_from("<H", data, at + 1)[0]
            allowed = (XOR,) if kind == "f32" else (PACKED, DELTA)
            if code not in allowed:
                raise InvalidFormat(f"section type {code} in a vector of {kind}")
            end = at + (n if code == XOR else 3 + n if code == PACKED else 12 + n)
        if end > len(data):
            raise InputTooShort("section is cut off")
        yield code, at, end
        at = end


def decode_section(kind: str, data: bytes, code: int, at: int) -> list:
    if code == NULL:
        return [_from_bits(kind, 0)] * SECTION
    if code == CONSTANT:
        return [_from_bits(kind, int.from_bytes(data[at + 1 : at + 1 + WIDTHS[kind]], "little"))] * SECTION
    most = 16 if kind == "u64" else NARROW
    if code == PACKED:
        return unpack(data, SECTION, at + 3, most)[0]
    if code == DELTA:
        base = int.from_bytes(data[at + 4 : at + 4 + WIDTHS[kind]], "little")
        return [base + v & (MASK if kind == "u64" else 0xFFFFFFFF) for v in unpack(data, SECTION, at + 12, most)[0]]
    bits = unpack(data, SECTION, at + 3, most)[0]
    for i in range(OCTET, SECTION):
        bits[i] ^= bits[i - OCTET]
    return [_from_bits(kind, b) for b in bits]


Encoder = Callable[[str, list], bytes]


def encode_vector(kind: str, values: Iterable, total_rows: int | None = None, encoder: Encoder = encode_section) -> bytes:
    """A whole vector, finished with total_rows; encoder makes one section of the 256 elements that it gets."""
    values = [0 if v is None else v for v in values]
    n = len(values) if total_rows is None else total_rows
    if n < len(values) or n > MAX_ROWS:
        raise InvalidNumRows(f"{n} rows for {len(values)} elements")
    values += [0] * (-(-n // SECTION) * SECTION - len(values))
    parts = [encoder(kind, values[i : i + SECTION]) for i in range(0, len(values), SECTION)]
    nulls = min(65535, sum(p[0] == NULL for p in parts))
    body = b"".join(parts)
    return struct.pack(HEADER, HEADER_BYTES - 4 + len(body), FIXED_SECTION_256, SUBTYPES[kind], 0, n, nulls, 0) + body


def open_bytes(data: bytes, kind: str | None = None) -> tuple[str, int, int]:
    """(kind, elements, null sections) of a vector's header."""
    if len(data) < HEADER_BYTES:
        raise InputTooShort("no header")
    size, _, subtype, _, n, nulls, _ = struct.unpack_from(HEADER, data)
    if size + 4 > len(data):
        raise InputTooShort("vector is cut off")
    found = next((k for k, v in SUBTYPES.items() if v == subtype), None)
    if found is None or (kind is not None and found != kind):
        raise WrongVectorType(f"subtype {subtype} is {found}, not {kind}")
    return found, n, nulls


def decoded_sections(data: bytes, kind: str | None = None) -> Iterator[list]:
    """The elements of each section, those that pad the last one left out."""
    kind, n, _ = open_bytes(data, kind)
    for s, (code, at, _) in enumerate(sections(data, kind)):
        yield decode_section(kind, data, code, at)[: max(0, n - s * SECTION)]


def decode_vector(data: bytes, kind: str | None = None) -> list:
    return [v for part in decoded_sections(data, kind) for v in part]


def section_matches(kind: str, data: bytes, code: int, at: int, n: int, values: set) -> Iterable[int]:
    """Which of a section's first n elements are among values; null and constant sections are decided without decoding."""
    if code in (NULL, CONSTANT):
        value = 0 if code == NULL else _from_bits(kind, int.from_bytes(data[at + 1 : at + 1 + WIDTHS[kind]], "little"))
        return range(n) if value in values else ()
    return [i for i, v in enumerate(decode_section(kind, data, code, at)[:n]) if v in values]


def matching_positions(data: bytes, values: set, kind: str | None = None) -> Iterator[int]:
    """Positions of elements among values."""
    kind, n, _ = open_bytes(data, kind)
    for s, (code, at, _) in enumerate(sections(data, kind)):
        yield from (s * SECTION + i for i in section_matches(kind, data, code, at, min(SECTION, n - s * SECTION), values))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _element(kind: str) -> tuple[pa.DataType, str, Callable]:
    """Arrow and SQL type of a table's elements, and an array of them."""
    if kind == "f32":
        return pa.float32(), "float", lambda v: pa.array(v, pa.float32())
    return pa.int64(), "bigint", lambda v: pa.array([x - 2**64 if x >= 2**63 else x for x in v], pa.int64())


def _wanted(kind: str, values: Iterable) -> set:
    return set(values) if kind == "f32" else {int(v) & (MASK if kind == "u64" else 0xFFFFFFFF) for v in values}


def read_binary_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(vec, pos, v) of the vector files under a path; vec is the file's path. One file is one task's work at most,
    decoded SECTIONS_AT_ONCE sections at a time."""
    _, sql, array = _element(kind)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, at = [], 0
                for k, part in enumerate(decoded_sections(content, kind)):
                    held += part
                    if (k + 1) % SECTIONS_AT_ONCE == 0:
                        yield rows(name, at, held)
                        held, at = [], at + len(held)
                yield rows(name, at, held)

    def rows(name, at, values):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(range(at, at + len(values)), pa.int64()), array(values)], names=["vec", "pos", "v"])

    return _files(spark, path).mapInArrow(run, f"vec string, pos bigint, v {sql}")


def read_matching(spark: SparkSession, path: str, kind: str, values: Iterable) -> DataFrame:
    """(vec, pos) of the elements among values, filtered in the encoded bytes."""
    wanted = _wanted(kind, values)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(matching_positions(content, wanted, kind))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int64())], names=["vec", "pos"])

    return _files(spark, path).mapInArrow(run, "vec string, pos bigint")


def pieces(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive rows with ELEMENTS_AT_ONCE elements at most, one row at least; sizes are the rows'."""
    first, end, held = 0, 0, 0
    for end, n in enumerate(sizes):
        if end > first and held + (n or 0) > ELEMENTS_AT_ONCE:
            yield first, end
            first, held = end, 0
        held += n or 0
    if sizes:
        yield first, end + 1


def lists_to_bytes(to_bytes: Callable[[list], bytes]) -> Callable[[Column | str], Column]:
    """A function of a column of lists that gives each one's bytes, null for null. An Arrow batch has up to 10,000 lists;
    only those of one piece are taken out of it at a time."""

    @F.arrow_udf("binary")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for first, end in pieces(pc.list_value_length(lists).to_pylist()):
                held = (v.values for v in lists[first:end])
                yield pa.array([None if v is None else to_bytes(v.to_numpy(zero_copy_only=False).tolist()) for v in held], pa.binary())

    return convert


def encode_sections(df: DataFrame, kind: str, encoder: Encoder = encode_section) -> DataFrame:
    """(vec, sect, n, encoded): each section of the vectors (vec, pos, v) as bytes, sections spread over tasks. encoder
    makes a section's bytes from its 256 elements, zeros after the first n."""
    encode = lists_to_bytes(lambda v: encoder(kind, v + [0] * (SECTION - len(v))))
    rows = whole(df).groupBy("vec", F.shiftright("pos", 8).alias("sect")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))  # 256 at most
    return rows.select("vec", "sect", F.size("s").alias("n"), encode(F.transform("s", lambda x: x["v"])).alias("encoded"))


def _section_code(kind: str, data: bytes) -> int:
    code, _, _ = next(sections(bytes(HEADER_BYTES) + data, kind))
    return code


def decode_sections(encoded: DataFrame, kind: str) -> DataFrame:
    """(vec, pos, v) of the sections that encode_sections made."""
    _, sql, array = _element(kind)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vec, sect, n, data = (c[i].as_py() for c in batch.columns)
                values = decode_section(kind, data, _section_code(kind, data), 0)[:n]
                yield pa.RecordBatch.from_arrays([pa.array([vec] * n, pa.string()), pa.array(range(sect * SECTION, sect * SECTION + n), pa.int64()), array(values)], names=["vec", "pos", "v"])

    return encoded.select("vec", "sect", "n", "encoded").mapInArrow(run, f"vec string, pos bigint, v {sql}")


def match_sections(encoded: DataFrame, kind: str, values: Iterable) -> DataFrame:
    """(vec, pos) of the elements among values, filtered in the bytes that encode_sections made."""
    wanted = _wanted(kind, values)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vec, sect, n, data = (c[i].as_py() for c in batch.columns)
                found = [sect * SECTION + k for k in section_matches(kind, data, _section_code(kind, data), 0, n, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([vec] * len(found), pa.string()), pa.array(found, pa.int64())], names=["vec", "pos"])

    return encoded.select("vec", "sect", "n", "encoded").mapInArrow(run, "vec string, pos bigint")


#: The stream forms: how a list becomes bytes and, with its length, a list again.
STREAMS: dict[str, tuple[Callable, Callable]] = {
    "plain": (pack, lambda data, n: unpack(data, n)[0][:n]),
    "delta": (pack_deltas, lambda data, n: unpack_deltas(data, n)[:n]),
    "double": (lambda v: pack_doubles(v) if len(v) else b"", lambda data, n: unpack_doubles(data, n) if n else []),
}


def pack_streams(df: DataFrame, column: str, form: str, out: str = "packed") -> DataFrame:
    """df with the lists of a column as bytes of one of STREAMS."""
    return df.withColumn(out, lists_to_bytes(STREAMS[form][0])(column))


def unpack_streams(df: DataFrame, column: str, n: str, form: str, out: str = "unpacked") -> DataFrame:
    """df with the lists that a column's bytes hold; n names the column with their lengths. As in lists_to_bytes, one
    piece is taken up at a time: short streams may hold long lists, so their bytes do not tell what a batch takes."""
    back, wide = STREAMS[form][1], _element("u64")[2]
    element, sql = (pa.float64(), "double") if form == "double" else (pa.int64(), "bigint")

    @F.arrow_udf(f"array<{sql}>")
    def unpacked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, sizes in batches:
            sizes = sizes.to_pylist()
            for first, end in pieces(sizes):
                held = zip(data[first:end].to_pylist(), sizes[first:end])
                yield pa.array([None if b is None else back(b, int(k)) if form == "double" else wide(back(b, int(k))).to_pylist() for b, k in held], pa.list_(element))

    return df.withColumn(out, unpacked(column, n))


#: Format codes of packed histograms.
HISTOGRAM_EMPTY, GEOMETRIC_DELTA, GEOMETRIC_1_DELTA = 0, 1, 2
_HISTOGRAM = "<BHHdd"  # format, bytes of the bucket definition with the bucket count, buckets, first bound, multiplier


def pack_histogram(initial: float, multiplier: float, counts: list[int], code: int = GEOMETRIC_DELTA) -> bytes:
    """A geometric histogram; the counts are those of single buckets, which readers sum up."""
    return struct.pack(_HISTOGRAM, code, 18, len(counts), initial, multiplier) + pack(counts)


def unpack_histogram(data: bytes) -> tuple[float, float, list[int]]:
    """(first bound, multiplier, cumulative counts)."""
    if len(data) < struct.calcsize(_HISTOGRAM):
        raise InputTooShort("no histogram header")
    code, size, n, initial, multiplier = struct.unpack_from(_HISTOGRAM, data)
    if code not in (GEOMETRIC_DELTA, GEOMETRIC_1_DELTA) or size != 18:
        raise InvalidFormat(f"histogram format {code}")
    return initial, multiplier, unpack_deltas(data[3 + size :], n)[:n]


def pack_histograms(packed: DataFrame) -> DataFrame:
    """series, ts, encoded, from (series, ts, histogram: struct(initial, multiplier, buckets))."""

    @F.pandas_udf("binary")
    def encode(h: pd.DataFrame) -> pd.Series:
        return pd.Series([pack_histogram(i, m, b.tolist()) for i, m, b in zip(h.initial, h.multiplier, h.buckets)])

    return packed.select("series", "ts", encode("histogram").alias("encoded"))


def unpack_histograms(encoded: DataFrame) -> DataFrame:
    """series, ts, initial, multiplier, counts (cumulative)."""

    @F.pandas_udf("initial double, multiplier double, counts array<bigint>")
    def decode(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unpack_histogram(b) for b in data], columns=["initial", "multiplier", "counts"])

    return encoded.select("series", "ts", decode("encoded").alias("h")).select("series", "ts", "h.*")


def write_chunks(parts: Iterable[tuple[bytes, int]], code: int, max_elements: int, max_bytes: int = 65535) -> bytes:
    """Variable-size sections: parts of (bytes, elements) one after the other, each section with at most so many
    elements and bytes, behind a header of its bytes, elements and type."""
    out, body, n = [], b"", 0
    for data, elements in parts:
        if len(data) > max_bytes or elements > max_elements:
            raise InvalidNumRows(f"a part of {len(data)} bytes and {elements} elements fits no section")
        if body and (len(body) + len(data) > max_bytes or n + elements > max_elements):
            out.append(struct.pack("<HHB", len(body), n, code) + body)
            body, n = b"", 0
        body, n = body + data, n + elements
    if body or n:
        out.append(struct.pack("<HHB", len(body), n, code) + body)
    return b"".join(out)


def read_chunks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, elements, bytes) of each variable-size section."""
    at = 0
    while at < len(data):
        if at + 5 > len(data):
            raise InputTooShort("no section header")
        size, n, code = struct.unpack_from("<HHB", data, at)
        if at + 5 + size > len(data):
            raise InputTooShort("section is cut off")
        yield code, n, data[at + 5 : at + 5 + size]
        at += 5 + size


def chunk_round_trip(df: DataFrame, elements: int, parts: int) -> DataFrame:
    """(vec, part, values) of a vector's consecutive parts of so many elements, after they were written as sections of
    variable size, `parts` parts to a byte string, and read again."""
    kind = "vec string, part bigint, values array<bigint>"
    at = F.floor(F.col("pos") / elements).cast("bigint")
    lists = whole(df).groupBy("vec", at.alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        data = write_chunks([(pack(v.tolist()), len(v)) for v in rows["values"]], PACKED, elements)
        back = [unpack(body, n)[0][:n] for _, n, body in read_chunks(data)]
        return pd.DataFrame({"vec": rows.vec.tolist(), "part": rows.part.tolist(), "values": back})

    return lists.groupBy("vec", F.floor(F.col("part") / parts)).applyInPandas(each, kind)
