"""Queries over the vector operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import predicates as P
from ..functions.model import SECTION, lane, octet, section, unsigned, whole
from ..operators import encoding as E
from ..operators import histograms as H
from ..operators import terminals as T
from ..operators import transforms as X
from ..sources import codec as C
from ..sources import vectors as S
from ..sources.scratch import saved, scratch_path
from ..streaming.histograms import stream_time_diff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' user_id by event_id."""
    return S.vector(_read(spark, sf_dir, "events"), "event_id", "user_id")


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' ts in microseconds by event_id."""
    return S.vector(_read(spark, sf_dir, "events"), "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))


def value_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits of events' value by event_id."""
    return _read(spark, sf_dir, "events").select(F.lit("v").alias("vec"), F.col("event_id").alias("pos"), bits.double_bits(F.col("value")).alias("v"))


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of embeddings, one row's after another's, as one vector per table."""
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select(F.lit("e").alias("vec"), (F.col("vec_id") * 64 + F.col("i")).alias("pos"), "v")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse vector: user_id + 1 where the event is an error."""
    return _read(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("s").alias("vec"), F.col("event_id").alias("pos"), (F.col("user_id") + 1).alias("v"))


def dense_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _read(spark, sf_dir, "events").agg(F.count("*").alias("n")).select(F.lit("s").alias("vec"), "n")
    return S.densify(errors(spark, sf_dir), sizes=sizes)


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_built: dict[tuple[str, str], DataFrame] = {}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's l_linenumber by place in _ORDER. As a table without positions must be sorted first, the vector is built
    once in an application and kept; queries read it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        _built[key] = S.vector(S.with_positions(_read(spark, sf_dir, "lineitem").select(*_ORDER), *_ORDER), "pos", "l_linenumber")
    return _built[key]


def four_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users, times, line numbers and the densified errors, as four vectors of one table."""
    named = lambda df, name: df.select(F.lit(name).alias("vec"), "pos", F.col("v").cast("bigint").alias("v"))
    out = named(users(spark, sf_dir), "users")
    for df, name in ((times(spark, sf_dir), "times"), (lines(spark, sf_dir), "lines"), (dense_errors(spark, sf_dir), "errors")):
        out = out.unionByName(named(df, name))
    return out


_USERS = "SELECT event_id AS pos, user_id AS v FROM events"
_VALUE_BITS = "SELECT event_id AS pos, CAST(value::DOUBLE::BIT AS BIGINT) AS v FROM events"
_FLOATS = "SELECT vec_id * 64 + i - 1 AS pos, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
_DENSE = "SELECT event_id AS pos, CASE WHEN event_type = 'error' THEN user_id + 1 ELSE 0 END AS v FROM events"
_FOUR = f"""SELECT 'users' AS vec, pos, v FROM ({_USERS})
UNION ALL SELECT 'times', event_id, epoch_us(ts) FROM events
UNION ALL SELECT 'lines', row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1, l_linenumber FROM lineitem
UNION ALL SELECT 'errors', pos, v FROM ({_DENSE})"""
_STATS = f"""WITH b AS (SELECT vec, pos >> 8 AS sect, v FROM ({_FOUR})),
st AS (SELECT vec, sect, count(*) AS n, CASE WHEN count(*) < 256 THEN least(min(v), 0) ELSE min(v) END AS mn,
       CASE WHEN count(*) < 256 THEN greatest(max(v), 0) ELSE max(v) END AS mx FROM b GROUP BY 1, 2)"""
_TYPE = """CASE WHEN mn = mx AND mn = 0 THEN 'Null' WHEN mn = mx THEN 'Constant'
WHEN (CASE WHEN mx = mn THEN 0 ELSE (length(bin(mx - mn)) + 3) // 4 END) < (length(bin(mx)) + 3) // 4 THEN 'DeltaNPMedium' ELSE 'NibblePackedMedium' END"""
_OCTETS = f"""{_STATS}, ty AS (SELECT *, {_TYPE} AS t FROM st),
d AS (SELECT f.vec, f.pos >> 8 AS sect, f.pos >> 3 AS oct, t, CASE WHEN t = 'DeltaNPMedium' THEN v - mn ELSE v END AS v FROM ({_FOUR}) f JOIN ty ON f.vec = ty.vec AND f.pos >> 8 = ty.sect),
o AS (SELECT vec, sect, t, oct, bit_or(v) AS ob, count(*) FILTER (v <> 0) AS nz FROM d GROUP BY 1, 2, 3, 4),
om AS (SELECT vec, sect, t, oct, nz, CASE WHEN ob = 0 THEN 0 ELSE bit_count((ob & -ob) - 1) // 4 END AS low,
       CASE WHEN ob = 0 THEN 0 ELSE (length(bin(ob)) + 3) // 4 - bit_count((ob & -ob) - 1) // 4 END AS width FROM o),
z AS (SELECT vec, sect, t, sum(CASE WHEN nz = 0 THEN 1 ELSE 2 + ceil(nz * width / 2.0) END) + 32 - count(*) AS body FROM om GROUP BY 1, 2, 3),
zb AS (SELECT vec, sect, t, CAST(CASE t WHEN 'Null' THEN 1 WHEN 'Constant' THEN 9 WHEN 'DeltaNPMedium' THEN 12 + body ELSE 3 + body END AS BIGINT) AS bytes FROM z)"""


# Scans and folds


@_query(_USERS)
def scan_vector(spark, sf_dir):
    return whole(users(spark, sf_dir)).select("pos", "v")


@_query(f"SELECT CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, count(*) AS n FROM ({_USERS})")
def iterate_sum(spark, sf_dir):
    return T.fold(users(spark, sf_dir), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n")).drop("vec")


@_query("SELECT count(*) AS n, CAST(count(*) // 256 * 256 AS BIGINT) AS visible FROM events")
def num_elements(spark, sf_dir):
    per = T.fold(users(spark, sf_dir), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.floor(F.col("n") / SECTION) * SECTION), F.lit(0)).alias("visible"))


@_query(f"SELECT pos, v FROM ({_USERS}) WHERE pos < (SELECT count(*) // 256 * 256 FROM events)")
def flushed_scan(spark, sf_dir):
    return S.flushed(whole(users(spark, sf_dir))).select("pos", "v")


@_query(f"SELECT pos >> 8 AS sect, list(v ORDER BY pos) AS \"values\" FROM ({_USERS}) GROUP BY 1")
def section_scan(spark, sf_dir):
    return X.section_arrays(users(spark, sf_dir)).select("sect", "values")


@_query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderkey FROM orders")
def dense_positions(spark, sf_dir):
    return S.with_positions(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("pos", "o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS v FROM orders")
def positions_of_payload(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return S.vector(S.with_positions(df, "o_orderdate", "o_orderkey"), "pos", "o_totalprice").select("pos", "v")


# Filters


@_query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 3")
def filter_eq_count_u32(spark, sf_dir):
    return T.count_hits(_read(spark, sf_dir, "lineitem"), P.equals("l_linenumber", 3))


@_query("SELECT count(*) AS n FROM events WHERE user_id = 7")
def filter_eq_count_u64(spark, sf_dir):
    return T.count_hits(users(spark, sf_dir), P.equals("v", 7))


@_query("SELECT count(*) AS n FROM lineitem WHERE l_discount = 0.05 AND NOT isnan(l_discount)")
def filter_eq_count_f64(spark, sf_dir):
    return T.count_hits(_read(spark, sf_dir, "lineitem"), P.equals("l_discount", 0.05))


@_query(f"SELECT pos FROM ({_FLOATS}) WHERE v = (SELECT embedding[1] FROM embeddings WHERE vec_id = 0)")
def filter_eq_positions_f32(spark, sf_dir):
    df = floats(spark, sf_dir)
    wanted = df.where("pos = 0").select(F.col("v").alias("w"))
    return df.join(F.broadcast(wanted), F.col("v") == F.col("w")).select("pos")


@_query("SELECT count(*) AS n FROM events WHERE user_id IN (3, 5)")
def filter_oneof_count(spark, sf_dir):
    return T.count_hits(users(spark, sf_dir), P.one_of("v", [3, 5]))


@_query("SELECT event_id AS pos FROM events WHERE user_id IN (3, 5)")
def filter_oneof_positions(spark, sf_dir):
    return T.match_positions(users(spark, sf_dir), P.one_of("v", [3, 5])).select("pos")


@_query("SELECT event_id AS pos FROM events WHERE user_id = 3")
def filter_eq_positions(spark, sf_dir):
    return T.match_positions(users(spark, sf_dir), P.equals("v", 3)).select("pos")


@_query("SELECT event_id AS pos FROM events WHERE false")
def filter_empty(spark, sf_dir):
    return users(spark, sf_dir).where(P.nothing()).select("pos")


@_query("SELECT event_id AS pos FROM events WHERE false")
def filter_oneof_empty(spark, sf_dir):
    return T.match_positions(users(spark, sf_dir), P.one_of("v", [])).select("pos")


@_query(f"SELECT count(*) AS n FROM ({_DENSE}) WHERE v = 0")
def filter_zero_logical(spark, sf_dir):
    return T.count_hits(dense_errors(spark, sf_dir), P.equals("v", 0))


@_query(f"SELECT CAST(count(*) FILTER (v = 0) + ceil(count(*) / 256.0) * 256 - count(*) AS BIGINT) AS n FROM ({_DENSE})")
def filter_zero_padded(spark, sf_dir):
    return T.padded_hits(dense_errors(spark, sf_dir), P.equals("v", 0), P.matches_zero([0])).select("n")


@_query("SELECT event_id AS pos FROM events WHERE user_id % 10 = 4")
def filter_custom(spark, sf_dir):
    return T.match_positions(users(spark, sf_dir), F.col("v") % 10 == 4).select("pos")


@_query("SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 3 AND l_quantity IN (5, 10)")
def multi_filter_count(spark, sf_dir):
    return T.count_hits(_read(spark, sf_dir, "lineitem"), P.all_of(P.equals("l_linenumber", 3), P.one_of("l_quantity", [5.0, 10.0])))


@_query("SELECT event_id AS pos FROM events WHERE event_type = 'click' AND user_id IN (1, 2, 3, 4, 5)")
def multi_filter_positions(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select(F.lit("v").alias("vec"), F.col("event_id").alias("pos"), "user_id", "event_type")
    return T.match_positions(df, P.all_of(F.col("event_type") == "click", P.one_of("user_id", [1, 2, 3, 4, 5]))).select("pos")


@_query("SELECT e.event_id AS pos FROM events e JOIN orders o ON e.event_id = o.o_orderkey WHERE e.user_id IN (1, 2, 3) AND o.o_custkey <= 500 AND o.o_orderstatus = 'F'")
def multi_filter_join(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"), "o_orderstatus")
    return T.matching_rows((users(spark, sf_dir), P.one_of("v", [1, 2, 3])), (orders, (F.col("v") <= 500) & (F.col("o_orderstatus") == "F")))


# Masks


@_query(f"SELECT pos >> 8 AS sect, (pos >> 5) & 7 AS word, bit_or(CASE WHEN v IN (3, 5) THEN 1::BIGINT << (pos & 31) ELSE 0 END) AS mask FROM ({_USERS}) GROUP BY 1, 2")
def section_masks(spark, sf_dir):
    return T.section_masks(users(spark, sf_dir), P.one_of("v", [3, 5])).drop("vec")


@_query(f"SELECT pos >> 8 AS sect, count(*) FILTER (v IN (3, 5)) AS hits FROM ({_USERS}) GROUP BY 1")
def section_hit_counts(spark, sf_dir):
    return T.mask_hits(T.section_masks(users(spark, sf_dir), P.one_of("v", [3, 5]))).drop("vec")


@_query("SELECT event_id AS pos FROM events WHERE user_id IN (3, 5)")
def mask_positions(spark, sf_dir):
    return T.mask_positions(T.section_masks(users(spark, sf_dir), P.one_of("v", [3, 5]))).select("pos")


@_query("SELECT pos >> 8 AS sect, (pos >> 5) & 7 AS word, bit_or(CASE WHEN v IN (3, 5) AND t = 'click' THEN 1::BIGINT << (pos & 31) ELSE 0 END) AS mask FROM (SELECT event_id AS pos, user_id AS v, event_type AS t FROM events) GROUP BY 1, 2")
def masks_and(spark, sf_dir):
    one, other = _two_masks(spark, sf_dir)
    return T.masks_and(one, other).drop("vec")


@_query("SELECT pos >> 8 AS sect, (pos >> 5) & 7 AS word, bit_or(CASE WHEN v IN (3, 5) OR t = 'click' THEN 1::BIGINT << (pos & 31) ELSE 0 END) AS mask FROM (SELECT event_id AS pos, user_id AS v, event_type AS t FROM events) GROUP BY 1, 2")
def masks_or(spark, sf_dir):
    one, other = _two_masks(spark, sf_dir)
    return T.masks_or(one, other).drop("vec")


@_query("SELECT pos >> 8 AS sect, (pos >> 5) & 7 AS word, bit_or(CASE WHEN v IN (3, 5) AND pos % 2 = 0 THEN 1::BIGINT << (pos & 31) ELSE 0 END) AS mask FROM (SELECT event_id AS pos, user_id AS v FROM events) GROUP BY 1, 2")
def mask_filter(spark, sf_dir):
    """Each mask's matches at even positions."""
    masks = T.section_masks(users(spark, sf_dir), P.one_of("v", [3, 5]))
    return T.filter_masks(masks, lambda m: m.bitwiseAND(F.lit(0x55555555).cast("bigint"))).drop("vec")


def _two_masks(spark, sf_dir):
    typed = S.vector(_read(spark, sf_dir, "events"), "event_id", "event_type")
    return T.section_masks(users(spark, sf_dir), P.one_of("v", [3, 5])), T.section_masks(typed, F.col("v") == "click")


# Section statistics and the encoding advisor


@_query(f"{_STATS} SELECT vec, sect, n, mn, mx FROM st")
def section_minmax(spark, sf_dir):
    return T.section_stats(four_vectors(spark, sf_dir))


@_query(f"{_STATS} SELECT vec, sect, mx - mn AS span, CAST(CASE WHEN mx = mn THEN 0 ELSE length(bin(mx - mn)) END AS INTEGER) AS span_bits, CAST(CASE WHEN mx = 0 THEN 0 ELSE length(bin(mx)) END AS INTEGER) AS max_bits, 1::BIGINT << CAST(CASE WHEN mx = mn THEN 0 ELSE length(bin(mx - mn)) END AS INTEGER) AS delta_range FROM st")
def section_bits(spark, sf_dir):
    return T.section_bits(T.section_stats(four_vectors(spark, sf_dir))).select("vec", "sect", "span", "span_bits", "max_bits", "delta_range")


@_query(f"{_STATS} SELECT vec, sect, {_TYPE} AS t FROM st")
def section_types(spark, sf_dir):
    return E.section_types(T.section_stats(four_vectors(spark, sf_dir)))


@_query(f"{_STATS} SELECT vec, t, count(*) AS n FROM (SELECT vec, {_TYPE} AS t FROM st) GROUP BY 1, 2")
def section_type_hist(spark, sf_dir):
    return E.type_histogram(E.section_types(T.section_stats(four_vectors(spark, sf_dir))))


@_query(f"{_STATS} SELECT vec, count(*) AS n_sections, count(*) FILTER (mn = 0 AND mx = 0) AS null_sections FROM st GROUP BY 1")
def null_sections(spark, sf_dir):
    return T.null_sections(T.section_stats(four_vectors(spark, sf_dir)))


@_query(f"WITH st AS (SELECT pos >> 8 AS sect, min(v) FILTER (NOT isnan(v)) AS mn, max(v) FILTER (NOT isnan(v)) AS mx, bool_or(isnan(v)) AS nan FROM ({_FLOATS}) GROUP BY 1) SELECT sect, CASE WHEN mn = mx AND NOT nan AND mn = 0 THEN 'Null' WHEN mn = mx AND NOT nan THEN 'Constant' ELSE 'XorNPMedium' END AS t FROM st")
def float_section_types(spark, sf_dir):
    return E.float_section_types(T.section_stats(floats(spark, sf_dir))).select("sect", "t")


@_query(f"{_OCTETS} SELECT vec, sect, t, oct, nz, CAST(low AS BIGINT) AS low_nibbles, CAST(width AS BIGINT) AS width FROM om")
def octet_meta(spark, sf_dir):
    return E.octets(four_vectors(spark, sf_dir)).drop("n")


@_query(f"{_OCTETS} SELECT vec, sect, t, bytes FROM zb")
def section_bytes(spark, sf_dir):
    return E.section_bytes(four_vectors(spark, sf_dir)).drop("n")


_VECTOR_STATS = f"{_OCTETS}, vs AS (SELECT zb.vec, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) + 16 AS BIGINT) AS bytes, count(*) AS n_sections, count(*) FILTER (t = 'Null') AS null_sections FROM zb JOIN st ON zb.vec = st.vec AND zb.sect = st.sect GROUP BY 1)"


@_query(f"{_VECTOR_STATS} SELECT * FROM vs")
def vector_stats(spark, sf_dir):
    return E.vector_stats(four_vectors(spark, sf_dir))


@_query(f"{_VECTOR_STATS} SELECT vec, printf('%d elements, %d bytes (%.2f per element), %d sections, %d null', n, bytes, bytes / n, n_sections, null_sections) AS summary FROM vs")
def vector_summary(spark, sf_dir):
    return E.summary(E.vector_stats(four_vectors(spark, sf_dir)))


_F32_BITS = f"SELECT pos, CAST(v::FLOAT::BIT AS INTEGER) AS v FROM ({_FLOATS})"
_F32_SIZES = f"""WITH st AS (SELECT pos >> 8 AS sect, count(*) AS n, min(v) FILTER (NOT isnan(v)) AS mn, max(v) FILTER (NOT isnan(v)) AS mx, bool_or(isnan(v)) AS nan FROM ({_FLOATS}) GROUP BY 1),
ty AS (SELECT sect, n, CASE WHEN mn = mx AND NOT nan AND mn = 0 THEN 'Null' WHEN mn = mx AND NOT nan THEN 'Constant' ELSE 'XorNPMedium' END AS t FROM st),
p AS (SELECT pos, v::BIGINT & 4294967295 AS b FROM ({_F32_BITS}) UNION ALL SELECT unnest(range(k, (k + 255) // 256 * 256)), 0 FROM (SELECT max(pos) + 1 AS k FROM ({_FLOATS}))),
d AS (SELECT pos, xor(b, coalesce(lag(b, 8) OVER (PARTITION BY pos >> 8 ORDER BY pos), 0)) AS b FROM p),
o AS (SELECT pos >> 8 AS sect, pos >> 3 AS oct, bit_or(b) AS ob, count(*) FILTER (b <> 0) AS nz FROM d GROUP BY 1, 2),
z AS (SELECT sect, sum(CASE WHEN nz = 0 THEN 1 ELSE 2 + ceil(nz * ((length(bin(ob)) + 3) // 4 - bit_count((ob & -ob) - 1) // 4) / 2.0) END) AS body FROM o GROUP BY 1),
zb AS (SELECT sect, t, n, CAST(CASE t WHEN 'Null' THEN 1 WHEN 'Constant' THEN 5 ELSE 3 + body END AS BIGINT) AS bytes FROM ty JOIN z USING (sect))"""


@_query(f"{_F32_SIZES} SELECT sect, t, bytes FROM zb")
def float_section_bytes(spark, sf_dir):
    return E.float_section_bytes(floats(spark, sf_dir)).select("sect", "t", "bytes")


@_query(f"{_F32_SIZES} SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) + 16 AS BIGINT) AS bytes, count(*) AS n_sections, count(*) FILTER (t = 'Null') AS null_sections FROM zb")
def float_vector_stats(spark, sf_dir):
    return E.float_vector_stats(floats(spark, sf_dir)).drop("vec")


# Building


@_query(_DENSE)
def densify_sparse(spark, sf_dir):
    return dense_errors(spark, sf_dir).select("pos", "v")


@_query("SELECT i AS pos, coalesce(s_nationkey, 0) AS v FROM (SELECT unnest(range(0, 5000)) AS i) LEFT JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_nationkey FROM supplier) ON i = pos")
def finish_padded(spark, sf_dir):
    """The first 5,000 positions, as the SQL's join keeps them: all suppliers are numbered, and finish refuses more rows than it pads to."""
    df = S.with_positions(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return S.finish(S.vector(df, "pos", "s_nationkey").where("pos < 5000"), 5000).select("pos", "v")


@_query(f"SELECT pos, v FROM ({_USERS}) UNION ALL SELECT pos + (SELECT count(*) FROM events), v FROM ({_DENSE})")
def append_vectors(spark, sf_dir):
    return S.append(users(spark, sf_dir), dense_errors(spark, sf_dir).withColumn("vec", F.lit("v"))).select("pos", "v")


@_query(f"SELECT pos // 1000 AS chunk, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ({_USERS}) GROUP BY 1")
def chunk_assign(spark, sf_dir):
    return S.chunks(users(spark, sf_dir), 1000).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


# Transforms


@_query(f"SELECT pos, v + 25 AS v FROM ({_USERS})")
def add_const(spark, sf_dir):
    return X.add_constant(users(spark, sf_dir), 25).select("pos", F.col("v").cast("bigint").alias("v"))


@_query("SELECT event_id AS pos, (user_id + 4294967290) % 4294967296 AS v FROM events")
def add_const_wrapping(spark, sf_dir):
    return X.add_constant_wrapping(users(spark, sf_dir), 4294967290, 32).select("pos", "v")


@_query("SELECT event_id AS pos, CAST(CAST(user_id AS HUGEINT) + 18446744073709551000 - CASE WHEN user_id >= 616 THEN 18446744073709551616 ELSE 0 END AS DECIMAL(20, 0)) AS v FROM events")
def add_const_wrapping_u64(spark, sf_dir):
    """Unsigned 64-bit sums, as decimals."""
    wrapped = X.add_constant_wrapping(users(spark, sf_dir), 18446744073709551000, 64)
    return wrapped.select("pos", unsigned("v").alias("v"))


@_query("SELECT event_id AS pos, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_id >> 8) AS v, min(epoch_us(ts)) OVER (PARTITION BY event_id >> 8) AS base FROM events")
def delta_from_min(spark, sf_dir):
    return X.delta_from_least(times(spark, sf_dir)).select("pos", "v", "base")


@_query("SELECT event_id AS pos, epoch_us(ts) AS v FROM events")
def delta_from_min_roundtrip(spark, sf_dir):
    return X.undo_delta_from_least(X.delta_from_least(times(spark, sf_dir))).select("pos", "v")


@_query(f"SELECT pos, greatest(v - coalesce(lag(v) OVER (ORDER BY pos), 0), 0) AS v FROM ({_USERS})")
def delta_successive(spark, sf_dir):
    return X.successive_delta(users(spark, sf_dir)).select("pos", "v")


@_query("SELECT event_id AS pos, epoch_us(ts) AS v FROM events")
def delta_roundtrip(spark, sf_dir):
    return X.running_sum(X.successive_delta(times(spark, sf_dir))).select("pos", "v")


@_query(f"SELECT pos, CAST(sum(v) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM ({_USERS})")
def running_sum(spark, sf_dir):
    return X.running_sum(users(spark, sf_dir)).select("pos", "v")


@_query(f"SELECT pos, xor(v, coalesce(lag(v) OVER (ORDER BY pos), 0)) AS v FROM ({_VALUE_BITS})")
def xor_f64_encode(spark, sf_dir):
    return X.xor_previous(value_bits(spark, sf_dir)).select("pos", "v")


@_query(_VALUE_BITS)
def xor_f64_roundtrip(spark, sf_dir):
    return X.running_xor(X.xor_previous(value_bits(spark, sf_dir))).select("pos", "v")


@_query(f"SELECT pos, xor(v, coalesce(lag(v, 8) OVER (PARTITION BY pos >> 8 ORDER BY pos), 0)) AS v FROM ({_F32_BITS})")
def xor_f32_octet(spark, sf_dir):
    df = floats(spark, sf_dir)
    return X.xor_octets(df.withColumn("v", bits.float_bits(F.col("v")))).select("pos", "v")


@_query(_F32_BITS)
def xor_f32_roundtrip(spark, sf_dir):
    df = floats(spark, sf_dir)
    return X.undo_xor_octets(X.xor_octets(df.withColumn("v", bits.float_bits(F.col("v"))))).select("pos", "v")


@_query(f"SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS pos, CAST(l_linenumber AS BIGINT) AS v FROM lineitem")
def widen_u32(spark, sf_dir):
    return X.widen(lines(spark, sf_dir)).select("pos", "v")


@_query(f"SELECT pos, pos >> 8 AS sect, pos >> 3 AS oct, pos & 7 AS lane FROM ({_USERS})")
def positions_model(spark, sf_dir):
    return users(spark, sf_dir).select("pos", section().alias("sect"), octet().alias("oct"), lane().alias("lane"))


# Histograms

_BOUNDS = H.bounds(2.0, 2.0, 12)


def _histograms(spark, sf_dir):
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    return H.complete(H.bucketed(_read(spark, sf_dir, "events"), F.col("event_type"), day, F.col("value"), _BOUNDS), 12)


_BUCKET = " + ".join(f"CAST(value > {b} AS INTEGER)" for b in _BOUNDS[:-1])
_HIST = f"""h0 AS (SELECT event_type AS series, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS ts, {_BUCKET} AS bucket, count(*) AS n FROM events GROUP BY 1, 2, 3),
h AS (SELECT g.series, g.ts, CAST(b AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT series, ts FROM h0) g CROSS JOIN (SELECT unnest(range(0, 12)) AS b) LEFT JOIN h0 ON h0.series = g.series AND h0.ts = g.ts AND h0.bucket = b)"""
_CUM = f"{_HIST}, c AS (SELECT series, ts, bucket, CAST(sum(n) OVER (PARTITION BY series, ts ORDER BY bucket) AS BIGINT) AS n FROM h)"
_PREV = f"{_CUM}, p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY series, bucket ORDER BY ts), 0) AS before FROM c)"


@_query(f"WITH {_HIST} SELECT * FROM h")
def hist_buckets(spark, sf_dir):
    return _histograms(spark, sf_dir)


@_query(f"WITH {_CUM} SELECT * FROM c")
def hist_cumulative(spark, sf_dir):
    return H.cumulative(_histograms(spark, sf_dir))


@_query(f"WITH {_HIST} SELECT * FROM h")
def hist_deltas(spark, sf_dir):
    return H.bucket_deltas(H.cumulative(_histograms(spark, sf_dir)))


@_query(f"WITH {_PREV} SELECT series, ts, bucket, CASE WHEN n < before THEN n ELSE n - before END AS n FROM p")
def hist_2d_diff(spark, sf_dir):
    return H.time_diff(H.cumulative(_histograms(spark, sf_dir)))


@_query(f"WITH {_PREV} SELECT series, ts, bool_or(n < before) AS value_dropped FROM p GROUP BY 1, 2")
def hist_resets(spark, sf_dir):
    return H.resets(H.cumulative(_histograms(spark, sf_dir)))


@_query(f"WITH {_HIST} SELECT series, ts, CAST(2 AS DOUBLE) AS initial, CAST(2 AS DOUBLE) AS multiplier, list(n ORDER BY bucket) AS buckets FROM h GROUP BY 1, 2")
def hist_packed(spark, sf_dir):
    return H.packed(_histograms(spark, sf_dir), 2.0, 2.0).select("series", "ts", "histogram.*")


@_query(f"WITH {_CUM}, c1 AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS line, ts FROM (SELECT DISTINCT ts FROM c WHERE series = 'click')) SELECT line AS ts, bucket, n FROM c JOIN c1 USING (ts) WHERE series = 'click'")
def csv_source(spark, sf_dir):
    """One series of cumulative histograms written as text, one line each, and read again."""
    one = _arrays(H.cumulative(_histograms(spark, sf_dir))).where("series = 'click'")
    path = scratch_path(spark, "csv")
    one.orderBy("ts").select(F.array_join("n", ",").alias("value")).write.text(path)
    return S.csv_histograms(spark, path).select("ts", "bucket", "n")


@_query(f"WITH {_PREV} SELECT series, ts, list(CASE WHEN n < before THEN n ELSE n - before END ORDER BY bucket) AS n, bool_or(n < before) AS value_dropped FROM p GROUP BY 1, 2")
def hist_stream_diff(spark, sf_dir):
    """The time difference over a stream of all snapshots, taken up in one trigger and written by a stream."""
    rows = saved(_arrays(H.cumulative(_histograms(spark, sf_dir))), "snapshots")
    stream = spark.readStream.schema(rows.schema).parquet(rows._scratch_path)
    out = scratch_path(spark, "diffs")
    diff = stream_time_diff(stream)
    query = diff.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(diff.schema).parquet(out)


def _arrays(histograms):
    """series, ts, n: counts by bucket."""
    return H.packed(histograms, 2.0, 2.0).select("series", "ts", F.col("histogram.buckets").alias("n"))


# Storage and the byte codec


@_query(_USERS)
def save_and_open(spark, sf_dir):
    path = scratch_path(spark, "vector")
    S.save_vector(whole(users(spark, sf_dir)), path)
    return S.open_vector(spark, path, "bigint").select("pos", "v")


@_query(f"{_OCTETS} SELECT sect, bytes FROM zb WHERE vec = 'times'")
def codec_section_bytes(spark, sf_dir):
    """What sections take when they are encoded; the advisor's sizes."""
    return C.encode_sections(times(spark, sf_dir), "u64").select("sect", F.octet_length("encoded").cast("bigint").alias("bytes"))


@_query("SELECT event_id AS pos, epoch_us(ts) AS v FROM events")
def codec_sections(spark, sf_dir):
    return C.decode_sections(C.encode_sections(times(spark, sf_dir), "u64"), "u64").select("pos", "v")


@_query(f"{_F32_SIZES} SELECT sect, bytes FROM zb")
def codec_float_section_bytes(spark, sf_dir):
    return C.encode_sections(floats(spark, sf_dir), "f32").select("sect", F.octet_length("encoded").cast("bigint").alias("bytes"))


@_query(_FLOATS)
def codec_float_sections(spark, sf_dir):
    return C.decode_sections(C.encode_sections(floats(spark, sf_dir), "f32"), "f32").select("pos", "v")


@_query("SELECT event_id AS pos FROM events WHERE user_id IN (3, 5)")
def codec_matches(spark, sf_dir):
    return C.match_sections(C.encode_sections(users(spark, sf_dir), "u64"), "u64", [3, 5]).select("pos")


@_query(f"""WITH o AS (SELECT pos >> 8 AS sect, pos >> 3 AS oct, bit_or(v) AS ob, count(*) FILTER (v <> 0) AS nz FROM ({_USERS}) GROUP BY 1, 2),
z AS (SELECT sect, sum(CASE WHEN nz = 0 THEN 1 ELSE 2 + ceil(nz * ((length(bin(ob)) + 3) // 4 - bit_count((ob & -ob) - 1) // 4) / 2.0) END) AS bytes FROM o GROUP BY 1)
SELECT sect, CAST(bytes AS BIGINT) AS bytes, list(v ORDER BY pos) AS unpacked FROM z JOIN ({_USERS}) ON sect = pos >> 8 GROUP BY 1, 2""")
def codec_stream(spark, sf_dir):
    return _stream(X.section_arrays(users(spark, sf_dir)), "plain").select("sect", F.octet_length("packed").cast("bigint").alias("bytes"), "unpacked")


@_query("SELECT event_id >> 8 AS sect, list(epoch_us(ts) ORDER BY event_id) AS unpacked FROM events GROUP BY 1")
def codec_delta_stream(spark, sf_dir):
    return _stream(X.section_arrays(times(spark, sf_dir)), "delta").select("sect", "unpacked")


@_query("SELECT event_id >> 8 AS sect, list(value ORDER BY event_id) AS unpacked FROM events GROUP BY 1")
def codec_double_stream(spark, sf_dir):
    df = S.vector(_read(spark, sf_dir, "events"), "event_id", "value")
    return _stream(X.section_arrays(df), "double").select("sect", "unpacked")


def _stream(arrays, form):
    packed = C.pack_streams(arrays.withColumn("n", F.size("values")), "values", form)
    return C.unpack_streams(packed, "packed", "n", form)


@_query(f"WITH {_CUM} SELECT series, ts, CAST(2 AS DOUBLE) AS initial, CAST(2 AS DOUBLE) AS multiplier, list(n ORDER BY bucket) AS counts FROM c GROUP BY 1, 2")
def codec_histograms(spark, sf_dir):
    """Histograms as bytes and back; readers get cumulative counts."""
    return C.unpack_histograms(C.pack_histograms(H.packed(_histograms(spark, sf_dir), 2.0, 2.0))).select("series", "ts", "initial", "multiplier", "counts")


@_query(f"SELECT pos // 100 AS part, list(v ORDER BY pos) AS \"values\" FROM ({_USERS}) GROUP BY 1")
def codec_chunks(spark, sf_dir):
    """Parts of 100 elements through sections of variable size, one list of sections for each 1,024 positions' parts."""
    return C.chunk_round_trip(users(spark, sf_dir), 100, 16).select("part", "values")
