"""Chat formatting: collapse logged snapshots of growing conversations, then render those that are left.

A logged conversation that is a prefix of a longer one adds nothing. Each turn gets a hash of its place, role and
text; the hash of a prefix is the running sum of its turns' hashes (four sums of 32-bit lanes, of two independently
seeded 64-bit hashes), so prefixes of one length can be compared by equality. Conversations whose whole hash is a
proper-prefix hash of another are anti-joined away; of equal conversations the one with the smallest id stays.

Each prefix has its length and two 64-bit hashes by which it is compared; that two unlike ones agree by chance has a
probability of about 2**-128.

Skew: turns are sorted by conversation and turn over ranges and written once; a turn's place is its place in its range
moved by the ranges before, so that one huge conversation, or one turn number or null that many rows have, is spread over
tasks. Prefix sums go in two levels: inside a chunk of CHUNK consecutive places, then over the chunks' totals. Equal
first turns, common prefixes and copies meet in grouped minimums only, which combine before the shuffle.

Rows: turns with a null conv_id are dropped, since they belong to no conversation; exactly repeated rows count once;
turns are ordered by turn (null first), then role, then text; a null role renders as 'unknown', a null text as ''
(but null and '' hash alike, so such conversations are equal). Very long texts are kept whole. An empty table gives an
empty result. Extra columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

#: Turns of a conversation that one chunk, and one row of the result, holds.
CHUNK = 1024
LANES = ("h0", "h1", "h2", "h3")


def _lanes(*cols: Column) -> list[Column]:
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
    low = F.lit(0xFFFFFFFF).cast("bigint")
    return [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, chunk, n_turns."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = saved(sorted_.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("id")), "sorted")
    part = F.shiftright("id", 33).alias("part")
    parts = rows.groupBy("conv_id", part).agg(F.min("id").alias("first"), F.count("*").alias("size"))
    by_part = W.partitionBy("conv_id").orderBy("part")
    before = F.coalesce(F.sum("size").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", "first", before.alias("offset"), F.sum("size").over(W.partitionBy("conv_id")).alias("n_turns"))
    place = F.col("offset") + F.col("id") - F.col("first") + 1
    rows = rows.withColumn("part", part).join(parts, ["conv_id", "part"]).withColumn("place", place)
    return rows.select("conv_id", "place", "role", "text", F.floor((F.col("place") - 1) / CHUNK).cast("bigint").alias("chunk"), "n_turns")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, place (from 1), role, text, n_turns, h0..h3: the running hashes up to each turn, t0..t3: the whole's."""
    rows = placed_turns(turns)
    by_chunk = W.partitionBy("conv_id").orderBy("chunk")
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    rows = rows.select("*", *(c.alias(k) for k, c in zip(LANES, _lanes(F.col("place"), F.col("role"), F.col("text")))))
    running = W.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "chunk", "place", "role", "text", "n_turns", *(F.sum(k).over(running).alias(k) for k in LANES))
    ends = rows.groupBy("conv_id", "chunk").agg(*(F.max_by(k, "place").alias(k) for k in LANES))
    ends = ends.select("conv_id", "chunk", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"b{k}") for k in LANES), *(F.sum(k).over(whole).alias(f"t{k}") for k in LANES))
    return rows.join(ends, ["conv_id", "chunk"]).select(
        "conv_id", "chunk", "place", "role", "text", "n_turns", *((F.col(k) + F.col(f"b{k}")).alias(k) for k in LANES), *(F.col(f"t{k}").alias(f"t{k}") for k in LANES)
    )


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations to keep, from prefix_hashes."""
    full = hashed.where(F.col("place") == F.col("n_turns")).groupBy("n_turns", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashed.where(F.col("place") < F.col("n_turns")).select(F.col("place").alias("n_turns"), *LANES).distinct()
    return full.join(proper, ["n_turns", *LANES], "left_anti").select("conv_id", "n_turns", "n_copies")


def render_turns(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, place, segment of the kept conversations; a conversation's text is its segments in order."""
    segment = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return hashed.join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", "chunk", "place", segment.alias("segment"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: one row per kept conversation and CHUNK turns of it.

    A conversation of up to CHUNK turns, whatever their numbers, is one row of part 0; a longer one comes in consecutive
    parts, so that no row and no task ever holds an unbounded conversation."""
    hashed = saved(prefix_hashes(turns), "turns")
    kept = maximal_conversations(hashed)
    parts = render_turns(hashed, kept).groupBy("conv_id", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "segment"))), lambda x: x["segment"]), "").alias("rendered")
    )
    return parts.join(kept, "conv_id").select("conv_id", F.col("chunk").alias("part"), "n_turns", "n_copies", "rendered")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn NULLS FIRST, role, text) AS l,
             list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS segments FROM t GROUP BY conv_id),
u AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, min(segments) AS segments FROM c GROUP BY l),
kept AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l)),
p AS (SELECT *, unnest(range(0, (len(l) - 1) // {CHUNK} + 1)) AS part FROM kept)
SELECT conv_id, part, CAST(len(l) AS BIGINT) AS n_turns, n_copies, array_to_string(segments[part * {CHUNK} + 1:part * {CHUNK} + {CHUNK}], '') AS rendered FROM p
"""
