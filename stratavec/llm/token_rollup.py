"""Token counts as delta-maintained rollups.

A rollup holds additive totals (documents, tokens) by source, language and tokenizer version. It is fed with batches
of changes, each row one of

* insert: +1 document, +n_tokens,
* delete:  -1 document, -n_tokens,
* revise:   0 documents, n_tokens - old_tokens.

A batch is summed to one delta row per key before anything is stored, with partial sums per task, so a source that
holds a third of all rows costs no more than others. A batch commits by a marker that names its delta files. The marker
is written in full under another name and then published by a move that never overwrites, so that it is there as a whole
or not at all: a batch id that has been committed already changes nothing, a job that dies before the move leaves
files that nobody reads and may run again, and of two writers of one batch the first one wins. compact() folds the
committed deltas into a snapshot, so that readers never open more than the deltas since then; it sums the very
markers that it lists as held, and of two compactions of one state the first one wins.

Rows: null source, language or tokenizer are keys like any other; a null text has no tokens, a very long one is counted
whole; a null count is 0; repeated rows count as often as they occur; rows whose op is null or none of the three are no
changes and are left out; an empty batch commits and changes nothing; extra columns are not read, so clashing names do
not matter. Keys whose totals are all zero are left out of totals().
"""

from __future__ import annotations

import base64
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_bytes, map_rows, saved, scratch_path, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY_BYTES = 16_000_000

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class TokenRollup:
    """A rollup under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self) -> list[str]:
        where = self._paths(f"{self.path}/commits")
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(n for n in names if n[0] in "bs")

    def _read_marks(self, names: list[str]) -> dict[str, str]:
        """The contents of markers, by name; one driver row for each."""
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.path}/commits/{n}" for n in names], wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        return {r.name: r.value for r in rows.collect()}

    def _publish(self, mark: str, content: str) -> bool:
        """The marker with its whole content, or False if it is there already."""
        ready, final = f"{self.path}/ready/{uuid.uuid4().hex}", f"{self.path}/commits/{mark}"
        out = self._fs.create(self._paths(ready), False)
        out.write(content.encode())
        out.close()
        self._fs.mkdirs(self._paths(f"{self.path}/commits"))
        try:
            if self._fs.getScheme() == "file":  # a move would overwrite there; a second name for a file does not
                os.link(urlparse(ready).path, urlparse(final).path)
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._paths(final).toUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self._paths(ready), self._paths(final), none)
        except Exception:
            if self._fs.exists(self._paths(final)):
                return False
            raise
        finally:
            self._fs.delete(self._paths(ready), False)
        return True

    @staticmethod
    def _name(batch_id: str) -> str:
        return "b" + batch_id.encode().hex()

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._paths(f"{self.path}/commits/{self._name(batch_id)}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of (op, source, lang, tokenizer, n_tokens, old_tokens); False if it was there already."""
        if self.committed(batch_id):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        tokens = F.when(F.col("op") == "revise", n - old).otherwise(sign * n)
        delta = changes.where(F.col("op").isin("insert", "delete", "revise")).groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(tokens).alias("n_tokens"))
        return self._publish(self._name(batch_id), self._store(delta))

    def _store(self, delta: DataFrame) -> str:
        """The name of newly written rows that nobody reads yet."""
        attempt = uuid.uuid4().hex
        delta.select(*KEYS, F.col("n_docs").cast("bigint").alias("n_docs"), F.col("n_tokens").cast("bigint").alias("n_tokens")).write.parquet(f"{self.path}/deltas/{attempt}")
        return attempt

    def _live(self, marks: list[str]) -> list[str]:
        """What the markers hold: the last snapshot's rows, and those of the batches that it does not hold."""
        snapshots, batches = [m for m in marks if m.startswith("s")], [m for m in marks if m.startswith("b")]
        if not snapshots:
            return list(self._read_marks(batches).values())
        attempt, *held = self._read_marks(snapshots[-1:])[snapshots[-1]].split(",")
        return [attempt, *self._read_marks(sorted(set(batches) - set(held))).values()]

    def compact(self) -> bool:
        """Folds the committed deltas into a snapshot. Batches keep their markers, so they stay idempotent; one that
        commits meanwhile stays a delta. False if another compaction was first."""
        marks = self._marks()
        held = [m for m in marks if m.startswith("b")]
        return self._publish(f"s{len(marks) - len(held):09d}", ",".join([self._store(self._sums(marks)), *held]))

    def totals(self) -> DataFrame:
        return self._sums(self._marks()).where("n_docs <> 0 OR n_tokens <> 0")

    def _sums(self, marks: list[str]) -> DataFrame:
        live = self._live(marks)
        if not live:
            return self.spark.createDataFrame([], _DELTA)
        deltas = self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/deltas/{a}" for a in live))
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, columns: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The named columns of docs, and n_tokens of the whole text, by a rank file read on the driver."""
    with open(tokenizer, "rb") as f:
        raw = f.read()
    shared = broadcast_bytes(docs.sparkSession, raw, len(raw), VOCABULARY_BYTES, "vocabulary")

    def setup():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def each(encoding, *lists):
        for *row, text in zip(*lists):
            yield *row, len(encoding.encode_ordinary(text)) if text else 0

    types = dict(docs.select(*columns).dtypes)
    return map_rows(docs, [*columns, "text"], ", ".join(f"`{c}` {types[c]}" for c in columns) + ", n_tokens bigint", each, setup)


def changes(rows: DataFrame, op: str, tokenizer: str, n_tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens.cast("bigint").alias("n_tokens"),
        (old_tokens if old_tokens is not None else F.lit(None)).cast("bigint").alias("old_tokens"),
    )


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: inserted with an estimated count, revised to the exact count, and every
    exact copy but the one of smallest doc_id deleted. Each batch is sent twice; the second sending changes nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).alias("estimate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    counted = saved(count_tokens(docs, ["doc_id", "source", "lang", "estimate", "hash"]), "tokens")
    version = TOKENIZER.rsplit("/", 1)[-1].split(".")[0]
    first = saved(counted.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("hash", "first_id"), "first")
    copies = counted.join(first, "hash").where(F.col("doc_id") > F.col("first_id"))
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    batches = {
        "load": changes(counted, "insert", version, F.col("estimate")),
        "exact counts": changes(counted, "revise", version, F.col("n_tokens"), F.col("estimate")),
        "copies": changes(copies, "delete", version, F.col("n_tokens")),
    }
    for batch_id, rows in [*batches.items(), *batches.items()]:
        rollup.commit(batch_id, rows)
    return rollup.totals()
