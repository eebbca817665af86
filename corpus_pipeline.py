"""The corpus pipeline: documents through toxicity, near duplicates, contamination, secrets and segmentation.

Every stage but the last keeps the columns of documents. A stage works on all rows that its predecessor kept: toxic
documents go, one document of each near-duplicate class stays, documents that hold a benchmark window go, secrets are
replaced in the text, and what is left is segmented into sampled pieces.

All stages: texts are read whole, however long; an empty table gives an empty one; columns beyond those of documents are
handed on, whatever their names, and not read; tables other than documents may be empty too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm import decontaminate, near_dedup, secret_scan, sentence_pieces, toxicity
from stratavec.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model fitted on the labels of sf_dir does not call toxic. Null and empty texts have no features
    and stay; null ids stay; each repeated row stays or goes by its text; without toxic or clean labels all stay. Of an
    id's several labels the largest counts, of its several texts the least."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal or similar texts: that of the smallest doc_id. Null counts as the empty text; rows
    with a null id all stay; of repeated rows one stays; an id whose texts are in several classes keeps one row in
    each of them where it is the smallest."""
    return near_dedup.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs. Null and empty texts stay, as do null ids; repeated rows
    stay or go alike; benchmark rows without words, repeated ones and null ids are allowed."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their text replaced and n_chars counted anew. Null texts stay null; null ids and repeated rows
    stay as they are (repeated rows count as often as they occur in the false-discovery control)."""
    return secret_scan.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, lossless of all rows. A null text has null ids and 0 pieces, an empty one no ids; null ids are a
    key like any other, and rows of equal ids and texts get equal pieces."""
    return sentence_pieces.sample_pieces(docs).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentence_pieces", encode_pieces),
]

#: No stage's decisions can be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
