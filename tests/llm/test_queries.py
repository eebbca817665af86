"""The registered queries on the smallest tables: SQL where there is some, shapes elsewhere."""

import os

import duckdb
import pytest

from stratavec.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(c[0] for c in r.description)
    at = [[c[0] for c in r.description].index(c) for c in cols]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(tuple(str(row[c]) for c in cols) for row in df.collect()) == sorted(tuple(str(row[i]) for i in at) for row in r.fetchall())


CONTRACT = {
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    assert CONTRACT[name].items() <= dict(queries.QUERIES[name](spark, SF).dtypes).items()
