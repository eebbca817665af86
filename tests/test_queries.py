"""Every registered query over the vector operators against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from stratavec.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    r = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in r.description]
    expected = sorted(tuple(norm(row[cols.index(c)]) for c in sorted(cols)) for row in r.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(norm(row[c]) for c in sorted(cols)) for row in df.collect()) == expected


PUSHED = {
    "filter_eq_count_u32": ["EqualTo(l_linenumber,3)"],
    "filter_eq_count_u64": ["EqualTo(user_id,7)"],
    "filter_eq_count_f64": ["EqualTo(l_discount,0.05)"],
    "filter_oneof_count": ["In(user_id, [3,5])"],
    "filter_oneof_positions": ["In(user_id, [3,5])"],
    "filter_eq_positions": ["EqualTo(user_id,3)"],
    "multi_filter_count": ["EqualTo(l_linenumber,3)", "In(l_quantity, [10.0,5.0])"],
    "multi_filter_positions": ["EqualTo(event_type,click)", "In(user_id, [1,2,3,4,5])"],
    "multi_filter_join": ["In(user_id, [1,2,3])", "LessThanOrEqual(o_custkey,500)", "EqualTo(o_orderstatus,F)"],
}


@pytest.mark.parametrize("name", sorted(PUSHED))
def test_filters_reach_the_scan(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().explainString(mode)
    pushed = " ".join(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert all(p in pushed for p in PUSHED[name]), pushed


def test_entry_module_imports(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("rows", [4999, 5000, 5001, 6000])
def test_finish_padded_on_more_suppliers_than_positions(spark, tmp_path, rows):
    keys = f"SELECT (i * 7919) % {rows} AS s_suppkey, CASE WHEN i % 50 > 0 THEN CAST(i % 25 AS INTEGER) END AS s_nationkey FROM range({rows}) t(i)"
    with duckdb.connect() as c:
        c.execute(f"COPY ({keys}) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
        expected = sorted(c.execute(registry.ORACLE_SQL["finish_padded"]).fetchall())
    got = registry.QUERIES["finish_padded"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("pos", "v").collect()) == expected and len(expected) == 5000
