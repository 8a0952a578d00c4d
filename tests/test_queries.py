"""Every registered query of the engine against its SQL in DuckDB, and the plans it must have."""

import math

import duckdb
import pytest

from tessera.queries import HEADLINE, ORACLE_SQL, QUERIES, STATEMENTS, TABLES, client


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == names
    assert got == sorted(tuple(plain(row[at.index(c)]) for c in names) for row in result.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = plan_of(QUERIES["flagship"](spark, data))
    assert "PushedFilters: [IsNotNull(l_discount), LessThan(l_discount,0.05)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string,l_linestatus:string>" in plan


def test_exists_is_a_hash_join_and_top_k_no_sort(spark, data):
    assert "LeftSemi" in plan_of(QUERIES["exists_correlated"](spark, data))
    assert "ExistenceJoin" in plan_of(QUERIES["exists_in_select"](spark, data))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_k"](spark, data))


def test_no_python_on_the_data_path(spark, data):
    for name in STATEMENTS:
        plan = plan_of(QUERIES[name](spark, data))
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow")), name


def test_windows_over_all_rows_do_not_gather_them(spark, data):
    plan = plan_of(client(spark, data, "orders").query("SELECT o_orderkey, COUNT(*) OVER () AS n FROM orders").to_dataframe())
    assert "Window" not in plan


def test_headline_queries_exist():
    assert set(HEADLINE) <= set(QUERIES)
