"""Registered queries against their DuckDB twins on the smallest tables."""

import pytest

from strata.llm.queries import ORACLE, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    res = duck.execute(ORACLE[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    assert got == sorted((tuple(r[have.index(c)] for c in cols) for r in res.fetchall()), key=repr)


def test_queries_read_whole_tables(spark):
    """No limit or sample but the classifier's documented sample of labels."""
    for name in ("op1_decontamination", "op2_secret_scan", "op6_rule_ledger", "op8_token_counts", "op9_license_scan"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "Sample" not in plan, name


def test_native_operators_run_no_python(spark):
    for name in ("op2_secret_scan", "op6_rule_ledger", "op9_license_scan"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan, name
