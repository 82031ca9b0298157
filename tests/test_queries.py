"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidewake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    cell = lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) else str(x)
    return sorted(str([cell(v) for v in row]) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())


def test_plain_range_has_no_python_and_is_pushed_down(spark):
    plan = QUERIES["range_sum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "props" not in plan
