"""Every SQL-expressible query against its DuckDB oracle (sf0.001: fast, same code path as
the driver's sf0.01 check)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

CORPUS = E._llm_queries()  # tested in their own folder
SQL = {k: v for k, v in E.oracle_sql().items() if k not in CORPUS}
TABLES = ("supplier", "part", "orders", "lineitem")


def norm(v):
    if v is None or type(v).__name__ == "NaTType":
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return (3, s[:-9] if s.endswith("T00:00:00") else s)
    return (4, str(v))


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(x.item() if hasattr(x, "item") else x) for x in r)
                        for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    assert table(got) == table(want)


def test_every_query_has_an_oracle_or_is_model_based():
    rows_only = set(E.queries()) - set(SQL) - set(CORPUS)
    assert rows_only == {"predict_lead_time", "predict_delay", "model_metrics", "score_orders_model"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["VendorNumber", "VendorName"] and len(df.columns) == 32
