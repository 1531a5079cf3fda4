"""Each query against its SQL twin, on the smallest tables."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def value(v):
    if v is pd.NA:
        return None
    if isinstance(v, float):
        # Whole numbers with nulls among them come as floats from one side and as nullable integers from the other.
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 8)
    if hasattr(v, "tolist") and not isinstance(v, str | bytes):
        return value(v.tolist())
    if isinstance(v, list | tuple):
        return tuple(value(x) for x in v)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(entry.plans.QUERIES) & set(entry.oracle.SQL)))
def test_query_equals_sql(spark, duck, name):
    got = entry.plans.QUERIES[name](spark, SF).toPandas()
    wanted = duck.execute(entry.oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(entry.plans.QUERIES) - set(entry.oracle.SQL)))
def test_query_without_sql_has_rows_and_repeats_itself(spark, name):
    first, again = (rows(entry.plans.QUERIES[name](spark, SF).toPandas()) for _ in range(2))
    assert first and first == again


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
