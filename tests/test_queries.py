"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from loomery import catalog

SF = "/root/testdata/sf0.001"


def _shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(_shown, row)) for row in frame.select(*columns).collect())
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_shown(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["w1", "w2", "c11", "df", "c1", "c2", "llr", "level"]


def test_flagship_plan_stays_in_the_jvm_and_prunes_columns(spark):
    plan = __spark_entry__.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "lang:string" not in plan and "source:string" not in plan


def test_greedy_selection_passes_over_what_does_not_fit(spark):
    from loomery.operators import tools

    member = "struct<name:string,score:double,tokens:int>"
    rows = [
        ("r", "big", 0.9, 100, [("big", 0.9, 90), ("dep", 0.1, 30)]), ("r", "mid", 0.8, 100, [("mid", 0.8, 60)]),
        ("r", "bad", 0.7, 100, [("bad", 0.7, 5), ("off", -5000.0, 5)]), ("r", "low", 0.6, 100, [("low", 0.6, 40), ("mid", 0.8, 60)]),
    ]
    frame = spark.createDataFrame(rows, f"request_id string, name string, score double, token_budget int, members array<{member}>")
    assert {(r["name"], r["tokens"]) for r in tools.select_greedy(frame).collect()} == {("mid", 60), ("low", 40)}
