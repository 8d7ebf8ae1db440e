"""Queries that once left a part of their rows out, against SQL or brute force over all rows."""

import glob
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from loomery import catalog
from tests.test_queries import SF, _shown

#: sf0.001 has no user above 39.
WHOLE = {"channel_topic": SF, "predicate_pairs": SF, "trigram_pmi": SF, "ui_message_merge": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_equals_the_sql_over_all_rows(spark, name):
    folder = WHOLE[name]
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = catalog.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    got = frame.select(*columns).collect()
    assert sorted(tuple(map(_shown, r)) for r in got) == sorted(tuple(map(_shown, r)) for r in want)


def _components(orders):
    """The smallest customer that each one is connected with, by orders of one day."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    first = {}
    for customer, day in orders:
        a, b = sorted((top(customer), top(first.setdefault(day, customer))))
        up[b] = a
    return {x: top(x) for x in up}


def test_components_are_of_all_orders(spark, tmp_path):
    r = random.Random(5)
    orders = [(r.randint(1, 300), r.randint(0, 160), r.choice((100.0, 460000.0))) for _ in range(240)]
    day = lambda n: datetime(2020, 1, 1) + timedelta(days=n)
    rows = [(c, day(d), p) for c, d, p in orders]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = _components([(c, d) for c, d, _ in orders])
    assert len(set(want.values())) > 5
    assert {tuple(r) for r in catalog.QUERIES["label_components"](spark, str(tmp_path)).collect()} == set(want.items())
    tables = duckdb.sql(f"SELECT o_custkey, o_orderdate::DATE FROM '{SF}/orders.parquet'").fetchall()
    assert {tuple(r) for r in catalog.QUERIES["label_components"](spark, SF).collect()} == set(_components(tables).items())
