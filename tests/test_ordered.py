"""Folds in order against plain loops: hot channels over many ranges, nulls, repeats, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import ordered

SCHEMA = "channel string, ord long, value long, total string, _n int"


@pytest.fixture(scope="module")
def writes(spark):
    r = random.Random(2)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), i, None if i % 11 == 0 else r.randint(-50, 50)) for i in range(3000)]
    rows += [("none", 5000 + i, None) for i in range(4)]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(*x, "s", 1) for x in rows], SCHEMA).repartition(7)


def _plain(rows):
    out, state = {}, {}
    for c, o, v in sorted(rows, key=lambda x: x[1]):
        s = state.setdefault(c, {"sum": None, "count": 0, "min": None, "max": None, "first": None, "last": None})
        if v is not None:
            s["sum"], s["count"] = (s["sum"] or 0) + v, s["count"] + 1
            s["min"], s["max"] = min(v, v if s["min"] is None else s["min"]), max(v, v if s["max"] is None else s["max"])
            s["first"], s["last"] = v if s["first"] is None else s["first"], v
        out[o] = (c, *s.values())
    return out, {c: tuple(s.values()) for c, s in state.items()}


def test_running_values_equal_a_loop(writes):
    rows, frame = writes
    made = {f"r_{k}": (k, "value") for k in ordered.KINDS}
    each, last = _plain(rows)
    got = ordered.running(frame, made)
    assert got.columns == [*frame.columns, *made]
    assert {r["ord"]: (r["channel"], *(r[n] for n in made)) for r in got.collect()} == each
    assert {r["channel"]: tuple(r[n] for n in made) for r in ordered.reduced(frame, made).collect()} == last
    assert ordered.running(frame.limit(0), made).count() == 0
    with pytest.raises(ValueError):
        ordered.reduced(frame, {"x": ("median", "value")})


def test_no_list_and_no_single_task_holds_a_channel(writes):
    _, frame = writes
    plan = ordered.running(frame, {"t": ("sum", "value")})._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    parts = ordered.cut(frame.repartitionByRange(6, "channel", "ord")).withColumn("p", F.spark_partition_id())
    assert parts.where("channel = 'hot'").select("p").distinct().count() > 2


def test_any_reducer_in_order(writes):
    rows, frame = writes
    step = lambda a, x: a if x is None or x != x else (a * 3 + int(x)) % 1009
    want = {}
    for c, _, v in sorted(rows, key=lambda x: x[1]):
        want[c] = step(want.get(c, 7), v)
    assert {r["channel"]: r["value"] for r in ordered.folded(frame, 7, step, "long").collect()} == want
    assert ordered.folded(frame.limit(0), 7, step, "long").count() == 0


def test_topics_as_rows(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randint(0, 3), i, [r.randint(0, 9) for _ in range(r.randint(0, 3))]) for i in range(300)] + [("a", 1, 900, None)]
    frame = spark.createDataFrame(rows, "channel string, step int, ord long, value array<int>")
    for accumulate in (False, True):
        want, sizes = {}, {}
        for c, s, _, v in sorted(rows, key=lambda x: (x[1], x[2])):
            own = want.setdefault((c,) if accumulate else (c, s), [])
            own += [(s, x) for x in v or []]
            sizes[c, s] = len(own)
        got = {}
        for x in ordered.topic_values(frame, accumulate).collect():
            got.setdefault((x["channel"],) if accumulate else (x["channel"], x["step"]), {})[x["place"]] = (x["step"], x["value"])
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}
        if accumulate:
            assert {(x["channel"], x["step"]): x["n"] for x in ordered.topic_sizes(frame).collect()} == sizes
