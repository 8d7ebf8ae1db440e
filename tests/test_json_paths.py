"""Paths read inside the JVM against a walk over Python's trees."""

import json
import random

from pyspark.sql import functions as F

from loomery.functions import json_paths

PATHS = ["", "$", "a", "a.b", "a.b[0]", "a.b[-1]", "a.b[*]", "a.*", "*", "[*]", "[1]", "[-5]", "{a,c}", "a.{b,x.y}", "a.b[*].{c,d}", "c d", "it's", "[x]", "a.{b", "*.*", "x.y[*].z"]


def _plain(value):
    """Texts as JSON writes them."""
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    return [json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)]


def _walk(document, path, monkeypatch):
    try:
        value = json.loads(document)
    except (TypeError, ValueError):
        return []
    monkeypatch.setattr(json_paths, "_shown", _plain)
    return [] if value is None else json_paths.texts_at(value, path)


def _made(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.35:
        return r.choice([1, -7, 2.5, "x", "é, y", "", True, False, None])
    if kind < 0.6:
        return [_made(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {k: _made(r, depth + 1) for k in r.sample(["a", "b", "c", "d", "x", "y", "z", "c d", "it's"], r.randint(0, 4))}


def test_texts_equal_a_walk(spark, monkeypatch):
    r = random.Random(9)
    docs = [json.dumps({"a": {"b": _made(r), "x": {"y": _made(r)}}, "c": _made(r), "it's": 1}, ensure_ascii=False, sort_keys=True) for _ in range(60)]
    docs += [json.dumps(_made(r), ensure_ascii=False, sort_keys=True) for _ in range(60)] + ["bad", "{", "", None, "null", "[]", '"s"', "[1, [2, 3]]"]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, d string").withColumn("v", json_paths.parsed(F.col("d")))
    got = rows.select("i", *[json_paths.texts(F.col("v"), p).alias(f"p{n}") for n, p in enumerate(PATHS)]).collect()
    for x in got:
        for n, path in enumerate(PATHS):
            assert (x[f"p{n}"] or []) == _walk(docs[x["i"]], path, monkeypatch), (docs[x["i"]], path)


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([('{"a": [1, 2]}',)], "d string").select(json_paths.texts(json_paths.parsed(F.col("d")), "a[*]").alias("t"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and rows.first()["t"] == ["1", "2"]
