"""The item store, chat windows, message logs and channels."""

import pytest
from pyspark.sql import functions as F

from loomery.functions import json_paths
from loomery.operators import chat, state, store

ITEMS = "namespace array<string>, key string, value string, created_at timestamp, updated_at timestamp, expires_at timestamp, ttl_minutes double"


def _items(spark, rows):
    return spark.createDataFrame([(ns, k, v, None, None, None, None) for ns, k, v in rows], ITEMS)


@pytest.fixture(scope="module")
def docs(spark):
    return _items(spark, [
        (["t"], "doc1", '{"text":"red apple","color":"red","score":4.5}'), (["t"], "doc2", '{"text":"red car","color":"red","score":3.0}'),
        (["t"], "doc3", '{"text":"green apple","color":"green","score":4.0,"a":{"b":1,"l":["x","y"]}}'), (["t"], "doc4", '{"text":"blue car","color":"blue","score":3.5}'),
    ])


def _keys(rows):
    return sorted(r["key"] for r in rows.collect())


def test_filters(docs):
    find = lambda spec: _keys(docs.where(store.item_filter(spec)))
    assert find({"color": "red"}) == ["doc1", "doc2"]
    assert find({"score": {"$gt": 3.2}}) == ["doc1", "doc3", "doc4"]
    assert find({"score": {"$gte": 4.0}, "color": "green"}) == ["doc3"]
    assert find({"color": {"$ne": "red"}}) == ["doc3", "doc4"]
    assert find({"absent": None}) == ["doc1", "doc2", "doc3", "doc4"] and find({"absent": {"$gt": 1}}) == []
    assert find({"a": {"b": 1}}) == ["doc3"]
    assert _keys(docs.where(store.contains(F.col("value"), {"a": {"l": ["y"]}}))) == ["doc3"]
    with pytest.raises(ValueError):
        store.item_filter({"x') OR 1=1 --": 1})
    with pytest.raises(ValueError):
        store.item_filter({"x": {"$like": 1}})


def test_namespaces(spark):
    names = ["a.b.c", "a.b.d.e", "a.b.d.i", "a.b.f", "a.c.f", "b.a.f", "users.123", "users.456.settings", "admin.users.789", "a.bc", "guests.456.preferences"]
    rows = _items(spark, [(n.split("."), "k", "{}") for n in names])
    listed = lambda **k: sorted(".".join(r["namespace"]) for r in store.list_namespaces(rows, **k).collect())
    assert listed(prefix=("a", "b")) == ["a.b.c", "a.b.d.e", "a.b.d.i", "a.b.f"]
    assert listed(suffix=("f",)) == ["a.b.f", "a.c.f", "b.a.f"]
    assert listed(suffix=("*", "preferences")) == ["guests.456.preferences"]
    assert listed(prefix=("*", "users"), suffix=("*", "settings")) == []
    assert listed(max_depth=2, prefix=("a",)) == ["a.b", "a.bc", "a.c"]
    assert rows.where(store.has_prefix(F.col("namespace"), ("a", "b"))).count() == 4
    for bad in ((), ("a.b",), ("",)):
        with pytest.raises(ValueError):
            store.check_namespace(bad)


def test_upsert_delete_and_expiry(spark):
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp")
    old = _items(spark, [(["n"], "a", "1"), (["n"], "b", "2"), (["n"], "c", "3")]).withColumn("created_at", at(1))
    batch = spark.createDataFrame([(1, ["n"], "a", "x", None), (2, ["n"], "a", "y", 30.0), (3, ["n"], "b", None, None), (4, ["n"], "d", "new", None)], "ord int, namespace array<string>, key string, value string, ttl_minutes double")
    made = store.upsert(old, batch, at(5))
    rows = {r["key"]: r for r in made.collect()}
    assert sorted(rows) == ["a", "c", "d"] and rows["a"]["value"] == "y"
    assert rows["a"]["created_at"].hour == 1 and rows["a"]["updated_at"].hour == 5 and rows["d"]["created_at"].hour == 5
    assert (rows["a"]["expires_at"] - rows["a"]["updated_at"]).seconds == 1800
    assert _keys(store.sweep(made, at(5))) == ["a", "c", "d"] and _keys(store.sweep(made, at(6))) == ["c", "d"]
    read = store.refresh(made, made.where("key in ('a', 'c')"), at(9))
    assert _keys(store.sweep(read, at(9))) == ["a", "c", "d"]


def test_vector_search_pools_before_the_limit_and_fills(spark, docs):
    many = [(["t"], "doc1", str(i), [1.0, 0.0]) for i in range(5)] + [(["t"], "doc2", "", [0.0, 1.0]), (["t"], "doc3", "", [0.0, 0.0])]
    vec = spark.createDataFrame(many, "namespace array<string>, key string, path string, embedding array<float>")
    got = [(r["key"], r["score"]) for r in store.vector_search(docs, vec, [1.0, 0.5], limit=4).collect()]
    assert [k for k, _ in got] == ["doc1", "doc2", "doc3", "doc4"] and got[2][1] == 0.0 and got[3][1] is None
    nearest = [r["key"] for r in store.vector_search(docs, vec, [0.0, 1.0], kind="l2", limit=1).collect()]
    assert nearest == ["doc2"]


def test_windows(spark):
    roles = ["user", "assistant", "tool", "user", "assistant", "user", "assistant"]
    turns = spark.createDataFrame([(1, i, r, f"m{i}", 10) for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string, tokens int")
    order = lambda rows: sorted(r["turn"] for r in rows.collect())
    assert order(chat.evict_until(turns, F.lit(25))) == [3, 4, 5, 6]
    assert order(chat.keep_last(turns, 2)) == [5, 6]
    assert order(chat.recent_until(turns, 2)) == [4, 5, 6]
    assert {r["turn"] for r in chat.split_input(turns).where("part = 'input'").collect()} == {5}


def test_message_logs(spark):
    def left(*ops):
        rows = [("t", i, *op) for i, op in enumerate(ops)]
        log = spark.createDataFrame(rows, "thread_id string, ord int, op string, id string, content string")
        return [(r["id"], r["content"]) for r in chat.fold_messages(log).orderBy("place").collect()]

    add, gone = lambda i, c: ("add", i, c), lambda i: ("remove", i, None)
    assert left(add("1", "Hello"), add("2", "Hi"), add("3", "Sys")) == [("1", "Hello"), ("2", "Hi"), ("3", "Sys")]
    assert left(add("1", "Hello"), add("2", "x"), add("1", "Hello again")) == [("1", "Hello again"), ("2", "x")]
    assert left(add("1", "a"), gone("1"), add("1", "b"), add("1", "c")) == [("1", "c")]
    assert left(add("1", "a"), add("2", "b"), gone("2"), gone("2")) == [("1", "a")]
    assert left(add("1", "a"), ("remove_all", "", None), add("2", "b")) == [("2", "b")]
    with pytest.raises(Exception, match="no message to remove"):
        left(add("1", "a"), gone("9"))


def test_channels(spark):
    writes = spark.createDataFrame([(1, "c", 1, 1), (1, "c", 2, 2), (1, "c", 3, 3), (2, "c", 4, 4)], "step int, channel string, ord int, value int")
    assert state.fold(writes, F.lit(0), lambda a, x: a + x).first()["value"] == 10
    with pytest.raises(Exception, match="one write a step"):
        state.last_value(writes).collect()
    assert state.last_value(writes.where("ord >= 3")).count() == 2
    lists = spark.createDataFrame([(1, "t", 1, ["a", "b"]), (2, "t", 2, ["c", "d"]), (2, "t", 3, ["d"])], "step int, channel string, ord int, value array<string>")
    assert {r["step"]: r["values"] for r in state.topic(lists).collect()} == {1: ["a", "b"], 2: ["c", "d", "d"]}
    assert {r["step"]: r["values"] for r in state.topic(lists, accumulate=True).collect()}[2] == ["a", "b", "c", "d", "d"]


def test_checkpoints(spark):
    rows = [("thread-1", "", "1", "input", 2), ("thread-2", "", "2", "loop", 1), ("thread-2", "inner", "3", None, None)]
    table = spark.createDataFrame(rows, "thread_id string, checkpoint_ns string, checkpoint_id string, source string, step int")
    assert state.history(table, condition=F.col("source") == "input").count() == 1
    assert state.history(table).count() == 3 and state.history(table, before="3").count() == 2
    assert {r["checkpoint_ns"] for r in state.history(table, thread="thread-2").collect()} == {"", "inner"}
    key = "thread_id string, checkpoint_ns string, checkpoint_id string, task_id string, idx int, value string"
    one = spark.createDataFrame([("t", "", "1", "a", 0, "old"), ("t", "", "1", "a", -1, "old")], key)
    two = spark.createDataFrame([("t", "", "1", "a", 0, "new"), ("t", "", "1", "a", -1, "new"), ("t", "", "1", "a", 1, "new")], key)
    assert {r["idx"]: r["value"] for r in state.put_writes(one, two).collect()} == {0: "old", -1: "new", 1: "new"}


def test_supersteps(spark):
    start = {"n": spark.createDataFrame([(1,)], "n int")}

    def plan(step, now):
        return [lambda s: {"n": s["n"].select((F.col("n") * 2).alias("n"))}] if now["n"].first()["n"] < 8 else []

    made, why = state.run_supersteps(start, plan)
    assert made["n"].first()["n"] == 8 and why == "done"
    assert state.run_supersteps(start, plan, limit=1)[1] == "out_of_steps"


# Documents, paths and channel writes whose results must equal the source system's.
VALUE = {"name": "test", "info": {"age": 25, "tags": ["a", "b", "c"], "metadata": {"created": "2024-01-01", "updated": "2024-01-02"}}, "items": [{"id": 1, "value": "first", "tags": ["x", "y"]}, {"id": 2, "value": "second", "tags": ["y", "z"]}, {"id": 3, "value": "third", "tags": ["z", "w"]}], "empty": None, "zeros": [0, 0.0, "0"], "empty_list": [], "empty_dict": {}}


@pytest.mark.parametrize("path, want", [
    ("name", ["test"]), ("info.age", ["25"]), ("info.metadata.created", ["2024-01-01"]), ("items[0].value", ["first"]), ("items[-1].value", ["third"]),
    ("items[1].tags[0]", ["y"]), ("items[*].value", ["first", "second", "third"]), ("info.metadata.*", ["2024-01-01", "2024-01-02"]), ("{name,info.age}", ["test", "25"]),
    ("items[*].{id,value}", ["1", "first", "2", "second", "3", "third"]), ("items[*].tags[*]", ["x", "y", "y", "z", "z", "w"]), ("nonexistent", []), ("items[99].value", []),
    ("items[].value", []), ("items[abc].value", []), ("{unclosed", []), ("empty", []), ("empty_list", ["[]"]), ("empty_dict", ["{}"]), ("zeros[*]", ["0", "0.0", "0"]),
])
def test_json_paths(path, want):
    assert json_paths.texts_at(VALUE, path) == want


def test_loose_json(spark):
    assert json_paths.first_object('so {bad} then ```json\n{"a": [1, "}"]}\n``` end') == '{"a": [1, "}"]}'
    rows = spark.createDataFrame([('{"a":[1,2]}',), ("no",), (None,)], "v string")
    assert [r["x"] for r in rows.select(json_paths.at_path(F.col("v"), "a[*]").alias("x")).collect()] == [["1", "2"], [], []]
