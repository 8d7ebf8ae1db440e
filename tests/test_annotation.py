"""Tools, ids, registries, lexicon sources, loops and parser backends on small inputs."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import collocations as c
from loomery.operators import dataflow, entities, knowledge, parsing, store
from loomery.registry import Registry
from loomery.sources import files


def test_tool_calls_fail_one_by_one(spark):
    calls = spark.createDataFrame([(1, "up", "a"), (2, "none", "b"), (3, "number", "x"), (4, "up", "c")], "call_id int, name string, input string")
    got = {r["call_id"]: (r["output"], r["status"]) for r in dataflow.call_tools(calls, {"up": str.upper, "number": int}).collect()}
    assert got[1] == ("A", "success") and got[4] == ("C", "success")
    assert got[2][1] == got[3][1] == "error" and "none" in got[2][0] and got[3][0].startswith("ValueError")
    assert dataflow.call_tools(calls.where("false"), {}).count() == 0


def test_own_reads_keep_ephemeral_values_and_hide_other_tasks(spark):
    state = spark.createDataFrame([(1, "n", 5, 1), (1, "e", 7, 1)], "thread int, channel string, value int, version int")
    writes = spark.createDataFrame([(1, "a", 0, "n", 2), (1, "b", 1, "e", 9)], "thread int, node string, path int, channel string, value int")
    got = {(r["node"], r["channel"]): r["value"] for r in dataflow.local_reads(state, writes, writes, {"n": "sum", "e": "ephemeral"}).collect()}
    assert got == {("a", "n"): 7, ("a", "e"): 7, ("b", "n"): 5, ("b", "e"): 9}


def test_commands_without_anything_write_nothing(spark):
    schema = "thread int, goto array<string>, resume string, update map<string,string>"
    rows = spark.createDataFrame([(1, ["x"], None, None), (2, None, "yes", {"k": "v"}), (3, None, None, None), (4, [], None, {})], schema)
    got = [tuple(r) for r in dataflow.command_writes(rows).orderBy("thread", "path").collect()]
    assert got == [(1, 0, "branch:to:x", "__start__"), (2, 0, "__resume__", "yes"), (2, 1, "k", "v")]


def test_ids_equal_the_standard_library_and_sort_by_time(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("é/1", 1_704_067_200_000_000, 5), ("", 1_704_067_200_000_001, 16383)], "name string, us long, seq int")
    made = rows.select("name", text.name_id(str(uuid.NAMESPACE_DNS), F.col("name")).alias("n"), text.time_id(F.col("us"), F.col("seq"), F.lit(77)).alias("t"))
    got = made.collect()
    assert [r["n"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, r["name"])) for r in got]
    ids = [uuid.UUID(r["t"]) for r in got]
    assert [i.version for i in ids] == [6, 6, 6] and sorted(ids) == ids
    for i, r in zip(ids, rows.collect()):
        ticks = (i.time_low << 28) | (i.time_mid << 12) | (i.time_hi_version & 0xFFF)
        assert ticks == r["us"] * 10 + 0x01B21DD213814000
        assert i.node == 77 and i.clock_seq == r["seq"]


def test_templates_are_filled(spark):
    got = spark.createDataFrame([("x", None)], "a string, b string").select(text.filled("{a}-{b}-{a}-{c}", a=F.col("a"), b=F.col("b")).alias("t")).first()
    assert got["t"] == "x--x-{c}"


def test_word_offsets_are_those_of_the_text(spark):
    texts = {1: "Don't go, émile!", 2: "", 3: None, 4: "  x"}
    rows = c.word_offsets(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["word"]) for r in rows] == [(1, "Don't"), (1, "go"), (1, "mile"), (4, "x")]
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["word"] for r in rows)


def test_registry():
    known = Registry("step")
    known.register("one")(lambda x: x + 1)
    known.register("ten")(lambda x: x * 10)
    assert known.resolve("one")(1) == 2 and known.resolve("one", "ten")(1) == 20
    assert known.resolve_scheme("ten://place")(3) == 30
    with pytest.raises(ValueError):
        known.register("one")(abs)
    known.register("one", replace=True)(abs)
    assert known.resolve("one")(-4) == 4
    for names in (("none",), ()):
        with pytest.raises(KeyError):
            known.resolve(*names)


def test_lexicon_bundles_and_lists(spark, tmp_path, monkeypatch):
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "frames.json").write_text('{"frame": "Making", "definition": "to make"}\n')
    (tmp_path / "lex" / "units.json").write_text('{"lemma": "make", "pos": "v", "frame": "Making"}\n{"lemma": "run", "pos": "v", "frame": "Gone"}\n')
    for name in ("elements", "relations"):
        (tmp_path / "lex" / f"{name}.json").write_text("")
    lex = files.lexicon(spark, str(tmp_path / "lex"))
    assert lex["relations"].count() == 0
    assert [r["frame"] for r in files.dangling(lex["units"], "frame", lex["frames"], "frame").collect()] == ["Gone"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"entities": [{"id": "e1"}], "frames": []}')
    schemas = {"entities": "struct<id:string>", "frames": "struct<id:string>"}
    assert files.bundle(spark, str(tmp_path / "b"), schemas, ("entities",))["entities"].count() == 1
    with pytest.raises(ValueError):
        files.bundle(spark, str(tmp_path / "b"), schemas, ("frames",))
    (tmp_path / "stop").write_text("the\nof\n")
    monkeypatch.setenv("LOOMERY_STOPWORDS", str(tmp_path / "stop"))
    assert {r["term"] for r in files.stopwords(spark, built_in=("a", "the")).collect()} == {"a", "the", "of"}


def test_workspace_leaves_ignored_folders_out(spark, tmp_path):
    for name in ("a/x.py", "a/y.txt", "node/x.py", "b/c/z.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = files.workspace(spark, str(tmp_path), (".py",), ("node",)).collect()
    assert [r["path"].rsplit("/", 2)[1:] for r in got] == [["a", "x.py"], ["c", "z.py"]] and got[0]["length"] == 5
    assert files.workspace(spark, str(tmp_path), (".py",), limit=2).count() == 2


def test_closed_loop_ends(spark):
    wanted = spark.range(5)
    for supply, most, outcome in ((5, 3, ("resolved", 2)), (3, 9, ("exhausted", 1)), (5, 1, ("capped", 1))):
        known = [0]
        done = knowledge.closed_loop(
            lambda: spark.createDataFrame([(x,) for x in known], "id long"),
            lambda have: wanted.join(have, "id", "left_anti"),
            lambda gaps: gaps.where(F.col("id") < supply).orderBy("id").limit(2),
            lambda new: known.extend(r["id"] for r in new.collect()),
            most,
        )
        assert done == outcome


def test_a_backend_that_fails_gives_way_to_the_rules(spark):
    rows = [(1, 0, i, w) for i, w in enumerate(["the", "dog", "quickly", "walked", "in", "parks"])]
    tagged = parsing.tagged(spark.createDataFrame(rows, "doc_id int, sent_id int, idx int, word string"))
    rules = {tuple(r) for r in parsing.parsed_by(tagged).collect()}
    assert rules and {tuple(r) for r in parsing.parsed_by(tagged, lambda t: 1 / 0).collect()} == rules
    assert parsing.parsed_by(tagged, lambda t: parsing.dependency_edges(t).where("rel = 'obj'")).select("rel").distinct().count() <= 1


def test_two_stages_see_only_the_best_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.7), ("b", 4, 0.6), ("c", 5, 0.5)], "item string, path int, score double")
    assert [r["item"] for r in store.two_stage_limit(rows, 1, 1).collect()] == ["a"]
    assert [r["item"] for r in store.two_stage_limit(rows, 2, 1).collect()] == ["a", "b"]


def test_rules_are_parsed_by_their_whole_element(spark):
    rules = spark.createDataFrame([("f.a.candidate_paths.0", "x"), ("f.ab.candidate_paths.1", "y"), ("f.a.qualia", "z"), ("f", "w"), (None, "v")], "key string, path string")
    got = {tuple(r) for r in entities.parsed_rules(rules, "candidate_paths").collect()}
    assert got == {("f", "a", "x"), ("f", "ab", "y")}
