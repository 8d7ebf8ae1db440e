"""Sources, sinks, entities and lexicon operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from loomery import sinks
from loomery.operators import entities, knowledge, lexicon, tools
from loomery.sources import files


def test_text_tree_and_lists(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"ok \xff end")
    (tmp_path / "b.0").write_text("zero")
    (tmp_path / "in.txt").write_text("skipped")
    (tmp_path / "c.md").write_text("other")
    got = {r["doc_id"]: (r["source"].rsplit("/", 1)[1], r["text"]) for r in files.text_tree(spark, str(tmp_path)).collect()}
    assert got == {"d001": ("x.txt", "ok � end"), "d002": ("b.0", "zero")}
    (tmp_path / "terms").write_text("one\n\nterm|two|x\nthree|rest\n")
    assert {r["term"] for r in files.term_list(spark, str(tmp_path / "terms")).collect()} == {"one", "two", "three"}


def test_registry_and_vault(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"entities": [{"id": "e1", "type": "Tool"}, {"id": "e2"}]}')
    rows = files.registry(files.json_directory(spark, str(tmp_path)), "entities", "struct<id:string,type:string>")
    assert {(r["id"], r["type"]) for r in rows.collect()} == {("e1", "Tool"), ("e2", None)}
    card = tmp_path / "vault" / "gold" / "labeling"
    card.mkdir(parents=True)
    (card / "k1.md").write_text("body")
    assert [tuple(r) for r in files.vault(spark, str(tmp_path / "vault")).collect()] == [("gold", "labeling", "k1", "body")]
    cards = files.vault(spark, str(tmp_path / "vault"))
    assert knowledge.promote(cards, "k1", "labeling", "gold", "release").first()["stage"] == "release"
    sinks.write_cards(cards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("stage = 'gold'").count() == 1


def test_config_rejects_unknown_keys(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text('{"limit": 5}')
    monkeypatch.setenv("LOOMERY_NAME", "other")
    assert files.load_config(str(path), {"limit": 1, "name": "x"}) == {"limit": 5, "name": "other"}
    with pytest.raises(ValueError):
        files.load_config(str(path), {"name": "x"})


def test_markdown_and_cards(spark):
    rows = spark.createDataFrame([("a|b", 1)], "w string, n int")
    assert sinks.markdown_table(rows, "Pairs", "note") == "## Pairs\n> note\n\n| w | n |\n| :--- | :--- |\n| a\\|b | 1 |"
    card = rows.select(sinks.front_matter(["w"], F.lit("body")).alias("c")).first()["c"]
    assert card == '---\nw: "a|b"\n---\n\nbody'


def test_fragments(spark):
    body = "The method sorts the given list in place. It keeps the order.\n\nclass Foo\n\nuse `a` or `b`\n\nCPython detail here now."
    rows = lexicon.fragments(spark.createDataFrame([(1, body), (2, "")], "doc_id int, text string")).orderBy("doc_id", "ord").collect()
    assert [(r["id"], r["category"], r["value"], r["paragraph"], r["sentence"]) for r in rows] == [
        ("F01", "nl_action", "medium", 1, 1), ("F02", "nl_description", "high", 1, 2), ("F03", "code_syntax", "low", 2, None),
        ("F04", "code_example", "low", 3, None), ("F05", "impl_detail", "skip", 4, None),
    ]
    assert rows[1]["prev_id"] == "F01" and rows[1]["next_id"] == "F03" and rows[0]["prev_id"] is None
    assert lexicon.eligible(spark.createDataFrame(rows), skip_low=True).count() == 2


def test_entities(spark):
    made = entities.matching(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, env string"), {"env": "context.env", "id": "a"}, {})
    assert [r["id"] for r in made.collect()] == ["a"]
    bindings = spark.createDataFrame([("f", "e1", True, "missing", None), ("f", "e2", True, "filled", "v"), ("g", "e3", False, "missing", None)], "frame string, fe string, required boolean, status string, value string")
    got = {r["frame"]: (r["saturated"], r["missing"]) for r in entities.saturated(bindings).collect()}
    assert got == {"f": (False, ["e1"]), "g": (True, [])}
    answers = spark.createDataFrame([("e1", "yes"), ("e3", None)], "fe string, answer string")
    after = {r["fe"]: (r["value"], r["status"]) for r in entities.with_answers(bindings, answers).collect()}
    assert after["e1"] == ("yes", "filled") and after["e3"] == (None, "missing")
    assert [r["step"] for r in entities.steps(bindings).collect()] == [1]
    with pytest.raises(Exception, match="duplicate id"):
        entities.checked_unique(spark.createDataFrame([("a",), ("a",)], "id string")).collect()
    rows = spark.createDataFrame([("u", ["r1", "r2"]), ("w", None)], "id string, refs array<string>")
    assert entities.field_candidates(rows, "refs", "unit").count() == 2


def test_tool_scores(spark):
    rule = lambda h, n: spark.range(1).select(tools.rule_similarity(F.lit(h), F.array(*[F.lit("k")] * n)).alias("x")).first()["x"]
    assert (rule(1, 2), rule(1, 1), rule(0, 2), rule(2, 2)) == (0.85, 1.0, 0.0, 1.0)
    ring = spark.createDataFrame([("a", ["b", "zz"]), ("b", ["a"]), ("c", [])], "name string, dependencies array<string>")
    got = {(r["name"], r["member"]) for r in tools.closure(ring).collect()}
    assert got == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")}


def test_ontologies(spark):
    labels = spark.createDataFrame([("l1", "one"), ("l2", "two"), ("l3", "three")], "label_id string, label string")
    relations = spark.createDataFrame([("r1", "l1", "l2")], "relation_id string, label_1 string, label_2 string")
    got = {tuple(r["label_ids"]): (r["relation_ids"], r["descriptor"]) for r in knowledge.ontologies(labels, relations).collect()}
    assert got == {("l1", "l2"): (["r1"], "one / two"), ("l3",): ([], "three")}
