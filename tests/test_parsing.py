"""Tagging, shallow dependencies and sense clusters."""

from loomery.operators import parsing


def _tokens(spark, *words):
    rows = [("d", 1, i, w) for i, w in enumerate(words)]
    return parsing.tagged(spark.createDataFrame(rows, "doc_id string, sent_id int, idx int, word string"), {"loom": "n"})


def test_tags_and_edges(spark):
    tokens = _tokens(spark, "weavers", "quickly", "used", "loom", "in", "winter", "mills", "made", "cloth")
    assert [r["pos"] for r in tokens.orderBy("idx").collect()] == ["n", "d", "v", "n", "p", "n", "n", "v", "n"]
    got = {(r["head"], r["dep"], r["rel"], r["score"], r["candidate"]) for r in parsing.dependency_edges(tokens).collect()}
    assert (2, 1, "advmod", 0.8, False) in got and (2, 3, "obj", 0.8, False) in got
    assert (2, 0, "nsubj", 0.65, True) in got and (4, 5, "pobj", 0.7, False) in got and (7, 4, "prep", 0.55, True) in got
    assert (7, 6, "nsubj", 0.8, False) in got and (7, 8, "obj", 0.8, False) in got
    heads = parsing.first_heads(parsing.dependency_edges(tokens))
    assert heads.groupBy("dep").count().where("count > 1").count() == 0


def test_barriers_stop_the_search(spark):
    tokens = _tokens(spark, "cloth", "used", "made")
    got = {(r["head"], r["dep"], r["rel"]) for r in parsing.dependency_edges(tokens).collect()}
    assert got == {(1, 0, "nsubj")}


def test_sense_clusters(spark):
    bags = [["a", "b", "c"], ["a", "b", "d"], ["x", "y", "z"], ["x", "y", "w"], ["a", "b"]]
    rows = [("lu", "d", i, ["lu", *b]) for i, b in enumerate(bags)] + [("few", "d", 1, ["q"])]
    frame = spark.createDataFrame(rows, "lu string, doc_id string, sent_id int, words array<string>")
    got = parsing.sense_clusters(frame).orderBy("sense").collect()
    assert [(r["sense"], r["size"], r["signature"][:2], r["polysemy"]) for r in got] == [(1, 3, ["a", "b"], True), (2, 2, ["x", "y"], True)]


def test_phrases_join_their_words(spark):
    words = spark.createDataFrame([("审批", "Active_LU")], "lu string, tag string")
    phrases = spark.createDataFrame([("审批", "订单的审批"), ("部署", "系统的部署")], "lu string, phrase string")
    got = {r["lu"]: (r["tag"], r["phrases"]) for r in parsing.merge_phrases(words, phrases).collect()}
    assert got == {"审批": ("Active_LU", ["订单的审批"]), "部署": ("Deverbal_Noun", ["系统的部署"])}
