"""What the findings of round 4 showed, in small."""

from loomery import catalog
from loomery.operators import knowledge, lexicon, retrieval


def test_a_word_may_have_any_number_of_frames(spark):
    # The fourth frame and later ones were dropped, and with them what they share with the document's other words.
    lex = spark.createDataFrame([("bank", f) for f in "ABCDEFGHIJ"] + [("light", "J"), ("light", "K"), ("one", "A")], "lemma string, frame string")
    words = spark.createDataFrame([(1, "bank", 2), (1, "Light", 1), (1, "one", 1), (1, "xyzzy", 3), (2, "bank", 1)], "doc_id int, word string, n long")
    counted = lexicon.retrieved_counts(words, lex)
    assert {(r["doc_id"], r["word"]): r["frames"] and len(r["frames"]) for r in counted.collect()}[1, "bank"] == 10
    got = {tuple(r) for r in lexicon.selected_counts(counted).collect()}
    assert got == {
        (1, "bank", 2, "A", "medium", "lexicon"), (1, "Light", 1, "J", "medium", "lexicon"), (1, "one", 1, "A", "high", "lexicon"),
        (1, "xyzzy", 3, None, "none", "none"), (2, "bank", 1, "A", "low", "lexicon"),
    }
    assert all(len(r["frames"]) <= 3 for r in lexicon.retrieved_counts(words, lex, limit=3).where("frames is not null").collect())


def test_annotated_frames_keeps_every_candidate(spark, tmp_path):
    spark.createDataFrame([(i, "bank") for i in range(1, 5)] + [(4, "light")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "bank light bank")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.QUERIES["annotated_frames"](spark, str(tmp_path))
    assert {tuple(r) for r in made.select("frame", "confidence", "n").collect()} == {("B4", "medium", 2), ("B4", "high", 1)}
    assert "place <= 3" not in catalog.SQL["annotated_frames"] and "place <= 3" in catalog.SQL["retrieved_words"]


def _moved(spark):
    """Rows written to shuffles, by stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_questions_and_cards_are_moved_once_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SMALL_BLOCK", 16)
    monkeypatch.setattr(retrieval, "SMALL_GROUP", 100, raising=False)
    cards = [(f"a{i // 2}", ("gold", "debug")[i % 2], ("ontology", "information")[i % 3 // 2], f"the of w{i % 7} v{i % 11}") for i in range(400)]
    index = retrieval.build(spark.createDataFrame(cards, "artifact_id string, stage string, layer string, content string"))
    asked = spark.createDataFrame([(i, f"the w{i % 9} v{i % 13}") for i in range(2000)], "id int, text string")
    before = max(_moved(spark), default=-1)
    got = {r["question"]: (r["artifact_id"], r["stage"], r["layer"]) for r in retrieval.search(index, asked, limit=1).collect()}
    # A row a question and block was moved, twice: 16 times the questions, and more with more cards.
    moved = sum(n for stage, n in _moved(spark).items() if stage > before)
    assert len(got) == 2000 and 2000 < moved < 3 * (2000 + 400)
    rows = spark.createDataFrame(cards, "artifact_id string, stage string, layer string, content string")
    for i in range(0, 2000, 400):
        assert got[i] == tuple(knowledge.recall_top(rows, f"the w{i % 9} v{i % 13}", 1).select("artifact_id", "stage", "layer").first())


def test_best_cards_over_blocks_ties_and_long_questions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SMALL_BLOCK", 8)
    monkeypatch.setattr(retrieval, "DENSE", 3, raising=False)
    stages, layers = list(knowledge.STAGES), list(knowledge.LAYERS)
    body = lambda i: " ".join(f"t{j}" for j in range(600) if (j * 7 + i * 13) % (5 + i % 40) == 0)
    cards = spark.createDataFrame([(f"a{i // 5 % 30}", stages[i % 3], layers[i % 4], body(i % 90)) for i in range(200)], "artifact_id string, stage string, layer string, content string")
    texts = [" ".join(f"t{j}" for j in range(600)), "t1 t2 t3", "t0", "none of them", " ".join(f"t{j}" for j in range(0, 600, 3))]
    found = retrieval.search(retrieval.build(cards), spark.createDataFrame(list(enumerate(texts)), "id int, text string"), limit=4)
    got = {}
    for r in found.orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append((r["artifact_id"], r["stage"], r["layer"], round(r["score"], 9)))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(r["artifact_id"], r["stage"], r["layer"], round(r["score"], 9)) for r in knowledge.recall_top(cards, t, 4).collect()]
