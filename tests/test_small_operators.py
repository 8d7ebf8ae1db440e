"""Stage writers, rising times, test vectors, contents, raw tools, candidates and retrieval of words."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import text, vectors
from loomery.operators import collocations as c
from loomery.operators import entities, knowledge, lexicon, ordered, tools
from loomery.sinks import stages


def test_stages_are_written_with_one_scan_of_the_documents(spark, tmp_path):
    r = random.Random(1)
    words = "the small loom wove red cloth quickly while weavers sang old songs of winter".split()
    docs = [(i, ". ".join(" ".join(r.choice(words) for _ in range(9)) for _ in range(6))) for i in range(60)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    made = {x["stage"]: x["n_rows"] for x in stages.write_collocations(frame.mapInPandas(counted, frame.schema), str(tmp_path / "out"), most=3).collect()}
    assert reads.value == len(docs)
    sents = c.sentences(frame)
    scored = c.gated(c.with_counts(c.pair_counts(c.adjacent_edges(sents)), c.unigrams(sents)))
    assert made["sentences"] == sents.count() and made["pairs"] == scored.where("passed").count() and made["rejected"] == scored.where("not passed").count()
    assert set(made) == {"sentences", "ngrams", "pairs", "rejected", "entropy", "whitelist", "triples", "templates"}
    back = spark.read.json(str(tmp_path / "out" / "pairs"))
    assert back.count() == made["pairs"]
    table = "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "out" / "tables" / "pairs.md")).collect())
    levels = {x["level"]: min(3, x["count"]) for x in scored.where("passed").groupBy("level").count().collect()}
    assert table.startswith("## pairs") and sum(line.startswith("| ") for line in table.splitlines()) == 2 + sum(levels.values())
    assert os.path.exists(tmp_path / "out" / "tables" / "templates.md")


def test_times_are_made_rising(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 40) + i // 3) for i in range(500)]
    want, last = {}, None
    for i, t in sorted(rows, key=lambda x: (x[1], x[0])):
        last = t if last is None or t > last else last + 1
        want[i] = last
    frame = spark.createDataFrame(rows, "id int, t long").repartition(5)
    got = ordered.rising(frame, "t", ("t", "id"), "tick")
    assert {x["id"]: x["tick"] for x in got.collect()} == want and got.columns == ["id", "t", "tick"]
    ids = [x["u"] for x in got.orderBy("t", "id").select(text.tick_id(F.col("tick"), F.lit(0), F.lit(1)).alias("u")).collect()]
    assert ids == sorted(set(ids)) and len(ids) == 500
    assert ordered.rising(frame.limit(0), "t", ("t", "id"), "tick").count() == 0


def test_vectors_of_characters(spark):
    rows = spark.createDataFrame([("apple",), ("paple",), ("apple pie",), ("zzz",), ("",), (None,)], "t string")
    got = {x["t"]: x["v"] for x in rows.select("t", vectors.character_embedding(F.col("t"), 40).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert all(len(v) == 40 for t, v in got.items() if t is not None) and abs(dot("apple", "apple") - 1) < 1e-9
    assert abs(dot("apple", "paple") - 1) < 1e-9 and dot("apple", "apple pie") > dot("apple", "zzz") + 0.2
    assert got[""] == [0.0] * 40 and got[None] is None


def test_contents_by_priority(spark):
    cards = spark.createDataFrame(
        [("a", "debug", "ontology", "old"), ("a", "gold", "information", " new \n"), ("a", "gold", "ontology", "first"), ("b", "gold", "ontology", "  "), ("c", "release", "labeling", "c")],
        "artifact_id string, stage string, layer string, content string",
    )
    asked = spark.createDataFrame([(2, "a"), (1, "c"), (3, "b"), (4, "none"), (5, "a")], "ord int, artifact_id string")
    got = sorted(tuple(x) for x in knowledge.contents(asked, cards).collect())
    assert got == [(1, "c", "release", "labeling", "c"), (2, "a", "gold", "ontology", "first"), (5, "a", "gold", "ontology", "first")]


def test_raw_tools_in_order(spark):
    asked = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "gone"), (2, 1, "b")], "request_id int, ord int, name string")
    registry = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B")], "name string, raw string")
    assert sorted(tuple(x) for x in tools.raw_tools(asked, registry).collect()) == [(1, 1, "a", "A"), (1, 2, "b", "B"), (2, 1, "b", "B")]


def test_candidates_of_artifacts(spark):
    rows = spark.createDataFrame([("x", "o1", [("p1",), (None,)]), ("y", "o1", None), ("z", "o2", [("p2",)])], "id string, belongs_to string, files array<struct<path:string>>")
    one = spark.createDataFrame([("x",), ("none",)], "id string")
    assert [tuple(r) for r in entities.named_candidates(rows, one).collect()] == [("x", "x", "entity")]
    owner = spark.createDataFrame([("o1",)], "id string")
    assert sorted(tuple(r) for r in entities.owned_candidates(rows, owner).collect()) == [("o1", "x", "entity"), ("o1", "y", "entity")]
    assert sorted(tuple(r) for r in entities.part_candidates(rows, "files", "path").collect()) == [("x", "p1", "entity"), ("z", "p2", "entity")]


def test_content_words_are_retrieved(spark):
    words = spark.createDataFrame([("d", 0, "The", None), ("d", 1, "cats", None), ("d", 2, "x", None), ("d", 3, "sat", "v"), ("d", 4, "Cats", "v"), ("e", 0, "cats", None)], "doc_id string, place int, word string, pos string")
    lex = spark.createDataFrame([("cat", "n", f"F{i}") for i in range(9)] + [("sat", "n", "Wrong")], "lemma string, pos string, frame string")
    hits, misses = lexicon.retrieved(words, lex, limit=4)
    assert sorted((r["doc_id"], r["place"], r["frame"], r["rank"]) for r in hits.collect()) == [(d, p, f"F{i}", i + 1) for d, p in (("d", 1), ("e", 0)) for i in range(4)]
    assert sorted((r["place"], r["word"]) for r in misses.collect()) == [(3, "sat"), (4, "Cats")]


def test_a_frame_is_selected_that_other_words_share(spark):
    hits = [("d", 0, "bank", "Money", 1), ("d", 0, "bank", "River", 2), ("d", 3, "shore", "River", 1), ("d", 5, "lamp", "Light", 1), ("d", 5, "lamp", "Thing", 2), ("d", 9, "bank", "Money", 1), ("d", 9, "bank", "River", 2), ("e", 0, "bank", "Money", 1), ("e", 0, "bank", "River", 2)]
    candidates = spark.createDataFrame([(d, p, w, w, f, r) for d, p, w, f, r in hits], "doc_id string, place int, word string, lemma string, frame string, rank int")
    misses = spark.createDataFrame([("d", 7, "xyzzy")], "doc_id string, place int, word string")
    got = {(r["doc_id"], r["place"]): (r["frame"], r["confidence"], r["source"]) for r in lexicon.selected(candidates, misses).collect()}
    assert got == {
        ("d", 0): ("River", "medium", "lexicon"), ("d", 9): ("River", "medium", "lexicon"), ("d", 3): ("River", "high", "lexicon"), ("d", 5): ("Light", "low", "lexicon"),
        ("d", 7): (None, "none", "none"), ("e", 0): ("Money", "low", "lexicon"),
    }


def test_rich_texts(spark):
    rows = spark.createDataFrame([("read_file-now", " x" * 200, ["a", "b"]), ("t", None, []), ("u", "d", None)], "n string, d string, p array<string>")
    got = [r["t"] for r in rows.select(text.rich_text(F.col("n"), F.col("d"), F.col("p")).alias("t")).collect()]
    assert got[0] == "Tool: read file now. Purpose: " + (" x" * 200)[:300].strip() + ". Parameters: a, b." and got[1:] == ["Tool: t. Purpose: .", "Tool: u. Purpose: d."]


@pytest.mark.parametrize("name", ["retrieved_words", "raw_tools"])
def test_empty_tables(spark, name, tmp_path):
    from loomery import catalog

    for table in ("documents", "benchmark", "lineitem", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
