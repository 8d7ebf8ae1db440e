"""Cards written and read back, failing tasks, and reports of small tables."""

import os

import pytest
from pyspark.sql import functions as F

from loomery.sinks import reports
from loomery.sources.cards import SCHEMA, CardSource, card_text, parsed_card

CARDS = [
    ("gold", "labeling", "a1", "A: title \"x\"", "body\nof several\n---\nlines"), ("gold", "labeling", "a/2 é", None, ""), ("debug", "relating", "..", "t", "---\n"),
    ("debug", "x y", "b", None, None), ("debug", "relating", "50%", "", "plain"),
]


@pytest.fixture(scope="module")
def cards(spark):
    spark.dataSource.register(CardSource)
    return spark.createDataFrame(CARDS, SCHEMA)


def _read(spark, root):
    return sorted((tuple(r) for r in spark.read.format("cards").load(root).collect()), key=repr)


def test_cards_go_out_and_come_back(spark, cards, tmp_path):
    root = str(tmp_path / "cards")
    cards.repartition(3).write.format("cards").mode("append").save(root)
    want = sorted([(*c[:4], c[4] or "") for c in CARDS], key=repr)
    assert _read(spark, root) == want
    folders = [f for f in os.listdir(root) if f != "_pending"]
    assert os.listdir(f"{root}/_pending") == [] and len(folders) <= 3
    assert spark.read.format("cards").load(root).rdd.getNumPartitions() == len(folders)
    cards.limit(2).write.format("cards").mode("append").save(root)
    assert len(_read(spark, root)) == len(CARDS) + 2
    cards.limit(1).write.format("cards").mode("overwrite").save(root)
    assert len(_read(spark, root)) == 1
    assert spark.read.format("cards").load(str(tmp_path / "nothing")).count() == 0
    cards.limit(0).write.format("cards").mode("append").save(str(tmp_path / "empty"))
    assert _read(spark, str(tmp_path / "empty")) == []


def test_a_failing_task_leaves_nothing(spark, cards, tmp_path):
    root = str(tmp_path / "cards")
    cards.write.format("cards").mode("append").save(root)
    before = _read(spark, root)
    many = spark.range(200).select(F.lit("s").alias("stage"), F.when(F.col("id") != 150, "l").alias("layer"), F.col("id").cast("string").alias("artifact_id"), F.lit(None).cast("string").alias("title"), F.lit("c").alias("content"))
    with pytest.raises(Exception, match="needs a stage"):
        many.repartition(4).write.format("cards").mode("append").save(root)
    assert _read(spark, root) == before and os.listdir(f"{root}/_pending") == []


def test_front_matter_of_any_text():
    for title in (None, "", "a\nb", 'say "---\n"', "é"):
        for content in ("", "x", "---\nx\n---\n", "\n\n"):
            assert parsed_card(card_text(title, content)) == (title, content)
    assert parsed_card("no rules") == (None, "no rules") and parsed_card("---\nopen") == (None, "---\nopen")


def test_reports_of_small_tables(spark):
    lexicon = {
        "frames": spark.createDataFrame([("Make", "d" * 600), ("Bare", None)], "frame string, definition string"),
        "units": spark.createDataFrame([(f"w{i:02}", "v", "Make") for i in range(30)] + [("x", "n", "Gone")], "lemma string, pos string, frame string"),
        "elements": spark.createDataFrame([("Make", "Agent", "Core", "a" * 400), ("Make", "Time", "Extra-Thematic", None)], "frame string, fe string, core string, definition string"),
        "relations": spark.createDataFrame([("Using", "Make", f"Other{i:02}", i) for i in range(20)], "type string, sub string, super string, ord int"),
    }
    made = {r["frame"]: r["report"] for r in reports.lexicon_reports(lexicon).collect()}
    whole = made["Make"]
    assert whole.startswith("# Make\n\n" + "d" * 500 + "\n\n## Core elements\n\n- **Agent**: " + "a" * 300 + "\n\n")
    assert "`w19.v`" in whole and "`w20.v`" not in whole and "Other14" in whole and "Other15" not in whole and "## Extra-Thematic elements\n\n- **Time**: " in whole
    assert made["Bare"] == "# Bare\n\n## Core elements\n\n(none)\n\n## Peripheral elements\n\n(none)\n"
    gaps = {(r["part"], r["frame"]): r["n"] for r in reports.unknown_frames(lexicon).collect()}
    assert gaps[("units", "Gone")] == 1 and gaps[("relations", "Other03")] == 1 and len(gaps) == 21
    fragments = spark.createDataFrame([(1, "F01", "high"), (1, "F02", "skip"), (2, "F01", None)], "doc_id int, fragment_id string, value string")
    words = spark.createDataFrame(
        [(1, "F01", 2, "made|by", "Make", "low"), (1, "F01", 1, "it", None, None), (1, "F02", 1, "make", "Make", "high")],
        "doc_id int, fragment_id string, place int, word string, frame string, confidence string",
    )
    tied = spark.createDataFrame([(1, "Make", "Act", "causal", None)], "doc_id int, source string, target string, kind string, detail string")
    got = {r["doc_id"]: r["report"] for r in reports.annotation_reports(fragments, words, tied).collect()}
    assert "| Make | made\\|by, make | F01, F02 | [+++] high |" in got[1] and "- F01 it: -; made|by: Make" in got[1] and "| none confidence | 1 |" in got[1]
    assert got[1].endswith("## Left out\n\nF02\n") and "## Frames" not in got[2] and "| fragments | 1 |" in got[2]
