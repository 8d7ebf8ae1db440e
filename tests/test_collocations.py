"""Collocation mining on hand-worked cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomery.functions import stats, text
from loomery.operators import collocations as c


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _llr(c11, c1, c2, n):
    cells = ((c11, c1 * c2 / n), (c1 - c11, c1 * (n - c2) / n), (c2 - c11, (n - c1) * c2 / n), (n - c1 - c2 + c11, (n - c1) * (n - c2) / n))
    return 2 * sum(a * math.log(a / e) for a, e in cells if a > 0 and e > 0)


def test_llr_by_hand_and_with_inconsistent_counts(spark):
    rows = [(10, 20, 20, 1000), (12, 10, 20, 1000), (1, 1, 1, 1), (5, 5, 5, 10)]
    frame = spark.createDataFrame(rows, "c long, c1 long, c2 long, n long")
    got = [r["x"] for r in frame.select(stats.log_likelihood(*map(F.col, ("c", "c1", "c2", "n"))).alias("x")).collect()]
    assert round(got[0], 4) == 56.7554
    assert got == pytest.approx([_llr(*r) for r in rows])


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 50), st.integers(0, 50), st.integers(0, 50), st.integers(1, 500))
def test_llr_is_not_negative_for_consistent_counts(c11, a, b, rest):
    assert _llr(c11, c11 + a, c11 + b, c11 + a + b + rest) > -1e-6


def test_gate_reasons_in_order(spark):
    rows = [("the", "x", 9, 9), ("a", "b", 4, 9), ("a", "c", 5, 2), ("d", "e", 5, 3), ("f", "g", 10, 5)]
    pairs = spark.createDataFrame(rows, "w1 string, w2 string, c long, df long")
    counted = pairs.withColumn("c1", F.lit(20)).withColumn("c2", F.lit(20)).withColumn("n", F.when(F.col("w1") == "d", 80).otherwise(1000))
    got = {r["w1"] + r["w2"]: r for r in c.gated(counted, c.Params(script=None, stopwords=("the",))).collect()}
    assert got["thex"]["rejected_reason"] == "stopword"
    assert got["ab"]["rejected_reason"] == "freq<=4"
    assert got["ac"]["rejected_reason"] == "df<3"
    assert got["de"]["rejected_reason"] == "llr<=3.84" and got["de"]["llr"] is not None
    assert got["fg"]["passed"] and got["fg"]["level"] == "golden" and got["fg"]["llr"] == 56.7554


def test_entropy_and_tags(spark):
    pairs = spark.createDataFrame([("v", "a", 3), ("v", "b", 1), ("v", "true", 9), ("w", "1.2", 4)], "w1 string, w2 string, c long")
    (row,) = c.object_entropy(pairs).collect()
    assert (row["h"], row["h_norm"], row["n_nouns"], row["c_v"]) == (0.9183, 0.9183, 2, 4)
    assert row["tag"] == "Keep_Watch" and row["note"] == "sample_limited(c<5)" and row["top_nouns"] == "a,b"
    tags = [(6, 0.9, 2), (6, 0.9, 3), (6, 0.2, 3), (6, 0.5, 3)]
    frame = spark.createDataFrame(tags, "n long, h double, k long")
    tag, note = c.tagged(F.col("n"), F.col("h"), F.col("k"))
    assert [tuple(r) for r in frame.select(tag, note).collect()] == [
        ("Keep_Watch", "objects<3"), ("Drop_Light_Verb", "high_entropy>=0.85"), ("Active_LU", "low_entropy<=0.35"), ("Keep_Watch", "0.35<h_norm<0.85"),
    ]


def test_sentences_are_cleaned(spark):
    docs = spark.createDataFrame([("d", "1. 仓库授权！用户创建订单；12345；abc；系统"), ("e", None)], "doc_id string, text string")
    cjk = [r["sentence"] for r in c.sentences(docs, c.Params()).orderBy("sent_id").collect()]
    assert cjk == ["仓库授权", "用户创建订单"]


def test_typed_edges_and_triples(spark):
    edges = [("d", 1, "see", "cat", 2, "obj", 0.8), ("d", 1, "on", "cat", 2, "pobj", 0.7), ("d", 1, "see", "dog", 4, "nsubj", 0.5), ("d", 1, "see", "now", 5, "advmod", 0.8), ("d", 1, "x", "y", 6, "amod", 0.9)]
    parsed = spark.createDataFrame(edges, "doc_id string, sent_id int, head_word string, dep_word string, dep_idx int, rel string, score double")
    got = {(r["w1"], r["w2"], r["type"], r["candidate"]) for r in c.classified_edges(parsed).collect()}
    assert got == {("on", "cat", "prep_pobj", False), ("see", "dog", "pred_noun", True), ("see", "now", "pred_adv", False)}
    words = [("d", 1, i, w, p, r) for i, (w, p, r) in enumerate([("by", "p", ""), ("hand", "n", "pobj"), ("soon", "d", ""), ("make", "v", ""), ("bread", "n", "obj")])]
    toks = spark.createDataFrame(words, "doc_id string, sent_id int, idx int, word string, pos string, dep_rel string")
    listed = spark.createDataFrame([("make",)], "word string")
    got = {tuple(r) for r in c.tagged_trigrams(toks, listed).select("w1", "w2", "w3", "type").collect()}
    assert got == {("soon", "make", "bread", "adv_v_n"), ("by", "hand", "make", "prep_n_v")}


def test_text_functions(spark):
    one = lambda x: _one(spark, x)
    assert one(text.mixed_tokens(F.lit("Redis_1 a 缓存层 词"))) == ["redis_1", "缓存", "存层", "词"]
    assert one(text.strip_letters(F.lit("sing"), "ing")) == "s"
    assert one(text.short_id("lbl_", F.lit(" Abc "))) == one(text.short_id("lbl_", F.lit("abc")))
    assert one(text.line_range(F.lit("L42-L68"))) == (42, 68) and one(text.line_range(F.lit("L7"))) == (7, 7)
    assert one(text.truncated(F.lit("x" * 61))) == "x" * 60 + "..."
    assert one(text.without_thinking(F.lit("<think>a\nb</think>\n```json\n{}\n```"))) == "{}"
    variants = one(text.stem_variants(F.lit("making")))
    assert {"mak", "making", "maked", "maker", "maks"} <= set(variants)
    assert one(stats.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
