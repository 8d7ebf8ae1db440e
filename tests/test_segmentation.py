"""Segmentation against every way to cut a text; a parse of sentences without spaces."""

import math
import random
import re

import pytest

from loomery.operators import collocations, parsing, segmentation
from loomery.operators.segmentation import Lexicon

TERMS = {
    "流水": (20.0, "n"), "流水线": (60.0, "n"), "水线": (2.0, "n"), "线": (8.0, "n"), "自动": (50.0, "d"), "触发": (40.0, "v"), "构建": (40.0, "v"),
    "任务": (70.0, "n"), "发": (9.0, "v"), "构建任务": (3.0, "n"), "在": (90.0, "p"), "系统": (50.0, "n"), "job_id": (5.0, "nz"), "线job": (4.0, "x"),
}


def _every_cut(lex, s):
    """All word sequences of one block: terms, single characters of the script, whole runs of others."""
    runs = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_]+", s)]
    inside = lambda i: any(a < i < b for a, b in runs)

    def ways(i):
        if i == len(s):
            return [[]]
        out = []
        for j in range(i + 1, len(s) + 1):
            run = (i, j) in runs
            single = j == i + 1 and not any(a <= i < b for a, b in runs)
            if not inside(j) and (s[i:j] in lex.terms or run or single):
                out += [[s[i:j], *rest] for rest in ways(j)]
        return out

    return ways(0)


def _worth(lex, words):
    return sum(math.log(lex.terms.get(w, (1.0, ""))[0] / lex.total) for w in words)


def test_paths_equal_the_best_of_all_cuts():
    lex, r = Lexicon(TERMS), random.Random(1)
    pieces = [*TERMS, *"流水线自动触发构建任务系统的了", "ab", "job", "7"]
    for _ in range(300):
        s = "".join(r.choice(pieces) for _ in range(r.randint(1, 6)))[:14]
        got = [w for w, _, _ in lex.cut(s)]
        ways = _every_cut(lex, s)
        assert got in ways and abs(_worth(lex, got) - max(_worth(lex, w) for w in ways)) < 1e-9, s
        assert "".join(got) == s


def test_blocks_tags_places_and_ties():
    lex = Lexicon(TERMS)
    assert lex.cut("流水线，自动触发 job_id=7 某") == [("流水线", "n", 0), ("自动", "d", 4), ("触发", "v", 6), ("job_id", "nz", 9), ("7", "m", 16), ("某", "x", 18)]
    assert lex.cut("") == [] and lex.cut("，。 !") == []
    assert [w for w, *_ in lex.cut("jobs流水线jobs")] == ["jobs", "流水线", "jobs"]  # no term ends inside a run
    even = Lexicon({"甲": (1.0, "n"), "乙": (1.0, "n"), "甲乙": (1.0, "n")})
    assert [w for w, *_ in even.cut("甲乙")] == ["甲乙"]
    letters = Lexicon({"small": (3.0, "a"), "ring": (2.0, "n"), "smaller": (1.0, "a")}, script="a-z")
    assert [w for w, *_ in letters.cut("smallring")] == ["small", "ring"]


def test_dictionaries_of_tables_and_injected_terms(spark):
    terms = spark.createDataFrame([("流水", 5, "n"), ("水线", 50, "n"), ("流", 50, "n"), ("水线", 40, "v"), (None, 1, "n"), ("bad", 0, "n")], "term string, freq int, tag string")
    own = spark.createDataFrame([("流水线",), ("v1",), ("42",)], "term string")
    plain, more = segmentation.lexicon(terms), segmentation.lexicon(terms, own)
    assert plain.terms["水线"] == (50.0, "n") and "bad" not in plain.terms
    assert more.terms["流水线"] == (9999.0, "nz") and more.terms["42"] == (9999.0, "n")
    rows = spark.createDataFrame([(1, "流水线"), (2, None), (3, "")], "id int, text string")
    cut = lambda lex: {r["id"]: [w["word"] for w in r["words"]] for r in segmentation.segment(rows, lex).collect()}
    assert cut(plain) == {1: ["流", "水线"], 2: [], 3: []} and cut(more)[1] == ["流水线"]
    with pytest.raises(ValueError):
        segmentation.lexicon(terms, own, most=3)


def test_sentences_without_spaces_are_parsed(spark):
    docs = spark.createDataFrame([("d", "流水线自动触发构建任务。系统。任务触发任务在系统触发"), ("e", None)], "doc_id string, text string")
    sents = collocations.sentences(docs, collocations.Params())
    rows = segmentation.sentence_words(sents, Lexicon({**TERMS, "触发": (400.0, "v"), "构建任务": (500.0, "n")}))
    made = parsing.with_edges(rows)
    got = {(r["w1"], r["rel"], r["w2"]) for r in collocations.typed_edges(made).collect()}
    assert ("触发", "nsubj", "流水线") in got and ("触发", "obj", "构建任务") in got and ("触发", "advmod", "自动") in got and ("触发", "obj", "任务") in got
