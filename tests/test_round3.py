"""What the findings of round 3 showed, in small."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery import catalog
from loomery.operators import collocations, entities, knowledge, lexicon, ordered, parsing, retrieval, similarity, tools, vector_index
from loomery.sinks import reports


@pytest.fixture
def ranges(spark):
    """Small tables in several ranges, as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_rising_times_go_on_over_ranges_and_ties(spark, ranges):
    rows = [(i // 40 * 5, i, i % 3) for i in range(200)] + [(5, 50, 7), (5, 50, 8), (5, 50, 9)]
    got = sorted(r["tick"] for r in ordered.rising(spark.createDataFrame(rows, "time long, id int, x int"), "time", ("time", "id"), "tick").collect())
    want = []
    for t, *_ in sorted(rows):
        want.append(max(t, want[-1] + 1) if want else t)
    assert got == want


def test_running_values_may_have_any_name(spark, ranges):
    rows = spark.createDataFrame([(i, 1) for i in range(100)], "ord int, v int")
    assert [r["_n"] for r in ordered.running(rows, {"_n": ("sum", "v")}, ()).orderBy("ord").collect()] == list(range(1, 101))


def _lexicon(spark):
    lex = [("bank", "n", "Money"), ("bank", "v", "River"), ("bank", "n", "Areas"), ("bank", "n", "Zone"), ("run", "n", "Move"), ("light", "n", "Light"), ("light", "n", "Areas")]
    return spark.createDataFrame(lex, "lemma string, pos string, frame string")


def test_counted_words_are_given_the_frames_of_single_ones(spark):
    texts = [(1, "The Banks bank Light runs' xyzzy BANK a bank light"), (2, "running banked x"), (3, ""), (4, None), (5, "xyzzy xyzzy")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    lex = _lexicon(spark)
    words = collocations.word_offsets(docs).selectExpr("doc_id", "place", "word", "cast(null as string) as pos")
    hits, misses = lexicon.retrieved(words, lex, limit=3)
    own = ["doc_id", "word", "frame", "confidence", "source"]
    want = {tuple(r[c] for c in own): r["count"] for r in lexicon.selected(hits, misses).groupBy(*own).count().collect()}
    counted = lexicon.retrieved_counts(collocations.word_counts(docs), lex, limit=3)
    got = {tuple(r[c] for c in own): r["n"] for r in lexicon.selected_counts(counted).collect()}
    assert got == want and len(want) > 5


def test_annotated_frames_cuts_each_text_and_finds_each_word_once(spark):
    made = catalog.QUERIES["annotated_frames"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # Four times before: for candidates three times and for misses.
    assert plan.count("[A-Za-z']+") == 1


@pytest.mark.parametrize("most", [0, 2, 100])
def test_triples_whose_words_are_not_sent_to_all(spark, most):
    triples = spark.createDataFrame([("a", "b", "c", 2), ("a", "a", "d", 1), ("x", "a", "b", 1)], "w1 string, w2 string, w3 string, c long")
    uni = spark.createDataFrame([("a", 9), ("b", 9), ("c", 3), ("d", 1)], "word string, c long")
    assert collocations.frequent_words(uni, most).count() == min(most, 4)
    got = {r["w3"]: r["pmi3"] for r in collocations.trigram_information(triples, uni, most).collect()}
    want = {"c": 2 * 22**2 / (9 * 9 * 3), "d": 22**2 / (9 * 9 * 1), "b": 22**2 / (1 * 9 * 9)}
    assert set(got) == set(want) and len({round(got[k] - math.log2(want[k]), 3) for k in want}) == 1


def test_grams_are_counted_where_a_document_is(spark):
    plan = catalog.QUERIES["trigram_pmi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # A row a gram and document moved before.
    assert "Exchange hashpartitioning(gram" in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(gram" in x)


def test_no_row_a_question_and_card(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SMALL_BLOCK", 16)
    monkeypatch.setattr(retrieval, "GROUP", 5)
    cards = spark.createDataFrame([(f"a{i // 2}", "gold" if i % 2 else "debug", "ontology", f"the of w{i % 7}") for i in range(120)], "artifact_id string, stage string, layer string, content string")
    asked = spark.createDataFrame([(i, f"the of w{i % 9}") for i in range(23)], "id int, text string")
    made = retrieval.search(retrieval.build(cards), asked, limit=4)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # Hits of frequent tokens were rows and moved; now cards and questions meet inside their task.
    assert "FlatMapCoGroups" in plan and "token#" not in plan
    got = {}
    for r in made.orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append((r["artifact_id"], r["stage"], round(r["score"], 9)))
    for i in range(23):
        want = [(r["artifact_id"], r["stage"], round(r["score"], 9)) for r in knowledge.recall_top(cards, f"the of w{i % 9}", 4).collect()]
        assert got[i] == want


def test_jaccard_pairs_keep_weak_pairs(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "d", "e", "e"]), (3, ["c", "b", "a"]), (4, ["x"]), (5, None), (6, ["e", None])], "id int, tokens array<string>")
    members, pairs = similarity.overlapping_sets(rows)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (6, 6)}
    assert {(r["a"], r["b"], round(r["similarity"], 4)) for r in pairs.collect()} == {(1, 2, 0.2), (2, 6, 0.3333)}
    made = catalog.QUERIES["jaccard_pairs"](spark, "/root/testdata/sf0.001")
    assert 0 < made.where("jaccard < 0.5").count() < made.count()


def test_greedy_choice_is_a_fold_in_the_jvm(spark):
    member = "struct<name:string,score:double,tokens:int>"
    rows = [
        (q, name, score, 50 + 25 * (q % 6), [(m, s, t) for m, s, t in members])
        for q in range(12)
        for name, score, members in (
            ("b", 0.9, [("b", 0.9, 60), ("x", 0.1, 20)]), ("a", 0.9, [("a", 0.9, 30)]), ("c", 0.8, [("c", 0.8, 10), ("x", 0.1, 20)]),
            ("v", 0.7, [("v", 0.7, 1), ("w", -500.0, 1)]), ("x", 0.6, [("x", 0.1, 20)]), ("n", None, [("n", 0.5, 5)]),
        )
    ]
    frame = spark.createDataFrame(rows, f"request_id int, name string, score double, token_budget int, members array<{member}>")
    made = tools.select_greedy(frame)
    got = {}
    for r in made.collect():
        got.setdefault(r["request_id"], {})[r["name"]] = r["tokens"]
    want = {}
    for q in range(12):
        room, taken = 50 + 25 * (q % 6), {}
        own = [(n, s, m) for i, n, s, _, m in rows if i == q]
        for name, _, members in sorted(own, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
            new = [m for m in members if m[0] not in taken]
            cost = sum(m[2] for m in new)
            if name not in taken and cost <= room and not any(m[1] <= tools.VETO for m in new):
                room, taken = room - cost, taken | {m[0]: m[2] for m in new}
        want[q] = taken
    assert got == want and "Pandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_triples_are_parsed_once(spark):
    made = catalog.QUERIES["tagged_trigram_samples"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and made.count() > 0


def test_tags_are_those_of_endings_and_closed_words(spark):
    words = ["only", "fly", "sing", "red", "The", "WITH", "used", "very", "who", "lying", "noise", "house", "ly", "reply", "i"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["pos"] for r in parsing.tagged(rows, {"house": "v", "with": "n"}).collect()}
    want = dict(zip(words, ["d", "d", "v", "v", "u", "n", "v", "d", "r", "v", "v", "v", "d", "d", "r"], strict=True))
    assert got == want


def _senses(lu, bags, threshold=0.3, most=3):
    """Clusters by a plain loop over one word's bags."""
    own, made = [b for b in (frozenset(w) - {lu} for w in bags[:500]) if b], []
    for bag in own:
        linked = [c for c in made if any(len(bag & x) > threshold * len(bag | x) for x in c)]
        made = [c for c in made if c not in linked] + [[x for c in linked for x in c] + [bag]]
        if len(made) >= most:
            break
    found = [c for c in made if len(c) >= 2] if len(own) >= 4 else []
    out = []
    for n, c in enumerate(sorted(found, key=lambda c: (-len(c), sorted(map(sorted, c)))), 1):
        count = {w: sum(w in bag for bag in c) for bag in c for w in bag}
        out.append((lu, n, len(c), sorted(count, key=lambda w: (-count[w], w))[:8], 2 <= len(found) <= most))
    return out


def test_senses_are_read_as_a_stream(spark):
    import random

    dice, rows = random.Random(5), []
    for k in range(60):
        pool = [f"w{i}" for i in range(dice.choice((3, 6, 12)))]
        for i in range(dice.choice((1, 3, 4, 9, 40, 620))):
            rows.append((f"l{k}", i // 3, i % 3, dice.choices([*pool, f"l{k}"], k=dice.choice((0, 1, 2, 5)))))
    frame = spark.createDataFrame(rows, "lu string, doc_id int, sent_id int, words array<string>")
    made = parsing.sense_clusters(frame)
    want = {}
    for lu, *_, words in rows:
        want.setdefault(lu, []).append(words)
    got = sorted(tuple(r) for r in made.collect())
    assert got == sorted(row for lu, bags in want.items() for row in _senses(lu, bags))
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_vectors_reach_python_in_small_rows_and_scores_in_steps(spark, tmp_path, monkeypatch):
    dice = np.random.default_rng(2)
    points = dice.normal(size=(700, 8))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    whole, _ = vector_index._best(points, points[:50])
    monkeypatch.setattr(vector_index, "_SCORES", 64)  # one point at a time
    monkeypatch.setattr(vector_index, "_ROWS", 40)
    monkeypatch.setattr(vector_index, "_QUESTIONS", 7)
    assert (vector_index._best(points, points[:50])[0] == whole).all() and (whole == vector_index._scores("l2", points, points[:50]).argmax(axis=1)).all()
    index = vector_index.build(rows, str(tmp_path / "index"), cells=9)
    made = vector_index.nearest(index, rows.where("id % 20 = 0"), limit=5)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {(q, int(i), n) for q in range(0, 700, 20) for n, i in enumerate(np.argsort(-(unit[q] @ unit.T), kind="stable")[:5], 1)}
    assert {(r["question"], r["id"], r["place"]) for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_idle_sessions_end_after_exactly_that_time_and_stay_in_the_jvm(spark, tmp_path):
    from loomery.streaming import events

    times = {1: (0, 1000, 2001, 3001, 3500), 2: (5, 1005, 90_000), 3: (700_000,)}
    rows = [(n, u, ms) for u, own in times.items() for n, ms in enumerate(own)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ms long")
    frame = frame.select("event_id", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, ms / 1000) + interval '0.000900' second").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.idle_sessions(events.read_events(spark, str(tmp_path / "in")), idle_ms=1000)
    assert "Pandas" not in stream._jdf.queryExecution().logical().toString() and "Python" not in stream._jdf.queryExecution().logical().toString()
    base = 1_704_067_200_000
    got = {(r["user_id"], r["first_ms"] - base, r["last_ms"] - base, r["events"]) for r in events.run_available(stream).collect()}
    # The watermark, ten minutes before the last event, is at 100,000 ms.
    assert got == {(1, 0, 1000, 2), (1, 2001, 3500, 3), (2, 5, 1005, 2), (2, 90_000, 90_000, 1)}


def test_entropy_moves_pairs_once(spark):
    made = catalog.QUERIES["word_entropy"](spark, "/root/testdata/sf0.001")
    # Neither dealt out by document nor written.
    files = made.inputFiles()
    assert len(files) > 0 and all("documents" in f for f in files) and made.count() > 0


def test_offsets_of_texts_of_any_length(spark):
    import re

    texts = [(n, " ".join(("ab", "it's", "c")[i % 3] for i in range(n)) + "." * (n % 3)) for n in (0, 1, 8, 9, 40, 500, 40_000)]
    made = collocations.word_offsets(spark.createDataFrame(texts, "doc_id int, text string"))
    got = {(r["doc_id"], r["word"], r["start"], r["end"]) for r in made.collect()}
    assert got == {(n, m.group(), m.start(), m.end()) for n, t in texts for m in re.finditer("[A-Za-z']+", t)}
    assert made.select("doc_id", "place").distinct().count() == len(got)
    # Blocks are as long as the text needs, no longer.
    assert "sqrt" in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_closure_finds_a_pair_by_its_shortest_paths_alone(spark, monkeypatch):
    r, schema = np.random.default_rng(5), "name string, dependencies array<string>"
    needs = {f"t{i}": [f"t{j}" for j in r.integers(0, 45, r.integers(0, 4))] for i in range(40)} | {"alone": None, "self": ["self", None]}
    want = set()
    for name in needs:
        seen, todo = {name}, [name]
        while todo:
            for m in needs[todo.pop()] or []:
                if m in needs and m not in seen:
                    seen.add(m)
                    todo.append(m)
        want |= {(name, m) for m in seen}
    got = [tuple(x) for x in tools.closure(spark.createDataFrame(list(needs.items()), schema)).collect()]
    assert set(got) == want and len(got) == len(want)

    chain = spark.createDataFrame([(f"t{i}", [f"t{i - 1}"]) for i in range(64)], schema)
    kind, grouped = type(chain), []
    union = kind.unionByName

    def counted(self, other, *rest):
        made = union(self, other, *rest)
        grouped.append(made.count())
        return made

    monkeypatch.setattr(kind, "unionByName", counted)
    assert tools.closure(chain).count() == 64 * 65 // 2
    # Before, 45,760 rows: every pair by each tool between.
    assert max(grouped) <= 64 * 65 // 2 + 64


def test_common_ancestors_of_frames_with_very_many(spark):
    rows = [("Using", "wide", f"w{i}", i) for i in range(2000)] + [("Using", "narrow", "w1999", 2000), ("Using", "narrow", "n", 2001), ("Using", "odd", "o", 2002)]
    relations = spark.createDataFrame(rows, "type string, sub string, super string, ord int")
    asked = spark.createDataFrame([("narrow", "wide"), ("wide", "narrow"), ("odd", "wide"), ("narrow", "odd"), ("wide", "wide"), ("gone", "wide")], "a string, b string")
    made = lexicon.common_ancestors(lexicon.ancestors(relations), asked)
    got = {(r["a"], r["b"]): (r["ancestor"], r["depth_a"], r["depth_b"]) for r in made.collect()}
    assert got == {("narrow", "wide"): ("w1999", 1, 1), ("wide", "narrow"): ("w1999", 1, 1), ("wide", "wide"): ("w0", 1, 1)}
    # Before, every ancestor of the first frame moved on with every pair.
    assert "getbit" in made._jdf.queryExecution().optimizedPlan().toString()


def test_artifacts_files_are_not_gathered(spark):
    lists = spark.createDataFrame([("a", [("x",), (None,), ("x",)]), ("b", []), ("c", None)], "id string, files array<struct<path:string>>")
    apart = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("gone", "y"), (None, "z")], "id string, path string")
    want = sorted(entities.part_candidates(lists, "files", "path").collect())
    assert sorted(entities.apart_candidates(lists, apart, "path").select("id", "value", "source").collect()) == want and len(want) == 2
    plan = catalog.QUERIES["artifact_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Repartition" in plan


def test_report_counts_and_lines_of_a_document_are_grouped_together(spark):
    fragments = spark.createDataFrame([(1, "b", "low"), (1, "a", "skip"), (1, "c", None), (None, "z", "low")], "doc_id int, fragment_id string, value string")
    words = spark.createDataFrame(
        [(1, "a", 2, "y", None, None), (1, "a", 1, "x", "F", "low"), (1, None, 1, "w", None, "high"), (None, "z", 1, "v", "F", "high")],
        "doc_id int, fragment_id string, place int, word string, frame string, confidence string",
    )
    tied = spark.createDataFrame([], "doc_id int, source string, target string, kind string, detail string")
    made = reports.annotation_reports(fragments, words, tied)
    got = {r["doc_id"]: r["report"] for r in made.collect()}
    figures = dict(x.strip("| ").split(" | ") for x in got[1].split("\n") if x.startswith("| ") and x.count("|") == 3)
    assert figures == {"What": "Number", "fragments": "3", "high value": "0", "medium value": "0", "low value": "1", "skip value": "1", "high confidence": "1", "medium confidence": "0", "low confidence": "1", "none confidence": "1"}
    assert "## Fragments\n\n- a x: F; y: -\n" in got[1] and got[1].endswith("## Left out\n\na, b\n") and "## Left out" not in got[None] and "## Frames" not in got[None]
    # Six groupings and five joins before.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 3
