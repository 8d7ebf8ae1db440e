"""The similarity join against all pairs; relations over generated tables against plain walks."""

import random

import pytest

from loomery.operators import lexicon, similarity, store, tools

SCHEMA = "id long, tokens array<string>, n int, rep string, set string"


@pytest.mark.parametrize("least", [0.3, 0.75, 1.0])
def test_pairs_equal_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    words = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["of"] * 20  # two words that nearly all sets have
    rows = [(i, [r.choice(words) for _ in range(r.randint(0, 9))]) for i in range(160)]
    rows += [(200 + i, list(rows[i][1])[::-1]) for i in range(20)] + [(300, None), (301, []), (302, ["a", None, "a"]), (303, ["a"]), (5, rows[5][1])]
    frame = spark.createDataFrame([(*x, 1, "r", "s") for x in rows], SCHEMA)
    sets = {i: frozenset(x for x in t or [] if x is not None) for i, t in rows}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    members, pairs = similarity.similar_sets(frame, least)
    assert {(x["id"], x["rep"]) for x in members.collect()} == set(rep.items())
    reps = sorted(set(rep.values()))
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): like(a, b) for a in reps for b in reps if a < b and like(a, b) >= least - 1e-12}
    got = {(x["a"], x["b"]): x["similarity"] for x in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    links = {x["id"]: x["links"] for x in similarity.joined_classes(members, pairs).collect()}
    assert links == {i: sum(j != i and like(i, j) >= least - 1e-12 for j in rep) for i in rep}
    best = similarity.top_similar(members, pairs, 2).collect()
    assert all(x["place"] <= 2 for x in best) and {x["rep"] for x in best} == {x for p in want for x in p}


def test_frequent_tokens_meet_no_pairs(spark):
    """Sets that share only a word of all sets are not even looked at."""
    rows = [(i, ["the", f"a{i}", f"b{i}", f"c{i}"]) for i in range(400)]
    frame = spark.createDataFrame([(*x, 1, "r", "s") for x in rows], SCHEMA)
    one = similarity.classes(frame)
    own = similarity._tokens_in_order(one.select("rep", "set")).collect()
    assert all(x["tokens"][-1] == "the" for x in own)
    assert similarity.similar_sets(frame, 0.5)[1].count() == 0
    with pytest.raises(ValueError):
        similarity.similar_sets(frame, 0.0)


def test_common_ancestors_of_asked_pairs(spark):
    r = random.Random(4)
    rows = [("Using", f"f{r.randint(0, 30)}", f"f{r.randint(0, 30)}", i) for i in range(90)]
    relations = spark.createDataFrame(rows, "type string, sub string, super string, ord int")
    up = {}
    for _, sub, sup, o in sorted(rows, key=lambda x: x[3]):
        if sub != sup:
            up.setdefault(sub, []).append(sup)

    def walk(f):
        out, path, here = {}, [f], f
        for depth in range(1, 6):
            for a in up.get(here, []):
                out.setdefault(a, depth)
            if here not in up or up[here][0] in path:
                break
            here = up[here][0]
            path.append(here)
        return out

    pairs = {(f"f{a}", f"f{b}") for a in range(0, 31, 2) for b in range(1, 31, 3)}
    asked = spark.createDataFrame(sorted(pairs), "a string, b string")
    got = {(x["a"], x["b"]): (x["depth_a"], x["depth_b"], x["ancestor"]) for x in lexicon.common_ancestors(lexicon.ancestors(relations), asked).collect()}
    want = {(a, b): min((walk(a)[x], walk(b)[x], x) for x in walk(a).keys() & walk(b).keys()) for a, b in pairs if walk(a).keys() & walk(b).keys()}
    assert got == want


def test_listing_and_prefixes(spark):
    rows = [("a", "x" * 60, True), ("b", "y" * 61, True), ("c", "z", False), ("d", None, True), ("e", "e", None)]
    made = {x["name"]: x["description"] for x in tools.listed(spark.createDataFrame(rows, "name string, description string, compliant boolean")).collect()}
    assert made == {"a": "x" * 60, "b": "y" * 60 + "...", "d": ""}
    items = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["a", "b"],), (["z"],), ([],)], "namespace array<string>")
    assert {tuple(x["prefix"]): x["n"] for x in store.namespace_counts(items).collect()} == {("a",): 2, ("a", "b"): 2, ("a", "b", "c"): 1, ("z",): 1}
