"""Further forms of personal data, packing and line tests: long, repeated, unnamed and negative rows."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomery.llm import linededup, packing, pii
from tests.llm.test_operators import EDGE, SCHEMA, _dedup_brute, _rows

PAIRS = [
    ("+1 (314) 555-4198", "555-4198"), ("+13145554198", "3145554198"), ("+1 (314) 555-4198", "314-555-4198"), ("+1 314 5554198", "5554198"),
    ("+13145554198", "(314)555-4198"), ("4111111111111111", "11111111111"),
]


def test_repeats_without_prefix_are_found_with_learned_weights(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = [t for full, part in PAIRS for t in (f"call {full} now. Again: {part} please", f"first {part} then {full} please", f"it is {full} or" + f" call {part} now" * 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs, model).collect():
        part = PAIRS[r["doc_id"] // 3][1]
        assert part not in r["redacted"], r["redacted"]
        full = r["spans"].split(",")
        assert {x.split(":")[0] for x in full} == {"phone" if r["doc_id"] < 15 else "card"}


def test_other_numbers_and_short_parts_are_not_repeats():
    for other in ("8885554198", "3145554199", "4198", "2024"):
        graph, text = pii.Graph(), f"call +13145554198 or {other}"
        graph.add(0, text, pii.base_spans(text))
        assert graph.repeat == []


def test_sequences_hold_null_ids_and_repeated_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = EDGE + [(None, "no id here")] * 2 + [(7, "again and again")] * 300
    docs = spark.createDataFrame(_rows(rows), SCHEMA).repartition(3)
    placed = packing.pack(docs, path)
    made = {r["sequence_id"]: r["ids"][: r["filled"]] for r in packing.sequences(docs, placed, path).collect()}
    model = Tokenizer.from_file(path)
    want = sorted(model.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows)
    documents = {}
    for i, r in enumerate(sorted(placed.collect(), key=lambda r: (r["sequence_id"], r["offset"]))):
        ids = made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert len(ids) == r["length"]
        whole = r["length"] == r["doc_tokens"]
        documents.setdefault((i, None) if whole else r["doc_id"], []).append((r["start"], ids))
    assert sorted(sum((ids for _, ids in sorted(own)), []) for own in documents.values()) == want
    assert sum(map(len, made.values())) == sum(map(len, want))


def test_pieces_are_numbered_in_parts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i if i % 3 else None, "one two three") for i in range(900)], "doc_id long, text string")
    for part_rows in (100_000, 7):
        rows = packing.pack(docs, path, part_rows=part_rows).collect()
        assert len(rows) == 900 == len({(r["sequence_id"], r["offset"]) for r in rows})
        used = Counter()
        for r in rows:
            used[r["sequence_id"]] += r["length"]
        assert max(used.values()) <= 1024 and sorted(used)[-1] == len(used) - 1 == -(-900 // (1024 // rows[0]["length"])) - 1


def test_propagation_is_exact_on_trees_and_near_on_loops():
    """Marginals against the sum over all labellings."""
    import itertools

    r = np.random.default_rng(4)
    labels = len(pii.KINDS) + 1
    for loop in (False, True):
        for _ in range(6):
            n = 5
            graph = pii.Graph(
                features=r.integers(0, 2, (n, pii.FEATURES)).astype(float).tolist(), fixed=[-1] * n, spans=[(i, i + 1) for i in range(n)],
                doc=[0] * n, chain=[(0, 1), (1, 2)], skip=[(1, 3), (3, 4)] + ([(0, 4)] if loop else []),
            )
            graph.fixed[4] = 2
            scale = 0.3 if loop else 1.0
            skip = r.normal(0, scale, (labels, labels))
            model = pii.SkipChain(r.normal(0, scale, (pii.FEATURES, labels)), r.normal(0, scale, (labels, labels)), skip + skip.T)
            unary = np.array(graph.features) @ model.words
            total = np.zeros((n, labels))
            for y in itertools.product(range(labels), repeat=n):
                if y[4] == 2:
                    s = sum(unary[i, y[i]] for i in range(4)) + sum(model.chain[y[a], y[b]] for a, b in graph.chain)
                    weight = np.exp(s + sum(model.skip[y[a], y[b]] for a, b in graph.skip))
                    for i in range(n):
                        total[i, y[i]] += weight
            want = total / total.sum(axis=1, keepdims=True)
            got = model.marginals(graph, rounds=60)
            assert np.abs(got - want).max() < (0.1 if loop else 1e-6)


def test_skip_weights_are_learned_from_partners_alone(spark):
    """The same kind at both ends is worth more than any other, whatever the words look like."""
    mails = [(i, f"write to ana.{i}@mail.example.com now or ana.{i}@mail.example.com later, room {i % 90}") for i in range(200)]
    cards = [(1000 + i, f"from 10.{i}.2.3 to 10.{i}.2.3 in {i}") for i in range(200)]
    model = pii.train(spark.createDataFrame(mails + cards, "doc_id long, text string"), sample=400)
    for kind in (1, 2):
        assert model.skip[kind, kind] > max(model.skip[kind, other] for other in range(len(pii.KINDS) + 1) if other != kind)


def test_repeats_of_an_unlabelled_number_are_no_evidence():
    """The probabilities of a number that no pattern knows do not grow with its copies."""
    r = np.random.default_rng(2)
    skip = 3 * np.eye(len(pii.KINDS) + 1)
    model = pii.SkipChain(r.normal(0, 0.3, (pii.FEATURES, len(pii.KINDS) + 1)), np.zeros_like(skip), 40 * skip)
    got = []
    for copies in (1, 2, 9):
        graph, text = pii.Graph(), "so 5927243074273352 went on " * copies
        assert pii.base_spans(text) == []
        graph.add(0, text, [])
        got.append(model.marginals(graph, rounds=60)[0])
    assert np.abs(got[0] - got[1]).max() < 1e-3 and np.abs(got[0] - got[2]).max() < 1e-3


def test_training_takes_one_row_an_id(spark):
    rows = [(7, f"call +1 (314) 555-{i:04d} now") for i in range(3000)] + [(8, "ip 10.2.3.4 here 5")]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"), sample=5)
    assert model.words.any()


def test_lines_of_rows_without_an_id_are_told_apart(spark):
    """Texts by the ten thousand share no id; each is a row of its own."""
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("unique line number "), F.col("id")).alias("text"))
    made = linededup.dedup_lines(rows)
    assert made.where("text = ''").count() == 0 and made.distinct().count() == 100_000


def test_lines_of_negative_and_repeated_ids(spark):
    r = random.Random(9)
    line = lambda: " ".join(r.choice("abcdef") for _ in range(r.randint(7, 10)))
    docs = [(i, "\n".join(line() for _ in range(4))) for i in (-(2**63), -5, -1, 0, 3, 2**63 - 1)]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _dedup_brute(docs)
    same = [(5, "one line\ntwo"), (5, "two\nthree"), (5, "one line\ntwo")]
    texts = [x["text"].split("\n") for x in linededup.dedup_lines(spark.createDataFrame(same, "doc_id long, text string")).collect()]
    assert Counter(x for t in texts for x in t if x) == Counter(["one line", "two", "three"]) and len(texts) == 3


def test_a_document_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 150_000}" for i in range(200_000))
    (row,) = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts_as="n").collect()
    assert row["n"]["n_lines"] == 200_000 and row["n"]["n_dropped"] == 50_000
    assert row["text"] == "\n".join(f"line {i}" for i in range(150_000))


def test_near_lines_where_the_two_ways_to_hash_meet(spark):
    """Lines about as long as the bound between copied and summed variants."""
    size = linededup._SHORT
    docs, at = [], 0
    for n in (size - 1, size, size + 1, size + 2, 2 * size):
        words = [f"w{n}x{j}" for j in range(n)]
        more, other = words[:7] + ["put in"] + words[7:], words[: n - 3] + ["else"] + words[n - 2 :]
        far = words[:3] + ["p"] + words[4 : n - 3] + ["q"] + words[n - 2 :]
        for w in (words, more, other, far):
            docs.append((at, " ".join(w).replace("put in", "put")))
            at += 1
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _dedup_brute(docs)
    assert sum(t == "" for t in got.values()) >= 10


def test_log_lines_that_share_one_variant(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("at noon the host "), "id", F.lit(" had no answer from any other")).alias("text"))
    made = linededup.dedup_lines(rows, key="id").where("text <> ''").collect()
    assert [x["id"] for x in made] == [0]
