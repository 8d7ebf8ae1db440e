"""Language, audit and alignment against brute force; long numbers, parts of runs; sketches and samples term by term."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomery.llm import alignment, audit, fingerprints, flat, language, minhash, pii
from tests.llm.test_operators import EDGE, SCHEMA, _rows, _words

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a  b", "x<|endoftext|>y", "<|endoftext|>", "▁", "a▁b", "é ß 日本 😀\n😀", "\t x\r\n y",
    "a\0b", "１２ ３４", "don't we'll 12,345.67", "x" * 3000, "naïve　full", "👩‍👩‍👧 é", "한국어 ไทย हिन्दी", "foo\nbar baz\nqux.", "  x", "A" * 50 + " " * 9,
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = list(enumerate(ODD)) + EDGE + [(7, "again and again")] * 30 + [(None, "again and again")] * 30
    r = random.Random(3)
    pool = ["the", "The", "of", "in\nthe", "#tag", "USA", "a|b", "naïve", "x1", "über", "don't", "  ", "é"]
    docs += [(500 + i, " ".join(r.choice(pool) for _ in range(r.randint(0, 260)))) for i in range(60)]
    docs += [(600 + i, docs[-1 - i % 7][1]) for i in range(20)]
    return docs


@pytest.fixture(scope="module")
def frame(spark, odd):
    return spark.createDataFrame(_rows(odd), SCHEMA).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3))).repartition(5)


# language


def test_gradients_equal_differences():
    model = language.ByteTagger.blank(["a", "b", "c"], 9, 4)
    for name in ("bytes_", "state", "out", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    r = np.random.default_rng(0)
    read, label = r.integers(0, 256, (9, 5)).astype(np.uint8), r.integers(0, 3, 5)
    _, found = model.gradients(read, label)
    for number, (w, g) in enumerate(zip(model.weights(), found)):
        for _ in range(12):
            at = tuple(r.integers(0, s) for s in w.shape)
            at = (*at[:2], int(read[r.integers(0, 9), r.integers(0, 5)])) if number == 0 else at
            own, two = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = own + step
                two.append(model.gradients(read, label)[0])
            w[at] = own
            assert abs((two[0] - two[1]) / 2e-5 - g[at]) < 1e-8


def _position_means(model, body):
    """The mean probabilities by a plain loop over every byte of every window."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    u, total = model.state.shape[2], np.zeros(len(model.languages))
    for lo in range(0, len(body), model.window):
        own = body[lo : lo + model.window]
        states = []
        for d, order in ((0, own), (1, own[::-1])):
            h, seen = np.zeros(u), []
            for byte in order:
                x, g = model.bytes_[d][:, byte].astype(float), model.state[d].astype(float) @ h
                z, r = sigmoid(x[:u] + g[:u]), sigmoid(x[u : 2 * u] + g[u : 2 * u])
                new = np.tanh(x[2 * u :] + r * g[2 * u :])
                h = (1 - z) * new + z * h
                seen.append(h)
            states.append(seen if d == 0 else seen[::-1])
        for a, b in zip(*states):
            p = np.exp(model.out[0] @ a + model.out[1] @ b + model.bias[:, 0])
            total += p / p.sum()
    return total / max(1, len(body))


def test_scores_equal_a_loop_over_bytes():
    model = language.ByteTagger.blank(["a", "b", "c"], 16, 5)
    texts = ["", "é", "abc", "x" * 16, "y" * 17, "the quick brown fox " * 9, "日本語 😀"]
    column = pa.array(texts)
    got = np.concatenate([model.documents(c) for c in flat.chunks(column)])
    want = np.array([_position_means(model, t.encode()) for t in texts])
    assert np.abs(got - want).max() < 1e-5


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) > 0.97 * len(found)
    # What a text is worth does not depend on the columns that no prediction may use.
    shuffled = docs.withColumn("source", F.lit("x"))
    model = language.train(docs.where(~language.held_out()))
    a = {r["doc_id"]: tuple(r)[1:] for r in language.predict(docs, model).collect()}
    b = {r["doc_id"]: tuple(r)[1:] for r in language.predict(shuffled.drop("lang"), model).collect()}
    assert a == b


def test_languages_of_odd_rows(spark, frame, odd):
    docs = frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "even").when(F.col("doc_id") % 7 == 0, "seven"))
    rows = language.identify(docs, epochs=1, sample=5).collect()
    assert len(rows) == len(odd)
    texts = dict(odd[14 : len(ODD)])  # ids that stand once
    for r in rows:
        if r["doc_id"] in texts:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in ("even", "seven")) == (r["lang_pred"] != "und")
    known = {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] is None}
    assert len(known) == 3  # no text, and two texts
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(none).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0
    one = language.identify(docs.withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in one} == {"xx", "und"}


# audit


def _fails(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))
    }


def test_audit_equals_brute_force(spark, frame, odd):
    labels = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i, _ in odd if i is not None and i % 2] + [(None, 1, 1), (501, None, None), (503, 0, 1), (503, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(frame, table).collect()}
    rows = []
    for i, t in odd:
        t = t or ""
        failed = {f for f, bad in _fails(t).items() if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u in odd):
            failed.add("E")
        part = f"s{i % 3}" if i is not None and i % 5 else ""
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((part, failed, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    want, removed = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + out
                removed[part, f] += len(out)
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                want[part, "".join(order), step] = (len(left), len(out), redundant, alone, sum(r[2] for r in out), sum(r[3] for r in out))
    want = {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert got == want and len(want) == 600 * len({r[0] for r in rows})
    assert audit.audit(frame.limit(0), table).count() == 0
    assert audit.audit(frame, table.limit(0)).agg(F.max("good_lost")).first()[0] == 0


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    texts = ["a b c a bb cc aa", "", "one two six one", "x", "é è é", "same same"] * 3
    monkeypatch.setattr(flat, "hashes", lambda sums, start, end: (end - start).astype(np.uint64) % np.uint64(2))
    for chunk in flat.chunks(pa.array(texts)):
        assert audit.distinct_words(chunk, flat.words(chunk)).tolist() == [len(set(t.split())) for t in texts]


# alignment


def _links(a, b, text_a, text_b, body):
    """(groups, links as (b, a)) of two sides' tokens by their byte ranges."""
    if not body or b"".join(text_a) != body or b"".join(text_b) != body:
        return None
    end_a, end_b = np.cumsum([len(x) for x in text_a]).tolist(), np.cumsum([len(x) for x in text_b]).tolist()
    groups, i, j = [], 0, 0
    at_a, at_b = {end: k for k, end in enumerate(end_a, 1)}, {end: k for k, end in enumerate(end_b, 1)}
    for end in sorted(at_a.keys() & at_b.keys()):
        p, q = at_a[end], at_b[end]
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        i, j = p, q
    spans = lambda ends: list(zip([0, *ends], ends))
    links, first = [], 0
    for x, (lo, hi) in zip(a, spans(end_a)):
        while first < len(b) and end_b[first] <= lo:
            first += 1
        k = first
        while k < len(b) and (end_b[k - 1] if k else 0) < hi:
            links.append((b[k], x))
            k += 1
    return groups, links


def test_alignment_equals_brute_force(spark, frame, odd):
    model, library = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    model.encode_special_tokens = True
    aligner = alignment.Aligner(BYTE, PIECE)
    made = []
    for i, t in odd:
        a = model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = library.encode(t) if t else []
        names = [library.id_to_piece(x) for x in b]
        text_b = [bytes([int(n[3:5], 16)]) if library.is_byte(x) else n.replace("▁", " ").encode() for x, n in zip(b, names)]
        made.append((i, a, b, _links(a, b, [aligner.text_a[x] for x in a], text_b, (" " + t).encode() if t else b"")))
    count = Counter(link for *_, found in made if found for link in found[1])
    best = {}
    for (b, _), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for i, a, b, found in made:
        if found is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        groups, links = found
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        want[i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest] += 1
    assert sum(found is None and bool(t) for (_, t), (*_, found) in zip(odd, made)) >= 2  # the mark itself
    for part in (alignment.PART, 50):  # tokens of B in one part, and dealt into many
        assert Counter(map(tuple, alignment.align(frame, BYTE, PIECE, part_postings=part).collect())) == want
    assert alignment.align(frame.limit(0), BYTE, PIECE).count() == 0


def test_postings_of_pairs_that_are_there_often():
    pairs = [np.array([5] * 600 + [7] * 255 + [9], np.int64).tobytes(), b"", np.array([5, 12, 12], np.int64).tobytes()]
    b, partners, docs, times = alignment.posted(pairs, 6)
    found = Counter()
    for token, p, d, t in zip(b.tolist(), partners.to_pylist(), docs.to_pylist(), times.to_pylist()):
        own = np.frombuffer(p, np.int32).reshape(-1, 2)
        a = np.repeat(own[:, 0], own[:, 1])
        for x, doc, n in zip(a.tolist(), np.frombuffer(d, np.uint16).tolist(), np.frombuffer(t, np.uint8).tolist()):
            found[token * 6 + x, doc] += n
    assert found == {(5, 0): 600, (7, 0): 255, (9, 0): 1, (5, 2): 1, (12, 2): 2}
    assert len(alignment.posted([b""], 6)[0]) == 0


# personal data


def test_digit_runs_of_any_length_and_many_numbers(spark):
    long = ["0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "1.2.3." + "0" * 6000 + "7", "+1" + "2" * 9000, "4 " * 5000]
    for t in long:
        assert [s[1] for s in pii.base_spans(t)] == ([1] if t[0] == "0" or t[:2] == "1." else [])
    many = " ".join(str(100_000 + i * 7919 % 900_000) for i in range(100_000)) + " call +1 (314) 555-4198 or 555-4198"
    docs = spark.createDataFrame(list(enumerate([*long, many, "x " + many])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs, pii.train(docs)).collect()}
    assert got[0]["n_ip"] == 1 and got[5]["n_phone"] == 1 and len(got) == 7
    assert got[5]["spans"].startswith("phone:") and "call [PHONE] or" in got[5]["redacted"]


def test_memory_of_a_graph_is_bounded_by_its_nodes():
    import tracemalloc

    model = pii.SkipChain(np.zeros((pii.FEATURES, 5)), np.eye(5), np.eye(5), 2.0)
    graph, t = pii.Graph(), "123456 " * 60_000
    tracemalloc.start()
    graph.add(0, t, pii.base_spans(t))
    model.marginals(graph)
    assert tracemalloc.get_traced_memory()[1] < 2500 * 60_000
    tracemalloc.stop()


def test_numbers_side_by_side_are_found_in_parts(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    texts = {
        "it is 4111111111111111 5500000000000004 then": ["card:6:22", "card:23:39"],
        "pay 4111 1111 1111 1111 5500 0000 0000 0004 now": [],
        "call +1 (826) 555-4081 190.137.223.204 du": ["phone:5:22", "ip:23:38"],
        "call +1 (826) 555-4081 4111111111111111 du": ["phone:5:22", "card:23:39"],
        "no 4111111111111112 5500000000000005 card": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs, model).collect():
        want = list(texts.values())[r["doc_id"]]
        if r["doc_id"] == 1:
            assert pii.runs_in_parts(list(texts)[1]) == {4: 23, 24: 43}
        else:
            assert sorted(filter(None, r["spans"].split(","))) == sorted(want)


def test_parts_of_a_run_equal_all_cuts():
    r = random.Random(6)
    for _ in range(400):
        run = " ".join("".join(r.choice("0123456789") for _ in range(r.choice((3, 4, 4, 6, 16)))) for _ in range(r.randint(1, 9)))
        words = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]

        def ways(i):
            if i == len(words):
                return [[]]
            return [[(words[i][0], words[j][1]), *rest] for j in range(i, len(words)) if pii.card_form(run[words[i][0] : words[j][1]]) for rest in ways(j + 1)]

        got, every = pii.card_parts(run), ways(0)
        assert got in every if every else got == []


# sketches and samples


def test_pairs_at_the_bound_meet_in_a_band():
    """Sets at a similarity of exactly three quarters share one of 32 bands of 4 coordinates."""
    r = np.random.default_rng(12)
    missed = 0
    for size in (7, 14, 70, 350):
        sets, edge = [], [0]
        for _ in range(250):
            own = r.integers(0, 2**63, size, dtype=np.uint64)
            shared = 6 * size // 7
            a, b = own, np.concatenate([own[:shared], r.integers(0, 2**63, size - shared, dtype=np.uint64)])
            assert 100 * shared == 75 * (2 * size - shared)
            for x in (a, b):
                sets.append(np.sort(x))
                edge.append(edge[-1] + len(x))
        sketch = minhash.fast_similarity_sketch(np.concatenate(sets), np.array(edge), 128)
        bands = sketch.reshape(len(sets) // 2, 2, 32, 4)
        missed += int((~(bands[:, 0] == bands[:, 1]).all(axis=2).any(axis=1)).sum())
    assert missed == 0


def test_signatures_equal_a_sampler_of_single_terms(spark):
    """Each text's samples by a loop over its terms; near_edited and near_next by the printed ones."""
    sampler = fingerprints.Sampler()
    texts = [t for _, t in EDGE if t and len(t) < 5000] + [_words(40, 30), "Aa aA aa b", "b aa AA Aa"]

    def alone(t):
        column = pa.array([t])
        (chunk,) = flat.chunks(column)
        spans = flat.words(chunk)
        hashed = flat.hashes(flat.running(chunk, True), spans.start, spans.end).tolist()
        least = [None] * fingerprints.SAMPLES
        for h, n in Counter(hashed).items():
            at = hashed.index(h)
            weight = n * float(spans.end[at] - spans.start[at]) ** 2
            row = sampler.ranks(np.array([h], np.uint64), np.array([weight]))[0].tolist()
            least = [x if y is None else min(x, y) for x, y in zip(row, least)]
        return [0 if x is None else x & 0xFFFF for x in least]

    got = fingerprints.Sampler().of(texts)
    assert got.tolist() == [alone(t) for t in texts]
    assert got[-1].tolist() == got[-2].tolist()

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs).collect()}
    order = sorted(rows, reverse=True)
    words = lambda t: bool(t.strip(" \t\n\x0b\x0c\r"))

    def likeness(a, b):
        x, y = alone(a), alone(b)
        return float(words(a) == words(b)) if not (words(a) and words(b)) else sum(p == q for p, q in zip(x, y)) / len(x)

    for i, (own, after) in enumerate(zip(order, order[1:] + order[:1])):
        t, u = texts[own], texts[after]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = rows[own]
        assert r["edited"] == edited and r["fingerprint"] == fingerprints.printed(np.array(alone(t), np.uint16))
        assert abs(r["near_edited"] - likeness(t, edited)) < 1e-12 and abs(r["near_next"] - likeness(t, u)) < 1e-12
