"""Each operator against a brute-force version, on edge cases and random texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomery.llm import (
    components, fingerprints, flat, linededup, measures, minhash, packing, pieces, pii, quality, rules, sharding, urls,
)

SCHEMA = "doc_id long, text string, lang string, shard int, id long, t string, score double, part int, k string, kept boolean"


def _rows(pairs):
    return [(i, t, "en", 1, 2, "x", 0.5, 3, "k", True) for i, t in pairs]


def _words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 400)) for _ in range(n))


BASE = _words(1, 80)
EDGE = [
    (None, "no id here"), (None, None), (1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (5, _words(2, 30_000)), (6, BASE), (6, BASE),
    (7, BASE), (8, BASE + " tail"), (9, _words(3, 80)), (10, "é ß 日本 😀\n" * 5), (11, "a b c d"), (12, "A B C D"), (13, "x" * 3000),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(_rows(EDGE), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# sharding


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_scalar_law_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump(keys, n).tolist() == [_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b].tolist()) == {16}
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_shard_slots_are_gapless_and_sizes_right(edge, nothing):
    got = sharding.shard(edge, 4, buckets=8).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in EDGE)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(nothing, 4).count() == 0


# near-duplicates


def _shingles(text, width=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [x.lower() for x in w]  # bytes.lower folds A-Z alone
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def _groups(docs):
    sets = [(i, _shingles(t)) for i, t in docs if i is not None]
    least = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return least


def test_near_duplicates_equal_brute_force(spark, edge, nothing):
    r = random.Random(5)
    docs = list(EDGE)
    for g in range(12):
        words = _words(100 + g, 60).split()
        for c in range(6):
            own = list(words)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(60)] = f"edit{r.randint(0, 99)}"
            docs.append((1000 + g * 10 + c, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(_rows(docs), SCHEMA)).collect()
    want = _groups(docs)
    assert len(got) == len(docs)
    for row in got:
        if row["doc_id"] is not None:
            assert row["component_id"] == want[row["doc_id"]]
            assert row["kept"] == (row["doc_id"] == row["component_id"])
    sizes = Counter((i, len(_shingles(t))) for i, t in docs)
    assert Counter((x["doc_id"], x["n_shingles"]) for x in got) == sizes
    assert minhash.near_duplicates(nothing).count() == 0


def test_links_between_blocks_equal_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(60) < 0.9], r.integers(0, 2**62, r.integers(1, 9), dtype=np.uint64)])) for _ in range(40)]
    label, block = r.integers(0, 6, 40), r.integers(0, 2, 40)
    for across in (False, True):
        got = minhash.links_between(label, block, sets, 75, across)
        have = {frozenset((label[a], label[b])) for a, b in got}
        want = set()
        for i in range(40):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                linked = 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)
                if linked and label[i] != label[j] and (not across or block[i] != block[j]):
                    want.add(frozenset((label[i], label[j])))
        assert have == want
        for a, b in got:
            assert label[a] != label[b]


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    r = np.random.default_rng(2)
    shared = r.integers(0, 2**62, 300, dtype=np.uint64)
    a = np.unique(np.concatenate([shared, r.integers(0, 2**62, 50, dtype=np.uint64)]))
    b = np.unique(np.concatenate([shared, r.integers(0, 2**62, 50, dtype=np.uint64)]))
    one = shared[:1]
    sketch = minhash.fast_similarity_sketch(np.concatenate([a, b, one]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]), 256)
    assert (sketch != np.uint64(2**64 - 1)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.75) < 0.1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# fingerprints


def test_fingerprints_of_edits_and_order(edge, nothing):
    got = {}
    for r in fingerprints.compare_with_edits(edge).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(EDGE)
    ids = sorted({i for i, _ in EDGE if i is not None}, reverse=True)
    text = dict(EDGE)
    for i, j in zip(ids, ids[1:]):
        own, after = text[i] or "", text[j] or ""
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert edited in {r["edited"] for r in got[i]} and got[i][0]["n_chars"] == len(own)
        assert 0 <= got[i][0]["near_edited"] <= 1 and 0 <= got[i][0]["near_next"] <= 1
    assert got[6][0]["fingerprint"] == got[7][0]["fingerprint"]
    assert any(r["near_next"] == 1.0 for r in got[7])
    assert fingerprints.compare_with_edits(nothing).count() == 0


def test_sampling_rate_follows_weighted_jaccard():
    sampler = fingerprints.Sampler(samples=512)
    a = Counter({f"word{i}": 1 + i % 4 for i in range(120)})
    b = Counter({f"word{i}": 1 + (i // 2) % 4 for i in range(40, 160)})
    made = sampler.of([" ".join(c.elements()) for c in (a, b)])
    weigh = lambda c, w: c[w] * len(w) ** 2
    every = set(a) | set(b)
    want = sum(min(weigh(a, w), weigh(b, w)) for w in every) / sum(max(weigh(a, w), weigh(b, w)) for w in every)
    assert abs((made[0] == made[1]).mean() - want) < 0.08


# quality


def test_classifier_learns_and_scores_everything(spark, edge, nothing):
    good = [(i, _words(i, 60)) for i in range(100, 220)]
    bad = [(i, " ".join(w + "%%%" for w in _words(i, 60).split())) for i in range(220, 340)]
    docs = spark.createDataFrame(_rows(good + bad + EDGE), SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels, sample=60, bits=10).collect()
    assert len(got) == 240 + len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 100]
    assert held and np.mean([r["predicted"] == int(r["doc_id"] < 220) for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    none = labels.where("false")
    assert {r["score"] for r in quality.classify(edge, none).collect()} == {0.5}
    assert quality.classify(nothing, none).count() == 0


def test_sum_of_squares_identity_equals_all_pairs():
    r = np.random.default_rng(4)
    n = len(quality.STATISTICS)
    model = quality.FactorisationMachine(3, 0.2, r.normal(size=8 + n), r.normal(size=(8 + n, 4)), np.zeros(n), np.ones(n))
    bucket, value, scaled = np.array([1, 4, 6]), np.array([0.5, 1.0, 0.25]), r.normal(size=(1, n))
    x = np.zeros(8 + n)
    x[bucket], x[8:] = value, scaled[0]
    want = 0.2 + model.weights @ x + sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(8 + n) for j in range(i))
    assert np.isclose(model.margin(bucket, value, np.array([0, 3]), scaled)[0][0], want)


# personal data


def _brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns_equal_plain_regexes():
    r = random.Random(3)
    parts = ["a", "@", "b.c", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "x@y.z", "é", "\n", "%", "1.2.3.4", "+1 (314) 555-4198", "@@"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == _brute_spans(t), t
    for hard in ("a" * 20_000 + "@", "1" * 20_000, "+1" + "(" * 20_000):
        pii.base_spans(hard)


def test_skip_links_add_repeats_and_keep_base_spans(spark, edge, nothing):
    phones = [(i, f"call +1 (314) 555-{i:04d} now. Again: 555-{i:04d} please, version 2.0 of {i % 7}. Or +1 (314) 555-{i:04d}.") for i in range(1000, 1300)]
    docs = spark.createDataFrame(_rows(phones + EDGE), SCHEMA)
    model = pii.train(docs, sample=200)
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect() if r["doc_id"] is not None}
    for i, t in phones:
        base = got[i]["base"].split(",")
        assert base == [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in _brute_spans(t)]
        assert set(base) <= set(got[i]["spans"].split(",")) and got[i]["n_phone"] == 2
        assert "(314)" not in got[i]["redacted"] and "[PHONE]" in got[i]["redacted"]
    added = sum(got[i]["spans"] != got[i]["base"] for i, _ in phones)
    assert model.skip[4, 4] > model.skip[4, 0]
    assert added > 250  # the repeat without its prefix
    assert got[9]["spans"] == "" and got[1]["redacted"] is None and got[2]["redacted"] == ""
    assert pii.find(edge, pii.SkipChain.blank()).count() == len(EDGE)
    assert pii.find(nothing, pii.train(nothing)).count() == 0


# rules


def test_measurements_and_ledger(edge, nothing):
    got = {}
    for r in rules.verdicts(rules.ledger(edge)).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in dict(EDGE).items():
        if i is None:
            continue
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if seen[x] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][n] for n in measures.NAMES[:5]) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert rules.ledger(nothing).count() == 0


def test_ablation_counts_what_a_rule_alone_rejects(edge):
    book = rules.ledger(edge).cache()
    rows = {r["rule"]: r for r in rules.ablation(book, "v1").collect()}
    bits = [r["failed"] & rules.mask_of("v1") for r in book.collect()]
    for n, rule in enumerate(rules.RULES):
        if rule in rows:
            assert rows[rule]["failing"] == sum(bool(b >> n & 1) for b in bits)
            assert rows[rule]["only_this"] == sum(b == 1 << n for b in bits)
            assert rows[rule]["rejected"] == sum(b > 0 for b in bits)


# URL rules


def test_url_rules_equal_a_nested_loop(spark):
    r = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "com", "b.com", "EXAMPLE.ORG", "x.b.com", ""]
    paths = ["", "/", "/en/1", "/en/12", "/es/", "/fr/x?y=1", "/a#b"]
    pages = [(i, f"http://{r.choice(hosts)}{r.choice(paths)}", "x") for i in range(400)]
    pages += [(400, None, "x"), (401, "no scheme", "x"), (None, "https://org/", "x"), (402, "://", "x"), (402, "://", "x")]
    listed = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("b.com", "", "block"), ("com", "/fr/", "allow"), (None, "/", "block")]
    frame = spark.createDataFrame(pages, "page_id long, url string, host string")
    rule_frame = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = urls.filter_urls(frame, rule_frame, parts=5).collect()
    want = []
    for i, u, _ in pages:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
            host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in listed if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((i, host, path, best[2], best[3]))
    assert Counter(map(tuple, got)) == Counter(want)
    empty = spark.createDataFrame([], frame.schema)
    assert urls.filter_urls(empty, rule_frame, parts=2).count() == 0
    assert {x["verdict"] for x in urls.filter_urls(frame, rule_frame.where("false"), parts=2).collect()} == {"allow"}


# pieces


def test_piece_rounds_equal_the_library(edge, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    parts = ["a", "b", "the", "in", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "xxxxx", "<s>", "</s>", "<0x0A>", "12", "ababababab", "%%%", "\x00", "\r\n"]
    vocab = list(own.ids)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)]
    texts += ["".join(r.choice(vocab) for _ in range(r.randint(1, 12))) for _ in range(800)]
    texts += ["".join(r.choice("aeinst") for _ in range(r.randint(1, 90))) for _ in range(400)] + [" " * 60, "a" * 500, "ab" * 300, "aaab" * 80]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids), t
        unit = ("▁" + t).replace(" ", "▁")
        if "\n" not in t and t:  # the long units' way, on short ones
            assert own.merge_long(unit).tolist() == np.concatenate(own.merge([unit])).tolist(), t
    letters = "".join(r.choice("etaoinshrdlu") for _ in range(40_000))
    for t in (letters, "日本語の文章です" * 4000, "ab" * 5000 + "a" * 5001, "".join(r.choice(vocab).strip("▁") for _ in range(6000))):
        assert own.encode(t) == library.encode(t)
    got = {}
    for row in pieces.encode_documents(edge, path).collect():
        got.setdefault(row["doc_id"], row)
    for i, t in dict(EDGE).items():
        ids = library.encode(t or "", add_eos=True)
        assert got[i]["ids"] == " ".join(map(str, ids)) and got[i]["n_tokens"] == len(ids) or i is None
        assert i is None or got[i]["decoded"] == library.decode(library.encode(t or ""))
    assert pieces.encode_documents(nothing, path).count() == 0


# lines


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def _dedup_brute(docs, near=8):
    first, order = {}, []
    for d, t in sorted(docs):
        for n, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\x0b\x0c\r") and line not in first:
                first[line] = (d, n)
                order.append(line)
    toks = {x: x.split(" ") for x in order}
    keep = {
        x for x in order
        if len(toks[x]) < near or not any(len(toks[y]) >= near and first[y] < first[x] and _near(toks[x], toks[y]) for y in order)
    }
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" \t\n\x0b\x0c\r") or (x in keep and first[x] == (d, n))) for d, t in docs}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(11)
    pool = [_words(i, r.randint(1, 14)) for i in range(25)]

    def line():
        w = r.choice(pool).split(" ")
        kind = r.random()
        if kind < 0.3:
            w[r.randrange(len(w))] = f"new{r.randint(0, 5)}"
        elif kind < 0.45:
            w.insert(r.randint(0, len(w)), f"put{r.randint(0, 5)}")
        elif kind < 0.6 and len(w) > 1:
            del w[r.randrange(len(w))]
        return " ".join(w)

    docs = [(i, "\n".join(r.choice(["", " ", line(), line(), line()]) for _ in range(r.randint(1, 8)))) for i in range(120)]
    docs += [(200, ""), (201, "x" * 5000), (202, " ".join(map(str, range(5000)))), (203, " ".join(map(str, range(4999))))]
    got = linededup.dedup_lines(spark.createDataFrame(_rows(docs), SCHEMA)).collect()
    want = _dedup_brute(docs)
    assert {x["doc_id"]: x["text"] for x in got} == want
    assert want[203] == "" and any(len(want[d]) < len(t) for d, t in docs[:120])


def test_line_dedup_of_edge_rows(edge, nothing):
    got = linededup.dedup_lines(edge, counts_as="lines")
    assert got.columns == [*edge.columns, "lines"]
    rows = got.collect()
    assert len(rows) == len(EDGE)
    texts = Counter((r["doc_id"], r["text"]) for r in rows)
    assert texts[(6, BASE)] == 1 and texts[(6, "")] == 1 and texts[(7, "")] == 1  # the copy and the repeated row
    assert texts[(1, None)] == 1 and texts[(3, " \n\t \n")] == 1
    assert linededup.dedup_lines(nothing).count() == 0


# packing


def test_best_fit_decreasing_equals_the_plain_algorithm():
    import bisect

    r = random.Random(2)
    for window, n in ((16, 200), (64, 500), (1024, 800)):
        histogram = Counter(r.randint(1, window) for _ in range(n))
        fill = Counter()
        runs = {}
        for run in packing.best_fit_decreasing(dict(histogram), window):
            runs.setdefault(run[0], []).append(run)
        for length, count in histogram.items():
            ends = [x[1] for x in runs[length][1:]] + [count]
            for (_, first, per, at, offset), end in zip(runs[length], ends):
                for j in range(end - first):
                    fill[at + j // per] += length
                    assert offset + (j % per + 1) * length <= window
        left, opened = [], 0
        for item in sorted(histogram.elements(), reverse=True):
            i = bisect.bisect_left(left, item)
            if i < len(left):
                room = left.pop(i)
            else:
                room, opened = window, opened + 1
            bisect.insort(left, room - item)
        assert len(fill) == opened and sorted(window - x for x in fill.values()) == left


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.Tokens(path), Tokenizer.from_file(path)
    r = random.Random(1)
    parts = ["a", "the", "in", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "'ll", "<|endoftext|>", "12", "²", "Ⅷ", "%%%", "\x00", "\r\n", "\x1c", "\x85", "　", "א", "가", ".", ",", "١"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):  # cold and warm
        for t, body in zip(texts, own.ids(texts)):
            assert np.frombuffer(body, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert 50256 in plain.encode("a <|endoftext|> b", add_special_tokens=False).ids
    long = ["x7" * 200_000, "日本語の文" * 50_000, "a <|endoftext|>" + "b" * 1000]
    for t, body in zip(long, own.ids(long)):
        assert np.frombuffer(body, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(edge, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    placed = packing.pack(edge, path)
    got = placed.collect()
    model = packing.Tokens(path).model
    ids = [model.encode(t or "", add_special_tokens=False).ids + [0] for _, t in EDGE]
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    one = {r["start"]: r for r in got if r["doc_id"] == 5}
    want = ids[[i for i, _ in EDGE].index(5)]
    for start, r in one.items():
        assert zlib.crc32(np.array(want[start : start + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want)
    unique = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    made = packing.sequences(unique, packing.pack(unique, path), path).collect()
    assert all(len(r["ids"]) == 1024 or len(r["ids"]) == r["filled"] and r["filled"] & (r["filled"] - 1) == 0 for r in made)
    assert packing.pack(nothing, path).count() == 0


def test_flat_words_and_hashes():
    column = pa.array(["a  b", None, "", "ab\ncd é", "b"])
    spans, hashed = [], []
    for chunk in flat.chunks(column, limit=4):
        s = flat.words(chunk)
        h = flat.hashes(flat.running(chunk, True), s.start, s.end)
        spans += [bytes(chunk.data[a:b]).decode() for a, b in zip(s.start, s.end)]
        hashed += h.tolist()
    assert spans == ["a", "b", "ab", "cd", "é", "b"]
    assert hashed[1] == hashed[5] and len(set(hashed)) == 5
    assert hashlib.sha256(b"").hexdigest()
