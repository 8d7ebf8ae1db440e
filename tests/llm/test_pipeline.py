"""The pipeline's stages on their own inputs, against brute-force versions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomery.llm import flat, pii, quality
from tests.llm.test_operators import _dedup_brute, _groups, _words

#: With columns named like the operators' own ones.
COLUMNS = (
    "doc_id long, score string, text string, lang string, source string, n_chars int, redacted int, spans string, `a.b` double, copy int, "
    "row string, base string, id long, part string, kept boolean, label int"
)


def _row(i, t):
    return (i, "s", t, "en", "s", len(t or ""), 7, "x", 0.5, 3, "r", "b", 1, "p", True, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    docs = [(i, "\n".join(_words(i * 10 + k, 30) for k in range(3))) for i in range(150)]
    docs += [(200 + i, " ".join(w + "###" for w in _words(900 + i, 60).split())) for i in range(80)]
    for i in range(20):  # near copies: most words of one line changed, so that lines differ and documents stay alike
        words = docs[i][1].split(" ")
        at = r.randrange(len(words) - 12)
        words[at : at + 6] = [f"new{r.randint(0, 999)}" for _ in range(6)]
        docs.append((300 + i, " ".join(words)))
    docs += [(400, None), (401, ""), (None, _words(77, 60)), (402, "mail a.b@example.org or +1 (314) 555-4198 today " + _words(78, 50)), (402, _words(79, 50)), (402, _words(79, 50))]
    docs += [(None, _words(77, 60))] * 4 + [(None, None)] * 2
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([_row(i, t) for i, t in docs], COLUMNS).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(200 + i, 0, 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def _pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages_one_after_the_other(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "pii", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    kept = stage["quality_classifier"](spark, docs, folder)
    assert kept.columns == docs.columns
    left = {i for i, _ in _pairs(kept)}
    assert set(range(150)) <= left and not left & set(range(200, 280))

    lined = stage["line_dedup"](spark, docs, folder)
    once = [(i, t) for i, t in _pairs(docs.where("doc_id < 400"))]
    want = _dedup_brute(once)
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in lined.collect()]
    got = {i: t for i, t, _ in rows if i is not None and i < 400}
    assert got == want and len(rows) == docs.count()
    assert all(n == len(t) for _, t, n in rows if t is not None)
    assert sorted(t for i, t, _ in rows if i == 402)[0] == ""  # the repeated row
    assert {tuple(r)[6:] for r in lined.collect()} == {_row(0, "")[6:]}

    alone = stage["near_dedup"](spark, docs, folder)
    groups = _groups(_pairs(docs))
    ids = [i for i, _ in _pairs(alone)]
    assert {i for i in ids if i is not None} == {i for i, least in groups.items() if i == least}
    assert ids.count(402) == 2 and ids.count(None) == 2  # its two texts; the two texts without an id
    assert any(i >= 300 for i in groups if groups[i] != i)

    assert alone.columns == docs.columns and {r["redacted"] for r in alone.collect()} == {7}

    clean = stage["pii"](spark, docs, folder)
    assert clean.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and {r["a.b"] for r in clean.collect()} == {0.5}
    assert not any(pii.base_spans(t) for _, t in _pairs(clean) if t)
    assert any("[EMAIL]" in t and "[PHONE]" in t for i, t in _pairs(clean) if i == 402)
    assert {i for i, _ in _pairs(clean)} == {i for i, _ in _pairs(docs)}

    assert stage["packing"](spark, docs, folder).agg({"length": "sum"}).first()[0] > 0


def test_run_carries_decisions_through(spark, folder):
    placed = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in placed}
    assert not ids & set(range(200, 280)) and set(range(20)) <= ids


def _best_fit(lengths, window=1024):
    """How many windows best-fit decreasing takes, by the plain algorithm."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(window - n)
    return len(free)


def test_run_equals_the_stages_by_brute_force(spark, tmp_path):
    r = random.Random(8)
    docs = [(i, "\n".join(_words(i * 10 + k, r.randint(60, 200)) for k in range(4))) for i in range(60)]
    docs += [(200 + i, " ".join(w + "###" for w in _words(900 + i, 60).split())) for i in range(40)]
    for i in range(12):  # two words of every line changed: the lines stay, the documents are alike
        lines = [line.split(" ") for line in docs[i][1].split("\n")]
        for words in lines:
            for at in (3, 20):
                words[at] = f"new{r.randint(0, 999)}"
        docs.append((300 + i, "\n".join(map(" ".join, lines))))
    docs += [(400 + i, f"call +1 (314) 555-{4100 + i} or 10.1.2.{i} then 555-{4100 + i} " + _words(700 + i, 60)) for i in range(20)]
    root = str(tmp_path)
    frame = lambda rows: spark.createDataFrame([_row(i, t) for i, t in rows], COLUMNS)
    frame(docs).write.parquet(f"{root}/documents.parquet")
    labels = spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/labels.parquet")

    model = quality.train(frame(docs), labels.where(~quality.held_out()))
    scores = np.concatenate([model.score(c) for c in flat.chunks(pa.array([t for _, t in docs]))])
    kept = [d for d, s in zip(docs, scores) if s >= 0.5]
    lined = sorted(_dedup_brute(kept).items())
    least = _groups(lined)
    alone = [(i, t) for i, t in lined if least[i] == i]
    chain, clean = pii.train(frame(alone)), []
    for i, t in alone:
        graph, base = pii.Graph(), pii.base_spans(t)
        graph.add(0, t, base)
        clean.append((i, pii.redacted(t, base + pii.added_spans(graph, chain, 0.9).get(0, []))))
    tokens, want, lengths = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), []
    for i, t in clean:
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            own = np.array(ids[at : at + 1024], "<u4")
            want[i, at, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
            lengths.append(len(own))
    assert len(clean) < len(kept) < len(docs) and any("[PHONE]" in t for _, t in clean)

    got = corpus_pipeline.run(spark, root).collect()
    assert Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got) == want
    filled = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert filled.get(x["sequence_id"], 0) == x["offset"]
        filled[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(filled.values()) <= 1024 and sorted(filled) == list(range(_best_fit(lengths)))
