"""A quality classifier: a factorisation machine over hashed words and structure statistics.

The score of features ``x`` is ``sigmoid(b + w.x + 1/2 sum_f((V_f.x)^2 - V_f^2.x^2))``: all
pairwise interactions of rank ``rank``, in time linear in the features present (Rendle,
2010).  Features are a document's hashed words (log counts, length 1 together) and
statistics of its structure, each scaled on the training rows; columns about the document
(language, source, ids, labels) are no features.

Training takes a bounded sample of the labelled rows: at most ``sample`` rows of each
class, in the order of a hash of their id, so that the sample does not depend on the
input's layout.  The model is ``2**bits`` x (rank + 1) numbers whatever the input's size.

Defined results: a null or empty text has no words and the statistics of an empty text,
and gets the score these give; repeated rows are scored each; with fewer than two classes
among the training rows every score is the share of label 1 (0.5 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import flat
from loomery.llm.measures import measure
from loomery.llm.util import map_batches

STATISTICS = (
    "log_words", "word_length", "symbols", "any_symbol", "repeated", "dup_lines", "distinct",
    "digits", "upper", "letters", "punctuation", "wide", "line_words", "longest",
)


def statistics(m: dict[str, np.ndarray]) -> np.ndarray:
    """The structure statistics (documents x ``STATISTICS``) from :func:`measures.measure`."""
    words = np.maximum(m["n_words"], 1).astype(np.float64)
    chars = np.maximum(m["n_chars"], 1).astype(np.float64)
    lines = np.maximum(m["n_lines"], 1).astype(np.float64)
    return np.column_stack(
        [
            np.log1p(m["n_words"]),
            np.minimum(m["word_chars"] / words, 40),
            np.minimum(m["n_symbols"] / words, 4),
            np.minimum(m["n_symbols"], 5),
            m["n_repeat_words"] / words,
            m["n_dup_lines"] / lines,
            m["n_distinct_words"] / words,
            m["n_digits"] / chars,
            m["n_upper"] / chars,
            m["n_letters"] / chars,
            m["n_punct"] / words,
            m["n_wide"] / chars,
            np.log1p(words / lines),
            np.log1p(m["max_word"]),
        ]
    )


def features(chunk: flat.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, documents' edges, statistics): each document's distinct hashed words."""
    m, spans, hashed = measure(chunk)
    key = (spans.doc.astype(np.int64) << bits) | (hashed >> np.uint64(64 - bits)).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    value = np.log1p(np.diff(np.r_[first, len(key)]))
    doc, bucket = key[first] >> bits, key[first] & ((1 << bits) - 1)
    edge = np.searchsorted(doc, np.arange(chunk.n + 1))
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=chunk.n))
    return bucket, value / norm[doc], edge, statistics(m)


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of rows ``edge[i]:edge[i + 1]``, zero where there are none."""
    out = np.zeros((len(edge) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        out[some] = np.add.reduceat(values, edge[some], axis=0)
    return out


@dataclass
class FactorisationMachine:
    """``weights`` and ``factors`` have the words' buckets first, then the statistics."""

    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def margin(self, bucket, value, edge, scaled) -> tuple[np.ndarray, np.ndarray]:
        words = 1 << self.bits
        v = self.factors[bucket] * value[:, None]
        total = _sums(v, edge) + scaled @ self.factors[words:]
        squares = _sums((v * v).sum(axis=1), edge) + (scaled**2) @ (self.factors[words:] ** 2).sum(axis=1)
        line = _sums(self.weights[bucket] * value, edge) + scaled @ self.weights[words:]
        return self.bias + line + 0.5 * ((total**2).sum(axis=1) - squares), total

    def score(self, chunk: flat.Chunk) -> np.ndarray:
        bucket, value, edge, stats = features(chunk, self.bits)
        margin, _ = self.margin(bucket, value, edge, self.scaled(stats))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def fit(rows: list, labels: np.ndarray, bits: int, rank: int = 4, epochs: int = 12, rate: float = 0.05) -> FactorisationMachine:
    """Train on rows (bucket, value, statistics) by minibatch AdaGrad on the logistic loss; seeded."""
    random = np.random.default_rng(7)
    stats = np.stack([r[2] for r in rows]) if rows else np.zeros((0, len(STATISTICS)))
    size = (1 << bits) + len(STATISTICS)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
    model = FactorisationMachine(
        bits,
        float(np.log(share / (1 - share))),
        np.zeros(size),
        random.normal(0, 0.01, (size, rank)),
        stats.mean(axis=0) if len(stats) else np.zeros(len(STATISTICS)),
        np.maximum(stats.std(axis=0), 1e-6) if len(stats) else np.ones(len(STATISTICS)),
    )
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    words = 1 << bits
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    scaled = model.scaled(stats)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            bucket = np.concatenate([rows[i][0] for i in own])
            value = np.concatenate([rows[i][1] for i in own])
            edge = np.cumsum([0, *(len(rows[i][0]) for i in own)])
            x = scaled[own]
            margin, total = model.margin(bucket, value, edge, x)
            slope = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[own]) * balance[own] / len(own)
            each = np.repeat(np.arange(len(own)), np.diff(edge))
            # gradients: x_j for weights, x_j (total_f - v_jf x_j) for factors
            touched, back = np.unique(bucket, return_inverse=True)
            gw = np.bincount(back, weights=slope[each] * value)
            inner = value[:, None] * (total[each] - model.factors[bucket] * value[:, None]) * slope[each][:, None]
            gv = np.stack([np.bincount(back, weights=inner[:, f]) for f in range(rank)], axis=1)
            gw += 1e-6 * model.weights[touched]
            gv += 1e-5 * model.factors[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            model.weights[touched] -= rate * gw / np.sqrt(seen_w[touched])
            model.factors[touched] -= rate * gv / np.sqrt(seen_v[touched])
            gw = slope @ x
            gv = x.T @ (slope[:, None] * total) - model.factors[words:] * ((x * x).T @ slope)[:, None]
            seen_w[words:] += gw * gw
            seen_v[words:] += gv * gv
            model.weights[words:] -= rate * gw / np.sqrt(seen_w[words:])
            model.factors[words:] -= rate * gv / np.sqrt(seen_v[words:])
            g = slope.sum()
            seen_b += g * g
            model.bias -= rate * g / np.sqrt(seen_b)
    return model


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = 1500, bits: int = 14,
) -> FactorisationMachine:
    """Fit on at most ``sample`` rows of each class of ``labels`` (key, label), joined to whole texts.

    A key that has several labels counts by the smallest.
    """
    known = labels.where(f"{label} in (0, 1) and {key} is not null").groupBy(F.col(key).cast("long").alias("id"))
    known = known.agg(F.min(label).cast("int").alias("label")).withColumn("place", F.xxhash64("id"))
    picked = None
    for kind in (0, 1):
        own = known.where(F.col("label") == kind).orderBy("place", "id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # ``picked`` has 2 * sample rows of numbers at most.
    rows = texts.join(F.broadcast(picked.select("id", "label")), "id").select("label", "text", "id")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            buckets, values, stats = [], [], []
            for chunk in flat.chunks(batch.column(1)):
                bucket, value, edge, own = features(chunk, bits)
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    buckets.append(bucket[a:b].astype(np.int32).tobytes())
                    values.append(value[a:b].astype(np.float32).tobytes())
                stats += [s.tobytes() for s in own]
            return pa.record_batch(
                [batch.column(2), batch.column(0), *(pa.array(x, pa.binary()) for x in (buckets, values, stats))],
                names=["id", "label", "bucket", "value", "stats"],
            )

        return each

    made = map_batches(rows, make, "id long, label int, bucket binary, value binary, stats binary")
    # One row an id: a repeated id must not widen the sample.
    one = made.groupBy("id").agg(F.min(F.struct("label", "bucket", "value", "stats")).alias("r")).select("id", "r.*")
    got = sorted(one.collect(), key=lambda r: r["id"])
    parsed = [
        (np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64), np.frombuffer(r["stats"]))
        for r in got
    ]
    return fit(parsed, np.array([r["label"] for r in got], dtype=np.float64), bits)


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*extra, score): the model's score of every row's whole text, beside the named columns."""
    fields = docs.select(*[f"`{c}`" for c in extra]).schema.fields
    named = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]
    own = extra.index(text) if text in extra else len(extra)
    if own == len(extra):
        named.append(F.col(text).cast("string").alias(f"c{own}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = np.concatenate([model.score(chunk) for chunk in flat.chunks(batch.column(own))])
            names = [f"c{i}" for i in range(len(fields))]
            return pa.record_batch([*batch.columns[: len(fields)], pa.array(scores)], names=[*names, "s"])

        return each

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "s double"])
    made = map_batches(docs.select(*named), make, schema)
    return made.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)], F.col("s").alias("score"))


def held_out(key: str = "doc_id"):
    """True for the third of the ids that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Train on the labels outside the held-out third, score every row: key, held_out, score, predicted."""
    model = train(docs, labels.where(~held_out(key)), key, text, **options)
    return score(docs, model, text, (key,)).select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
