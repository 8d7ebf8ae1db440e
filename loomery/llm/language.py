"""Language identification by a bidirectional recurrent network over bytes.

Two gated recurrent layers read a window of bytes, one from each end; at every byte their states give a
probability of each language, and a document's probabilities are the mean over all its
bytes.  A text is read whole, in windows of ``window`` bytes one after the other, each from a blank
state, so that many windows go through the network side by side (a column each) and memory does not
grow with a text.

Training is backpropagation through time in numpy (Adam on the cross entropy at every
byte, seeded), on the driver, over a bounded sample: at most ``sample`` documents of each language, in the
order of a hash of their id, and of each at most ``windows`` windows spread over its text.  The
languages are the values that the training rows have.  Nothing but the text is an input of a
prediction.

Defined results: a text that is null or has no letter (Unicode) is ``und`` with score 0; with
nothing to learn from every text is; a text shorter than a window is one shorter window (to train on, it is
repeated to a window's length); repeated rows and null ids are predicted like any others but a null id teaches
nothing; of rows with one id and language the smallest text teaches; an empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm import flat
from loomery.llm.quality import held_out
from loomery.llm.util import map_batches

UNKNOWN = "und"
#: Windows that go through the network side by side.
COLUMNS = 2048

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class ByteTagger:
    """Weights by direction (0: from the left), gates stacked as update, reset, new.

    ``bytes_``: (2, 3 units, 256); ``state``: (2, 3 units, units); ``out``: (2, languages, units); ``bias``: (languages, 1).
    """

    languages: list[str]
    window: int
    bytes_: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def blank(cls, languages: list[str], window: int, units: int, seed: int = 11) -> ByteTagger:
        random = np.random.default_rng(seed)
        return cls(
            languages, window, random.normal(0, 0.3, (2, 3 * units, 256)).astype(np.float32),
            random.normal(0, units**-0.5, (2, 3 * units, units)).astype(np.float32),
            random.normal(0, units**-0.5, (2, len(languages), units)).astype(np.float32),
            np.zeros((len(languages), 1), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.bytes_, self.state, self.out, self.bias]

    def gradients(self, read: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy over every byte of windows (window, columns) and its gradients, by time backwards."""
        steps, n = read.shape
        u = self.state.shape[2]
        kind = self.bytes_.dtype
        seen = np.stack([read, read[::-1]], axis=1)  # (step, direction, column)
        h = np.zeros((2, u, n), kind)
        kept = []
        states = np.empty((steps, 2, u, n), kind)
        for t in range(steps):
            x = np.stack([self.bytes_[d].take(seen[t, d], axis=1) for d in (0, 1)])
            g = self.state @ h
            gates = 1 / (1 + np.exp(-(x[:, : 2 * u] + g[:, : 2 * u])))
            z, r = gates[:, :u], gates[:, u:]
            new = np.tanh(x[:, 2 * u :] + r * g[:, 2 * u :])
            kept.append((h, z, r, new, g[:, 2 * u :]))
            h = new + z * (h - new)
            states[t] = h
        both = np.stack([states[:, 0], states[::-1, 1]], axis=1)  # by place in the window
        logits = (self.out[None] @ both).sum(axis=1) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        columns = np.arange(n)
        loss = float(-np.log(np.maximum(p[:, label, columns], 1e-30)).mean())
        error = p
        error[:, label, columns] -= 1
        error /= steps * n
        d_out = np.einsum("tln,tdun->dlu", error, both, optimize=True)
        d_both = np.swapaxes(self.out, 1, 2)[None] @ error[:, None]
        d_states = np.stack([d_both[:, 0], d_both[::-1, 1]], axis=1)
        d_state, d_seen = np.zeros_like(self.state), np.empty((steps, 2, 3 * u, n), kind)
        back = np.zeros_like(h)
        turned = np.swapaxes(self.state, 1, 2)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, inner = kept[t]
            dh = d_states[t] + back
            d_new = dh * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([dh * (before - new) * z * (1 - z), d_new * inner * r * (1 - r)], axis=1)
            d_seen[t] = np.concatenate([d_gates, d_new], axis=1)
            d_g = np.concatenate([d_gates, d_new * r], axis=1)
            d_state += d_g @ np.swapaxes(before, 1, 2)
            back = dh * z + turned @ d_g
        d_bytes = np.zeros_like(self.bytes_)
        for d in (0, 1):
            at = seen[:, d].reshape(-1)
            for row in range(3 * u):
                d_bytes[d, row] = np.bincount(at, weights=d_seen[:, d, row].reshape(-1), minlength=256)
        return loss, [d_bytes, d_state, d_out.astype(kind), error.sum(axis=(0, 2))[:, None].astype(kind)]

    def _read(self, d: int, read: np.ndarray, active: np.ndarray, logits: np.ndarray) -> None:
        """Add one direction's part to the logits (place, language, column); columns stand by falling length."""
        u = self.state.shape[2]
        # Signs and scales as the exponentials want them.
        scale = np.repeat(np.float32([-1, -1, -2]), u)[:, None]
        table, state, out = self.bytes_[d] * scale, self.state[d] * scale, self.out[d]
        h = np.zeros((u, 0), np.float32)
        for t in range(len(read))[:: -1 if d else 1]:
            n = int(active[t])
            if h.shape[1] > n:
                h = np.ascontiguousarray(h[:, :n])
            elif h.shape[1] < n:
                h = np.concatenate([h, np.zeros((u, n - h.shape[1]), np.float32)], axis=1)
            x = table.take(read[t, :n], axis=1)
            g = state @ h
            gates = x[: 2 * u]
            gates += g[: 2 * u]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = g[2 * u :]
            new *= gates[u:]
            new += x[2 * u :]
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            h -= new
            h *= gates[:u]
            h += new
            logits[t, :, :n] += out @ h

    def probabilities(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Per window (at most ``window`` bytes each) the sum over its bytes of their probabilities: (windows, languages)."""
        total = np.zeros((len(start), len(self.languages)))
        falling = np.argsort(-length, kind="stable")
        with np.errstate(over="ignore"):
            for at in range(0, len(start), COLUMNS):
                own = falling[at : at + COLUMNS]
                size = length[own]
                places = np.arange(size[0])
                active = len(own) - np.searchsorted(size[::-1], places, side="right")
                read = data[np.minimum(start[own] + places[:, None], len(data) - 1)]
                logits = np.repeat(np.repeat(self.bias[None], len(places), axis=0), len(own), axis=2)
                self._read(0, read, active, logits)
                self._read(1, read, active, logits)
                logits -= logits.max(axis=1, keepdims=True)
                np.exp(logits, out=logits)
                logits /= logits.sum(axis=1, keepdims=True)
                logits[np.broadcast_to(places[:, None, None] >= size, logits.shape)] = 0
                total[own] = logits.sum(axis=0).T
        return total

    def documents(self, chunk: flat.Chunk) -> np.ndarray:
        """The mean probabilities of each document's bytes; zeros for an empty one."""
        size = np.diff(chunk.offsets)
        count = -(-size // self.window)
        doc = np.repeat(np.arange(chunk.n), count)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * self.window
        found = np.zeros((chunk.n, len(self.languages)))
        if len(doc):
            windows = self.probabilities(chunk.data, chunk.offsets[doc] + place, np.minimum(self.window, size[doc] - place))
            some = np.flatnonzero(count)
            found[some] = np.add.reduceat(windows, (np.cumsum(count) - count)[some], axis=0)
        return found / np.maximum(size, 1)[:, None]


def fit(windows: np.ndarray, label: np.ndarray, languages: list[str], units: int = 8, epochs: int = 12, rate: float = 0.02, batch: int = 192) -> ByteTagger:
    """Train on windows (rows of bytes) by Adam over shuffled batches; seeded."""
    model = ByteTagger.blank(languages, windows.shape[1], units)
    if len(languages) < 2:
        return model
    random = np.random.default_rng(5)
    weights = model.weights()
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, found = model.gradients(np.ascontiguousarray(windows[own].T), label[own])
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in found))))
            pace = rate * (1 - step / rounds)
            step += 1
            for w, g, m, v in zip(weights, found, first, second):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def sample_windows(body: bytes, window: int, windows: int) -> list[bytes]:
    """At most ``windows`` windows spread evenly over a text; a shorter text is repeated to one."""
    if len(body) < window:
        return [((body + b" ") * (window // (len(body) + 1) + 1))[:window]]
    n = min(windows, len(body) // window)
    return [body[a : a + window] for a in (i * (len(body) - window) // max(1, n - 1) for i in range(n))]


def has_letter(chunk: flat.Chunk) -> np.ndarray:
    """True for documents with a Unicode letter; those with an ASCII letter are found by prefix sums."""
    sums = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[chunk.data], out=sums[1:])
    out = sums[chunk.offsets[1:]] > sums[chunk.offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        body = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes()
        out[i] = any(c.isalpha() for c in body.decode("utf-8", "replace")) if body else False
    return out


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 400, windows: int = 3,
    window: int = 128, **options,
) -> ByteTagger | None:
    """Fit on at most ``sample`` documents of each language; None if no row has an id, a language and a letter."""
    rows = docs.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where("id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    ids = rows.select("id", "lang").distinct()
    # Only ids whose hash is small enough are ranked: about twice the sample of a language, however many it has.
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    low = F.xxhash64("id").cast("double") / 2.0**64 + 0.5 <= (2 * sample + 100) / F.col("n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = ids.join(F.broadcast(counts), "lang").where(low).withColumn("place", place).where(F.col("place") <= sample)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bodies = [b"".join(sample_windows(t.encode(), window, windows)) for t in batch.column(2).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], names=["id", "lang", "body"])

        return each

    kind = rows.schema[0].dataType.simpleString()
    # ``sample`` ids a language: the texts stay where they are.
    some = map_batches(rows.join(F.broadcast(picked.select("id", "lang")), ["id", "lang"], "left_semi"), make, f"id {kind}, lang string, body binary")
    # ``sample`` rows a language, ``windows`` windows each.
    got = sorted(some.groupBy("lang", "id").agg(F.min("body").alias("body")).collect(), key=lambda r: (r["lang"], r["id"]))
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    cut = [np.frombuffer(r["body"], np.uint8).reshape(-1, window) for r in got]
    label = np.repeat([languages.index(r["lang"]) for r in got], [len(c) for c in cut])
    return fit(np.concatenate(cut), label, languages, **options)


def predict(docs: DataFrame, model: ByteTagger | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row's whole text."""
    kind = docs.select(F.col(key).alias("id")).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = shared.value

        def found(batch: pa.RecordBatch) -> Iterator[tuple[str, float]]:
            for chunk in flat.chunks(batch.column(1)):
                known = has_letter(chunk) if model else np.zeros(chunk.n, bool)
                p = model.documents(chunk) if model else np.zeros((chunk.n, 1))
                for ok, best, score in zip(known.tolist(), p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    yield (model.languages[best], min(1.0, score)) if ok else (UNKNOWN, 0.0)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = zip(*found(batch))
            return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "l", "s"])

        return each

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    made = map_batches(rows, make, f"id {kind}, l string, s double")
    return made.select(F.col("id").alias(key), F.col("l").alias("lang_pred"), F.col("s").alias("score"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Train outside the held-out third of the ids, predict every row: key, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(key)), key, text, lang, **options)
    found = predict(docs, model, key, text)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
