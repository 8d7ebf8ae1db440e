"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its words (A-Z folded), each weighing its count
times the square of its length in bytes, so that the few short words of a language
don't make all its documents alike.  Sample ``k`` draws for each term, from a hash of
the term and ``k`` alone, ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``; with
``t = floor(ln w / r + b)`` the term's rank is ``ln c - r (t - b) - r``, and the term of
the least rank, with its ``t``, is the sample (Ioffe, 2010).  Two documents agree in a
sample with a probability equal to their generalised Jaccard similarity
``sum min / sum max``, so the share of equal samples estimates it.

Ranks of (term, count) pairs a worker has met are remembered up to a bound; others are
worked out again.

Defined results: a null text is empty; documents without words have a fingerprint of
zeros, alike (1.0) among each other and unlike (0.0) all others; equal texts have equal
fingerprints.  Repeated rows and null ids are kept, null ids last in the order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import flat

SAMPLES = 64


class Sampler:
    """Ranks and codes of (term, weight) pairs, and the signatures made of them."""

    def __init__(self, samples: int = SAMPLES, remember: int = 120_000) -> None:
        self.samples, self.remember = samples, remember
        self.seeds = flat.mix(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.keys = np.empty(0, np.uint64)
        self.rows = np.empty((0, samples), np.uint64)

    def ranks(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Per term and sample: the rank as an ordered integer (high half) and the sample's code (low half)."""
        out = np.empty((len(term), self.samples), dtype=np.uint64)
        for at in range(0, len(term), 2048):
            out[at : at + 2048] = self._ranks(term[at : at + 2048], weight[at : at + 2048])
        return out

    def _ranks(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        k = self.samples
        half = np.float64(1.0 / (1 << 32))

        def pair(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h = flat.mix(term[:, None] ^ seeds)
            return ((h >> np.uint64(32)) + 0.5) * half, ((h & np.uint64(0xFFFFFFFF)) + 0.5) * half

        a, b = pair(self.seeds[:k])
        r = -np.log(a * b)
        a, b = pair(self.seeds[k : 2 * k])
        log_c = np.log(-np.log(a * b))
        beta, _ = pair(self.seeds[2 * k :])
        t = np.floor(np.log(weight)[:, None] / r + beta)
        rank = (log_c - r * (t - beta) - r).astype(np.float32)
        bits = rank.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        code = flat.mix(term[:, None] + t.astype(np.int64).view(np.uint64) * flat.PLACES[0]) >> np.uint64(32)
        return ordered << np.uint64(32) | code

    def signatures(self, chunk: flat.Chunk) -> np.ndarray:
        """16-bit samples of every document (documents x samples); zeros without words."""
        spans = flat.words(chunk)
        out = np.zeros((chunk.n, self.samples), dtype=np.uint16)
        if not len(spans.start):
            return out
        hashed = flat.hashes(flat.running(chunk, True), spans.start, spans.end)
        own = np.lexsort((hashed, spans.doc))
        hashed, size = hashed[own], (spans.end - spans.start)[own]
        first = np.flatnonzero(np.r_[True, (hashed[1:] != hashed[:-1]) | (spans.doc[1:] != spans.doc[:-1])])
        count = np.diff(np.r_[first, len(hashed)])
        term, size, doc = hashed[first], size[first], spans.doc[first]
        weight = count * size.astype(np.float64) ** 2
        pair = flat.mix(term + count.astype(np.uint64) * flat.PLACES[1])
        unique, at, back = np.unique(pair, return_index=True, return_inverse=True)
        table = np.empty((len(unique), self.samples), dtype=np.uint64)
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        if len(self.keys):
            place = np.minimum(place, len(self.keys) - 1)
            known = self.keys[place] == unique
            table[known] = self.rows[place[known]]
        new = np.flatnonzero(~known)
        table[new] = self.ranks(term[at[new]], weight[at[new]])
        if len(new) and len(self.keys) < self.remember:
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.rows = np.concatenate([self.rows, table[new]])[order]
        edge = np.searchsorted(doc, np.arange(chunk.n + 1)).tolist()
        for d in range(chunk.n):
            if edge[d + 1] > edge[d]:
                out[d] = table[back[edge[d] : edge[d + 1]]].min(axis=0).astype(np.uint16)
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        column = pa.array(texts, pa.large_string())
        parts = [self.signatures(chunk) for chunk in flat.chunks(column)]
        return np.concatenate(parts) if parts else np.empty((0, self.samples), np.uint16)


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _hex_order(column: str) -> F.Column:
    """A long as 16 hex digits whose order as text is the numbers' order."""
    return F.lpad(F.hex(F.col(column).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", spread: int = 4) -> DataFrame:
    """Fingerprint every text and its edited text, and compare with the edited and the next one.

    The next document is the one that follows in descending order of the key (ties by a hash
    of the text); the first follows the last.  The edited text has the last floor(n / 2) of
    its n code points replaced by as many of the next document's first (or all it has).

    Returns key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.
    Rows are dealt into ranges of the order, ``spread`` times as many as shuffle partitions,
    and the first row of each range also goes to the range before it: whole texts move once,
    and no range needs another's rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("down", F.bitwise_not("id")).withColumn("h", F.xxhash64("text"))
    rows = rows.select(
        "id", "text",
        F.concat(
            F.when(F.col("id").isNull(), "1").otherwise("0"), F.coalesce(_hex_order("down"), F.lit("")), _hex_order("h")
        ).alias("place"),
    )
    ends = (
        rows.select("place")
        .repartitionByRange(spread * parts, "place")
        .groupBy(F.spark_partition_id())
        .agg(F.min("place").alias("place"))
    )
    bounds = sorted({r["place"] for r in ends.collect()})  # one a range
    if not bounds:
        bounds = [""]

    @F.pandas_udf("int")
    def range_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            yield pd.Series([bisect_right(bounds, p) - 1 for p in places], dtype="int32")

    heads = rows.where(F.col("place").isin(bounds)).dropDuplicates(["place"])
    both = rows.select(range_of("place").alias("part"), "place", F.lit(False).alias("head"), "id", "text").unionByName(
        heads.select(
            F.pmod(range_of("place") - 1, F.lit(len(bounds))).alias("part"),
            "place", F.lit(True).alias("head"), "id", "text",
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        held = None  # (part, id, text, signature) of the row whose next is still to come
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                part, head, ids, texts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
                own = sampler.of(texts)
                pending, edited, after = [], [], []
                for i in range(len(texts)):
                    if held is not None and held[0] == part[i]:
                        size = len(held[2]) // 2
                        pending.append(held)
                        edited.append(held[2][: len(held[2]) - size] + texts[i][:size])
                        after.append(own[i])
                    held = None if head[i] else (part[i], ids[i], texts[i], own[i])
                if pending:
                    mine = np.stack([p[3] for p in pending])
                    theirs = sampler.of(edited)
                    yield pa.record_batch(
                        [
                            pa.array([p[1] for p in pending], pa.int64()),
                            pa.array([len(p[2]) for p in pending], pa.int64()),
                            pa.array(edited, pa.string()),
                            pa.array([printed(s) for s in mine], pa.string()),
                            pa.array([printed(s) for s in theirs], pa.string()),
                            pa.array((mine == theirs).mean(axis=1)),
                            pa.array((mine == np.stack(after)).mean(axis=1)),
                        ],
                        names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )

    # Heads close their range: no row of it comes after the head of the next one, but the first
    # range's head, which closes the last range, sorts before that range's rows by place.
    return (
        both.repartition(parts, "part")
        .sortWithinPartitions("part", "head", "place")
        .mapInArrow(
            compare,
            "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string,"
            " near_edited double, near_next double",
        )
        .withColumnRenamed("id", key)
    )


def _sampler() -> Sampler:
    global _kept
    if _kept is None:
        _kept = Sampler()
    return _kept


_kept: Sampler | None = None
