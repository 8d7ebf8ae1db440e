"""Filter interaction audit: what each filter removes in every order of applying them.

Five filters judge a document by its whole text: A (fewer than 200 words), B (under half of its
words are distinct), C (over two of a hundred characters are capitals A-Z), D (it holds one of
``#$%&*|``), E (its text equals that of a smaller key, wherever that stands).  One scan over the
Arrow buffers measures the texts: byte classes and prefix sums count words, capitals, symbols and
characters; a document's word hashes are sorted and neighbours with one hash compared byte by
byte, so that distinct words are counted exactly (a document where two words share a hash is
counted by its words).  What leaves the scan is a few numbers and a SHA-256 digest a document.

Failed filters are bits of a mask.  Documents are summed by part and mask (at most 32 rows a
part), and only these sums meet the 600 places of the 120 orders: a table of fixed size says for
each mask and place whether such documents are kept, removed, redundant.

No group gathers in a task: equal texts find their smallest key by partial minima and a document
meets that by digest and key together; the sums are partial too.

Defined results: a null text is empty and a null part the empty string; of repeated rows with one
key and text none is a copy of the other; a null key has no label, is no copy and makes none; of
several labels of one key any 1 counts.  An empty table gives no rows.  Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import flat
from loomery.llm.util import cut, map_batches

FILTERS = "ABCDE"
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")

#: The filters that a document's own measurements decide, by letter: the condition of failing.
OWN = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
}


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_CAPITAL = _class(bytes(range(65, 91)))
_SYMBOL = _class(b"#$%&*|")
_FIRST = ~_class(bytes(range(0x80, 0xC0)))


def _counted(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks each document has, by prefix sums."""
    sums = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_words(chunk: flat.Chunk, spans: flat.Spans) -> np.ndarray:
    """How many different words each document has: sorted hashes, verified on the bytes."""
    out = np.zeros(chunk.n, dtype=np.int64)
    if not len(spans.start):
        return out
    hashed = flat.hashes(flat.running(chunk, False), spans.start, spans.end)
    order = np.argsort(hashed)
    order = order[np.argsort(spans.doc[order].astype(np.uint16), kind="stable")]  # a chunk has 65,536 documents at most
    doc, hashed = spans.doc[order], hashed[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (hashed[1:] == hashed[:-1])) + 1
    out += np.bincount(doc, minlength=chunk.n) - np.bincount(doc[same], minlength=chunk.n)
    left, right = order[same - 1], order[same]
    length = spans.end[right] - spans.start[right]
    unlike = length != spans.end[left] - spans.start[left]
    left, right, length = left[~unlike], right[~unlike], length[~unlike]
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    differs = chunk.data[np.repeat(spans.start[left], length) + inside] != chunk.data[np.repeat(spans.start[right], length) + inside]
    wrong = {*doc[same[unlike]].tolist(), *spans.doc[np.repeat(right, length)[differs]].tolist()}
    for d in wrong:
        lo, hi = int(chunk.offsets[d]), int(chunk.offsets[d + 1])
        own = range(spans.first[d], spans.first[d] + spans.per_doc[d])
        body = chunk.data[lo:hi].tobytes()
        out[d] = len({body[spans.start[i] - lo : spans.end[i] - lo] for i in own})
    return out


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, ``MEASURES``, digest) of every row's whole text, from one scan."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns, digests = [[] for _ in MEASURES], []
            for chunk in flat.chunks(batch.column(2)):
                spans = flat.words(chunk)
                found = (
                    spans.per_doc, distinct_words(chunk, spans), _counted(_CAPITAL[chunk.data], chunk.offsets),
                    _counted(_SYMBOL[chunk.data], chunk.offsets), _counted(_FIRST[chunk.data], chunk.offsets),
                )
                for column, values in zip(columns, found):
                    column.append(values.astype(np.int64))
                at = chunk.offsets.tolist()
                digests += [hashlib.sha256(chunk.data[a:b]).digest() for a, b in zip(at, at[1:])]
            made = [pa.array(np.concatenate(c)) for c in columns]
            return pa.record_batch(
                [batch.column(0), batch.column(1), *made, pa.array(digests, pa.binary())],
                names=["id", "part", *MEASURES, "digest"],
            )

        return each

    kind = docs.select(F.col(key).alias("id")).schema[0].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text")
    )
    return map_batches(rows, make, f"id {kind}, part string, {', '.join(f'{m} long' for m in MEASURES)}, digest binary")


def failures(rows: DataFrame) -> DataFrame:
    """(id, part, failed, n): rows of :func:`measured` with their mask of failed filters, equal rows as one with their number.

    Bit i stands for ``FILTERS[i]``.
    """
    own = F.lit(0)
    for bit, condition in enumerate(OWN.values()):
        own = own + F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0))
    # Rows without an id are no copies whatever their text: their digest is not needed, and they are summed at once.
    digest = F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")
    some = cut(rows.select("id", "part", own.alias("own"), digest).groupBy("id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("n")))
    known = some.where("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    judged = known.join(first, ["digest", "id"], "left").select("id", "part", (F.col("own") + copy).alias("failed"), "n")
    return judged.unionByName(some.where("id is null").select("id", "part", F.col("own").alias("failed"), "n"))


def effects(spark: SparkSession) -> DataFrame:
    """For each mask and each place of each order what becomes of documents with that mask (32 x 600 rows)."""
    rows = []
    for mask in range(1 << len(FILTERS)):
        fails = {f for i, f in enumerate(FILTERS) if mask >> i & 1}
        for order in permutations(FILTERS):
            for step, own in enumerate(order, 1):
                before = fails.intersection(order[: step - 1])
                # In as many of the orders as of its peers' it comes first of those that the document fails.
                share = 120 // len(fails) if own in fails else 0
                rows.append(
                    (
                        mask, "".join(order), step, int(not before and own not in fails), int(own in fails and not before),
                        int(own in fails and bool(before)), int(fails == {own}), share,
                    )
                )
    return spark.createDataFrame(
        rows, "failed int, filter_order string, step int, kept int, removed int, redundant int, alone int, share int"
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row a part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    marks = marks.agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    rows = failures(measured(docs, key, text, part))
    unknown = rows.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    rows = rows.where("id is not null").join(marks, "id", "left").unionByName(unknown)
    sums = rows.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0)")).alias("n_good"), F.sum(F.expr("if(toxic, n, 0)")).alias("n_toxic")
    )
    placed = sums.join(F.broadcast(effects(docs.sparkSession)), "failed")
    total = lambda amount, by: F.sum(F.col(amount) * F.col(by)).cast("long")
    return placed.groupBy("part", "filter_order", "step").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"),
        total("n", "alone").alias("unique_fails"), total("n_good", "removed").alias("good_lost"),
        total("n_toxic", "removed").alias("toxic_lost"), total("n", "share").alias("shapley"),
    )
