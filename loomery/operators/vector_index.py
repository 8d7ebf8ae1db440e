"""A nearest-neighbour index over vectors: cells of a coarse quantiser, kept as a pruned partition column.

``build`` fits centroids (Lloyd's rounds, seeded) on a bounded sample and writes every row to its
nearest centroid's folder; ``add`` appends more rows to an index.  ``nearest`` answers many questions at once:
each reads its ``probes`` nearest cells.  Rows and questions of a cell are packed into blocks of bounded size, so a
cell that holds a third of all rows is many blocks, and a pair of blocks is one matrix product;
each gives at most ``limit`` rows a question before anything moves.  With ``probes=None`` all cells are read, which is
the exact way.  ``nearest_one`` asks a single question: the other cells' folders are not opened.

Scores are higher for nearer vectors: cosine (0 for a zero vector), inner_product, or the negated l2 distance.

Defined results: rows whose vector is null, of another length than the index's or not finite are kept in
cell -1 and found by no question; such questions find nothing; equal scores rank by id;
repeated rows are found each; an empty table gives an index without cells.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.lineage import shared_folder

KINDS = ("cosine", "inner_product", "l2")
#: Cells at most, whatever is asked for: the centroids go to every task.
MOST_CELLS = 4096
_ROWS = 4096
_QUESTIONS = 512
#: Scores that Python holds at once when points meet all centres.
_SCORES = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _scores(kind: str, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(questions, rows): higher is nearer."""
    if kind == "cosine":
        return _unit(asked) @ _unit(rows).T
    if kind == "inner_product":
        return asked @ rows.T
    squares = (asked**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None] - 2 * asked @ rows.T
    return -np.sqrt(np.maximum(squares, 0))


def _best(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point its nearest centre and the score of it, some points at a time: what is held does not grow with both."""
    own, score = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    step = max(1, _SCORES // max(1, len(centres)))
    for at in range(0, len(points), step):
        some = _scores("l2", points[at : at + step], centres)
        own[at : at + step] = some.argmax(axis=1)
        score[at : at + step] = some.max(axis=1)
    return own, score


def fit_cells(sample: np.ndarray, cells: int, kind: str, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds, on unit vectors for cosine; an emptied cell takes the row that fits worst."""
    if not len(sample):
        return sample
    points = _unit(sample) if kind == "cosine" else sample
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), min(cells, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own, score = _best(points, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(count == 0)
        worst = np.argsort(score, kind="stable")[: len(empty)]
        centres = sums / np.maximum(count, 1)[:, None]
        centres[empty] = points[worst]
    return centres


@dataclass
class Index:
    """Where an index lies, and its few facts: centroids (cells x length), the kind of score, the type of the ids."""

    path: str
    kind: str
    centres: np.ndarray
    id_type: str

    def rows(self, spark: SparkSession) -> DataFrame:
        """id, embedding array<double>, cell."""
        return spark.read.schema(f"id {self.id_type}, embedding array<double>, cell int").parquet(f"{self.path}/cells")

    def nearest_cells(self, asked: np.ndarray, probes: int | None) -> np.ndarray:
        """Per question its nearest cells, the nearest first."""
        points = _unit(asked) if self.kind == "cosine" else asked
        # A large inner product wants a centre in its direction; the others a near one.
        kind = "inner_product" if self.kind == "inner_product" else "l2"
        step = max(1, _SCORES // max(1, len(self.centres)))
        few = [
            np.argsort(-_scores(kind, points[at : at + step], self.centres), axis=1, kind="stable")[:, : probes or len(self.centres)].astype("int32")
            for at in range(0, max(1, len(points)), step)
        ]
        return np.concatenate(few)


def _usable(column: str, length: int) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) == length) & ~bad


def _as_double(column: str) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.empty((0, 0))


def _write_cells(rows: DataFrame, index: Index, mode: str) -> None:
    centres = rows.sparkSession.sparkContext.broadcast(index.centres)
    kind = index.kind

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        points = _matrix(vectors)
        if not len(points):
            return pd.Series([], dtype="int32")
        points = _unit(points) if kind == "cosine" else points
        return pd.Series(_best(points, centres.value)[0].astype("int32"))

    known = F.when(_usable("embedding", index.centres.shape[1] if index.centres.size else -1), F.col("embedding"))
    good = rows.withColumn("embedding", known)
    placed = good.where("embedding is not null").withColumn("cell", cell("embedding"))
    placed = placed.unionByName(good.where("embedding is null").withColumn("cell", F.lit(-1)))
    # Files of even size a cell; a large cell is split.
    placed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{index.path}/cells")


def build(
    vectors: DataFrame, path: str | None = None, key: str = "id", embedding: str = "embedding", kind: str = "cosine",
    cells: int | None = None, sample: int = 10_000,
) -> Index:
    """Write an index of all rows (key, embedding) at ``path``, by default a new folder in the shared one.

    The centroids are fitted on at most ``sample`` rows, in the order of a hash of the key; ``cells``
    is the square root of the number of rows unless named.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown distance type: {kind}")
    spark = vectors.sparkSession
    path = path or f"{shared_folder(spark)}/loomery-index-{uuid.uuid4().hex}"
    rows = vectors.select(F.col(key).alias("id"), _as_double(embedding).alias("embedding"))
    lengths = rows.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), "n").first()  # the length that most rows have
    length, total = (common["n"], common["count"]) if common else (0, 0)
    some = rows.where(_usable("embedding", length)).orderBy(F.xxhash64("id"), "id").limit(sample)
    points = np.array([r["embedding"] for r in some.select("embedding").collect()], dtype=np.float64).reshape(-1, length or 1)
    cells = min(MOST_CELLS, cells or max(1, math.isqrt(total)))
    index = Index(path, kind, fit_cells(points, cells, kind), rows.schema["id"].dataType.simpleString())
    _write_cells(rows, index, "overwrite")
    facts = json.dumps({"kind": kind, "length": length or 1, "centres": index.centres.tolist(), "id": index.id_type})
    spark.createDataFrame([(facts,)], "facts string").write.mode("overwrite").json(f"{path}/facts")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    facts = json.loads(spark.read.json(f"{path}/facts").first()["facts"])
    return Index(path, facts["kind"], np.array(facts["centres"], dtype=np.float64).reshape(-1, facts["length"]), facts["id"])


def add(index: Index, vectors: DataFrame, key: str = "id", embedding: str = "embedding") -> None:
    """Append rows to the index's cells; the centroids stay."""
    _write_cells(vectors.select(F.col(key).alias("id"), _as_double(embedding).alias("embedding")), index, "append")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(cell, ids, vectors) of at most about ``size`` rows of a cell, dealt by a hash of the id."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))  # a row a cell
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "parts"))
    listed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "embedding")).alias("own"))
    return listed.select("cell", F.col("own.id").alias("ids"), F.col("own.embedding").alias("vectors"))


def nearest(
    index: Index, questions: DataFrame, limit: int = 10, probes: int | None = None, key: str = "id", embedding: str = "embedding"
) -> DataFrame:
    """(question, id, score, place): the ``limit`` nearest rows of each question among its ``probes`` nearest cells."""
    spark, kind = questions.sparkSession, index.kind
    length = index.centres.shape[1] if index.centres.size else -1
    shared = spark.sparkContext.broadcast(index)
    asked = questions.select(F.col(key).alias("id"), _as_double(embedding).alias("embedding")).where(_usable("embedding", length))
    asked_type = asked.schema["id"].dataType.simpleString()

    @F.pandas_udf("array<int>")
    def cells_of(vectors: pd.Series) -> pd.Series:
        points = _matrix(vectors)
        return pd.Series(list(shared.value.nearest_cells(points, probes).astype("int32")) if len(points) else [], dtype=object)

    every = F.sequence(F.lit(0), F.lit(max(1, len(index.centres)) - 1))
    probed = asked.withColumn("cell", F.explode(every if probes is None else cells_of("embedding")))
    left = _blocks(probed, _QUESTIONS).select("cell", F.col("ids").alias("asked"), F.col("vectors").alias("asked_vectors"))
    right = _blocks(index.rows(spark).where("cell >= 0"), _ROWS)
    schema = f"question {asked_type}, id {index.id_type}, score double"

    def scored(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One pair of blocks as one matrix product."""
        rows = pa.Table.from_batches(parts).combine_chunks()
        asks = rows["asks"]
        own, others = rows.filter(asks), rows.filter(pc.invert(asks))
        matrix = lambda t: pc.list_flatten(t["vector"]).to_numpy().reshape(-1, length)
        order = np.argsort(others["id"].to_numpy(), kind="stable")
        found = np.round(_scores(kind, matrix(own), matrix(others)[order]), 12)
        few = np.argsort(-found, axis=1, kind="stable")[:, :limit]
        return pa.RecordBatch.from_arrays(
            [
                own["question"].combine_chunks().take(pa.array(np.repeat(np.arange(len(own)), few.shape[1]))),
                others["id"].combine_chunks().take(pa.array(order[few].reshape(-1))), pa.array(np.take_along_axis(found, few, axis=1).reshape(-1)),
            ],
            names=["question", "id", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if parts and pairs[a] != now:
                    yield scored(parts)
                    parts = []
                now = pairs[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield scored(parts)

    # A pair goes to Python as its vectors, a row each and one pair after the other: a batch of whole blocks would have no bound.
    pairs = left.join(right, "cell").select(F.monotonically_increasing_id().alias("pair"), "asked", "asked_vectors", "ids", "vectors")
    row = lambda asks, q, i, v: F.struct(F.lit(asks).alias("asks"), q.cast(asked_type).alias("question"), i.cast(index.id_type).alias("id"), v.alias("vector"))
    none = F.lit(None)
    own = F.zip_with("asked", "asked_vectors", lambda q, v: row(True, q, none, v))
    vectors = pairs.select("pair", F.explode(F.concat(own, F.zip_with("ids", "vectors", lambda i, v: row(False, none, i, v)))).alias("r"))
    pairs = vectors.select("pair", "r.asks", "r.question", "r.id", "r.vector").mapInArrow(score, schema)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("place", place).where(F.col("place") <= limit)


def nearest_one(spark: SparkSession, index: Index, vector: list[float], limit: int = 10, probes: int = 8) -> DataFrame:
    """(id, score) of the nearest rows to one vector; cells that are not asked for are pruned from the scan."""
    from loomery.functions import vectors

    cells = index.nearest_cells(np.array([vector], dtype=np.float64), probes)[0].tolist()
    own = F.array(*[F.lit(float(x)) for x in vector])
    rows = index.rows(spark).where(F.col("cell").isin(cells))
    return rows.select("id", vectors.similarity(index.kind, F.col("embedding"), own).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def recall(index: Index, questions: DataFrame, probes: list[int], limit: int = 10, **named) -> DataFrame:
    """(probes, found, wanted): how many of the exact nearest rows are found by reading that many cells."""
    exact = nearest(index, questions, limit, **named).select("question", "id")
    out = None
    for n in probes:
        got = exact.join(nearest(index, questions, limit, n, **named).select("question", "id").withColumn("hit", F.lit(1)), ["question", "id"], "left")
        one = got.agg(F.lit(n).alias("probes"), F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))
        out = one if out is None else out.unionByName(one)
    return out
