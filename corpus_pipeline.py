"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents`` (``n_chars`` follows the text); the last returns the packing.
Stages read their input several times, so give them a table; ``run`` cuts the lineage
between stages by reliable checkpoints.  Extra columns are passed through whatever their names.

No SQL is given: a trained classifier and the tokenizer's merges are none.  The tests hold
each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm import linededup, minhash, packing, pii, quality
from loomery.llm.util import cut, read


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _bare(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id and text, and every other column under a name that no operator gives a column of its own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[_column(c).alias(f"other_{i}") for i, c in enumerate(others)])


def _whole(made: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` out of those of :func:`_bare`, with the text from column ``text`` and n_chars to match."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = {"doc_id": F.col("doc_id"), "text": F.col(text)} | {c: F.col(f"other_{i}") for i, c in enumerate(others)}
    if "n_chars" in named:
        named["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return made.select(*[named[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    labels, bare = read(spark, sf_dir, "labels"), _bare(docs)
    model = quality.train(bare, labels.where(~quality.held_out()))
    kept = quality.score(bare, model, extra=tuple(bare.columns)).where("score >= 0.5")
    return _whole(kept, docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats or nearly repeats go; every document stays."""
    return _whole(linededup.dedup_lines(_bare(docs)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; of rows with one id and text one stays.

    Rows without an id are in no group; of those with one text one stays.
    """
    bare = _bare(docs)
    kept = minhash.near_duplicates(bare).where("kept and doc_id is not null").select("doc_id").distinct()
    # Spark keeps a task's first row of each window before rows move, so that a row repeated very often is no task's work.
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*by))
    known = bare.join(kept, "doc_id", "left_semi").withColumn("copy", first("doc_id", F.sha2("text", 256)))
    nameless = bare.where("doc_id is null").withColumn("copy", first(F.sha2("text", 256)))
    return _whole(known.unionByName(nameless).where("copy = 1"), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by tags; every document stays."""
    bare = _bare(docs)
    made = pii.find(bare, pii.train(bare), extra=tuple(c for c in bare.columns if c != "text"))
    return _whole(made, docs, "redacted")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
