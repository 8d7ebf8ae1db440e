"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows cost much more to work on than to move.
_TEXTS = ("documents", "pages")


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows out if their scan has fewer splits than the session has cores.

    A file of one row group is one task's work however many splits it is cut into.  A scan with
    more splits than cores, as any large table has, stays as it is: nothing moves.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in _TEXTS else rows


def dealt(rows: DataFrame, key: str, parts: int = 8) -> DataFrame:
    """A scan's rows dealt out by key in ``parts`` tasks a split, so that a task's share does not grow with the table."""
    return rows.repartition(parts * max(1, rows.rdd.getNumPartitions()), key)


def by_document(spark: SparkSession, sf_dir: str, parts: int = 32) -> DataFrame:
    """``documents`` dealt out by id, so that what is counted a document is counted where its text is.

    Texts are a fraction of their n-grams, so they are the cheapest to move; in ``parts`` tasks a split, as a
    split's n-grams would not fit into one task's memory.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.repartition(parts * max(1, rows.rdd.getNumPartitions()), "doc_id")
