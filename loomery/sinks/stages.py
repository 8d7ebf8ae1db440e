"""Stages of a pipeline written one after the other, counted while they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomery import sinks
from loomery.operators import collocations as c


def write_stage(rows: DataFrame, path: str, name: str) -> tuple[DataFrame, int]:
    """Write a stage as JSON lines below ``path``; (the written rows, their number).  The rows are worked out once."""
    seen = Observation(name)
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/{name}")
    return rows.sparkSession.read.schema(rows.schema).json(f"{path}/{name}"), seen.get["n"]


def top_rows(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each type with their place; a task's first ones are picked before rows move."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def write_collocations(docs: DataFrame, path: str, p: c.Params = c.LATIN, most: int = 200) -> DataFrame:
    """Sentences, pairs, rejected pairs, entropies, triples and templates as files, each from those written before.

    The documents are read once.  Beside the stages lies ``tables/<stage>.md``, a table of the first
    ``most`` rows of each type; returned is (stage, n_rows).
    """
    spark: SparkSession = docs.sparkSession
    counted: list[tuple[str, int]] = []

    def stage(rows: DataFrame, name: str, order: list, by: str | None = None) -> DataFrame:
        written, n = write_stage(rows, path, name)
        counted.append((name, n))
        first = top_rows(written, by, order, most).orderBy(by, "place").drop("place") if by else written.orderBy(*order).limit(most)
        types = written.select(by).distinct().count() if by else 1
        table = sinks.markdown_table(first, name, f"{n} rows; the first {most} of each type", limit=most * max(1, types))
        spark.createDataFrame([(table,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/tables/{name}.md")
        return written

    sents = stage(c.sentences(docs, p), "sentences", ["doc_id", "sent_id"])
    counts = stage(c.ngram_counts(sents, 3), "ngrams", [F.desc("c"), "w1", "w2", "w3"])
    words, pairs, triples = (c.of_length(counts, n) for n in (1, 2, 3))
    scored = c.gated(c.with_counts(pairs, words), p)
    passed = stage(scored.where("passed").drop("passed", "rejected_reason"), "pairs", [F.desc("llr"), "w1", "w2"], "level")
    stage(scored.where("not passed").select("w1", "w2", "c", "df", "rejected_reason"), "rejected", [F.desc("c"), "w1", "w2"], "rejected_reason")
    entropy = stage(c.object_entropy(pairs, p), "entropy", [F.desc("c_v"), "w1"], "tag")
    stage(c.whitelist(entropy, passed.withColumn("passed", F.lit(True))), "whitelist", ["word"])
    stage(c.trigram_information(triples, words).select("w1", "w2", "w3", "c", "df", "pmi3"), "triples", [F.desc("pmi3"), "w1", "w2", "w3"])
    made = c.templates(triples, pairs, words, p).select("w1", "w2", "w3", "c", "c12", "pmi_partial", F.col("passed").cast("string").alias("passed"))
    stage(made, "templates", [F.desc("pmi_partial"), "w1", "w2", "w3"], "passed")
    return spark.createDataFrame(counted, "stage string, n_rows long")
