"""Parsed-corpus queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import collocations as c
from loomery.operators import parsing
from loomery.plans.collocation_queries import _SENTENCES
from loomery.plans.common import table


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.tagged(c.tokens(c.sentences(table(spark, sf_dir, "documents"))))


def pos_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("n_words"))


def parsed(spark: SparkSession, sf_dir: str, verbs: bool = False) -> DataFrame:
    """The documents' sentences (``verbs``: those with a verb), a row each, with their words, tags and edges."""
    return parsing.parsed_sentences(c.word_lists(c.sentences(table(spark, sf_dir, "documents"))), verbs=verbs)


def dependency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = parsed(spark, sf_dir).select(F.explode("edges").alias("e")).select("e.rel", (F.col("e.score") < 0.7).alias("candidate"))
    return edges.groupBy("rel", "candidate").agg(F.count(F.lit(1)).alias("n"))


def predicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed pairs with counts, weak evidence apart."""
    typed = c.typed_edges(parsed(spark, sf_dir))
    return typed.groupBy("w1", "w2", "type", "rel").agg(
        F.count_if(~F.col("candidate")).alias("c"), F.count_if("candidate").alias("weak")
    )


def sense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses of the words that open a sentence, from the longer words of the sentence."""
    sents = c.sentences(table(spark, sf_dir, "documents"))
    w = text.words(F.col("sentence"))
    bags = sents.select(F.get(w, F.lit(0)).alias("lu"), "doc_id", "sent_id", F.filter(w, lambda x: F.length(x) > 4).alias("words"))
    return parsing.sense_clusters(bags.where("lu is not null")).select("lu", "sense", "size", F.array_join("signature", ",").alias("signature"), "polysemy")


QUERIES = {f.__name__: f for f in (pos_counts, dependency_counts, predicate_pairs, sense_clusters)}

_CLOSED = ", ".join(f"('{w}', '{tag}')" for tag, words in parsing.CLOSED.items() for w in words)
_TAGGED = f"""{_SENTENCES}, closed AS (SELECT * FROM (VALUES {_CLOSED}) AS t(word, tag)),
tokens AS (
  SELECT doc_id, sent_id, idx, u.word, coalesce(tag, CASE WHEN regexp_matches(u.word, 'ly$') THEN 'd'
    WHEN regexp_matches(u.word, '(ing|ed|ise|ize)$') THEN 'v' ELSE 'n' END) AS pos
  FROM (SELECT doc_id, sent_id, unnest(w) AS word, unnest(range(len(w)))::INT AS idx FROM lists) u LEFT JOIN closed ON closed.word = u.word
)"""
_EDGES = """near AS (
  SELECT *, max(CASE WHEN pos IN ('n', 'r') THEN idx END) OVER before AS s, max(CASE WHEN pos = 'v' THEN idx END) OVER before AS bv,
    min(CASE WHEN pos = 'n' THEN idx END) OVER after AS o, min(CASE WHEN pos = 'v' THEN idx END) OVER after AS av
  FROM tokens WINDOW before AS (PARTITION BY doc_id, sent_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY doc_id, sent_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), edges AS (
  SELECT doc_id, sent_id, coalesce(av, bv) AS head, idx AS dep, 'advmod' AS rel, CASE WHEN abs(coalesce(av, bv) - idx) <= 1 THEN 0.8 ELSE 0.65 END AS score
  FROM near WHERE pos = 'd' AND coalesce(av, bv) IS NOT NULL
  UNION ALL SELECT doc_id, sent_id, idx, o, 'pobj', CASE WHEN o - idx <= 2 THEN 0.7 ELSE 0.55 END FROM near WHERE pos = 'p' AND o IS NOT NULL
  UNION ALL SELECT doc_id, sent_id, av, idx, 'prep', CASE WHEN av - idx <= 2 THEN 0.7 ELSE 0.55 END FROM near WHERE pos = 'p' AND o IS NOT NULL AND av IS NOT NULL
  UNION ALL SELECT doc_id, sent_id, idx, s, 'nsubj', CASE WHEN idx - s <= 1 THEN 0.8 ELSE 0.65 END FROM near n
    WHERE pos = 'v' AND s IS NOT NULL AND (bv IS NULL OR s > bv)
      AND NOT EXISTS (SELECT 1 FROM near p WHERE p.pos = 'p' AND p.doc_id = n.doc_id AND p.sent_id = n.sent_id AND p.o = n.s)
  UNION ALL SELECT doc_id, sent_id, idx, o, 'obj', CASE WHEN o - idx <= 1 THEN 0.8 ELSE 0.65 END FROM near
    WHERE pos = 'v' AND o IS NOT NULL AND (av IS NULL OR o < av)
)"""
SQL = {
    "pos_counts": f"WITH {_TAGGED} SELECT pos, count(*) AS n, count(DISTINCT word) AS n_words FROM tokens GROUP BY 1",
    "dependency_counts": f"WITH {_TAGGED}, {_EDGES} SELECT rel, score < 0.7 AS candidate, count(*) AS n FROM edges GROUP BY 1, 2",
    "predicate_pairs": f"""WITH {_TAGGED}, {_EDGES}, named AS (
  SELECT e.*, h.word AS w1, d.word AS w2 FROM edges e JOIN tokens h ON h.doc_id = e.doc_id AND h.sent_id = e.sent_id AND h.idx = e.head
    JOIN tokens d ON d.doc_id = e.doc_id AND d.sent_id = e.sent_id AND d.idx = e.dep
), typed AS (
  SELECT w1, w2, CASE WHEN rel IN ('obj', 'nsubj') THEN 'pred_noun' WHEN rel = 'advmod' THEN 'pred_adv' WHEN rel = 'prep' THEN 'pred_prep' ELSE 'prep_pobj' END AS type,
    rel, score < 0.7 AS candidate FROM named n
  WHERE rel NOT IN ('obj', 'nsubj') OR NOT EXISTS (
    SELECT 1 FROM edges p WHERE p.rel = 'pobj' AND p.doc_id = n.doc_id AND p.sent_id = n.sent_id AND p.dep = n.dep)
)
SELECT w1, w2, type, rel, count(*) FILTER (NOT candidate) AS c, count(*) FILTER (candidate) AS weak FROM typed GROUP BY ALL""",
}
