"""Collocation queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.lineage import stored
from loomery.operators import collocations as c
from loomery.plans.common import by_document, table


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.sentences(table(spark, sf_dir, "documents"))


def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir)


def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unigrams(_sentences(spark, sf_dir))


def _ngrams(spark: SparkSession, sf_dir: str, most: int = 2, lengths: tuple[int, ...] | None = None) -> DataFrame:
    return c.ngram_counts(c.sentences(by_document(spark, sf_dir)), most, lengths)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of all documents, counted in one scan and written, for the branches behind."""
    return stored(_ngrams(spark, sf_dir))


def _scored(counts: DataFrame) -> DataFrame:
    return c.gated(c.with_counts(c.of_length(counts, 2), c.of_length(counts, 1)))


def _passed(counts: DataFrame) -> DataFrame:
    return _scored(c.promising(counts)).where("passed")


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that pass; what cannot is not written."""
    return _scored(stored(c.promising(_ngrams(spark, sf_dir)))).where("passed")


def colloc_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir).select("w1", "w2", F.col("c").alias("c11"), "df", "c1", "c2", "llr", "level")


def colloc_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most pairs are rejected by their own counts and only counted; the others meet their words' counts."""
    counts = _counts(spark, sf_dir)
    late = _scored(c.promising(counts)).where("not passed").select("rejected_reason", "c")
    rows = c.rejected_early(c.of_length(counts, 2)).unionByName(late)
    return rows.groupBy("rejected_reason").agg(F.count(F.lit(1)).alias("pairs"), F.sum("c").alias("edges"))


def colloc_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five supporting sentences of the pairs that pass, as text keys, with the first one's text."""
    sents = _sentences(spark, sf_dir)
    passed = _passing(spark, sf_dir).select("w1", "w2")
    edges = c.adjacent_edges(sents).join(passed, ["w1", "w2"], "left_semi")
    listed = c.first_examples(edges)
    first = F.col("sents")[0]
    rows = listed.select("w1", "w2", "sents", first["doc_id"].alias("doc_id"), first["sent_id"].alias("sent_id"))
    texts = sents.select("doc_id", "sent_id", F.substring("sentence", 1, 80).alias("example"))
    keys = F.transform("sents", lambda s: F.concat_ws(":", s["doc_id"].cast("string"), s["sent_id"].cast("string")))
    return rows.join(texts, ["doc_id", "sent_id"]).select("w1", "w2", F.array_join(keys, ",").alias("sents"), "example")


def colloc_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred strongest pairs of each level, for the report."""
    rows = _passing(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("llr"), "w1", "w2"))
    return rows.withColumn("rank", rank).where("rank <= 100").select("level", "rank", "w1", "w2", "llr")


def word_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No documents are counted here, so pairs are counted where they are cut and move once, and neither texts nor pairs by document do."""
    return c.object_entropy(c.adjacent_edges(_sentences(spark, sf_dir)).select("w1", "w2", F.lit(1).alias("c")))


def trigram_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triple with its information.  Words are counted first and written; triples, nearly as many as words in the texts, move once and are not."""
    words = stored(c.unigrams(_sentences(spark, sf_dir)))
    triples = c.of_length(_ngrams(spark, sf_dir, 3, (3,)), 3)
    return c.trigram_information(triples, words).select("w1", "w2", "w3", "c", "df", "pmi3")


def trigram_partial_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples below the templates' count are not written."""
    grams = _ngrams(spark, sf_dir, 3)
    counts = stored(grams.where(F.col("w3").isNull() | (F.col("c") >= c.LATIN.template_count)))
    made = c.templates(*(c.of_length(counts, n) for n in (3, 2, 1)))
    return made.select("w1", "w2", "w3", "c", "c12", "pmi_partial", "passed")


def colloc_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    return c.whitelist(c.object_entropy(c.of_length(counts, 2)), _passed(counts))


def colloc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts by stage, observed while the one scan runs; of the counted pairs the rest."""
    seen = {name: Observation(name) for name in ("documents", "sentences")}
    one = F.count(F.lit(1)).alias("n")
    docs = by_document(spark, sf_dir).observe(seen["documents"], one)
    counts = stored(c.ngram_counts(c.sentences(docs).observe(seen["sentences"], one)))
    local = spark.createDataFrame([(name, o.get["n"]) for name, o in seen.items()], "stage string, n_rows long")
    pairs = c.of_length(counts, 2).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("pairs"))
    pairs = pairs.unpivot([], ["edges", "pairs"], "stage", "n_rows")
    passed = _passed(counts).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("passed").alias("stage"), "n_rows")
    return local.unionByName(pairs).unionByName(passed)


QUERIES = {
    f.__name__: f
    for f in (
        sentence_filter, unigram_counts, colloc_llr, colloc_rejected, colloc_examples, colloc_top, word_entropy,
        trigram_pmi, trigram_partial_pmi, colloc_whitelist, colloc_report,
    )
}

_SENTENCES = rf"""
segments AS (
  SELECT doc_id, (unnest(range(len(a))))::INT AS sent_id, trim(unnest(a), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS s
  FROM (SELECT doc_id, string_split_regex(text, '[。！？!?；;\n.]') AS a FROM documents)
), whole AS (
  SELECT *, trim(regexp_replace(s, '{text.LEADER}', ''),
    chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS bare
  FROM segments WHERE length(s) >= 4 AND NOT regexp_matches(s, '^[\d\t|、，,。/\\ \-\+%=]+$')
), sentences AS (
  SELECT doc_id, sent_id, substr(CASE WHEN bare <> '' THEN bare ELSE s END, 1, 200) AS sentence FROM whole
), lists AS (SELECT doc_id, sent_id, regexp_extract_all(lower(sentence), '(\p{{L}}+)') AS w FROM sentences)"""

_PAIRS = """
words AS (SELECT doc_id, sent_id, unnest(w) AS word, unnest(range(len(w))) AS idx FROM lists),
uni AS (SELECT word, count(DISTINCT (doc_id, sent_id)) AS c FROM words GROUP BY word),
total AS (SELECT sum(c)::BIGINT AS n FROM uni),
edges AS (
  SELECT doc_id, sent_id, idx, word AS w1, lead(word) OVER (PARTITION BY doc_id, sent_id ORDER BY idx) AS w2 FROM words
), pairs AS (
  SELECT w1, w2, count(*) AS c, count(DISTINCT doc_id) AS df FROM edges WHERE w2 IS NOT NULL GROUP BY w1, w2
)"""

_GATED = """
counted AS (
  SELECT p.w1, p.w2, p.c::DOUBLE AS c, df, a.c::DOUBLE AS c1, b.c::DOUBLE AS c2, n::DOUBLE AS n
  FROM pairs p JOIN uni a ON a.word = p.w1 JOIN uni b ON b.word = p.w2, total
), scored AS (
  SELECT *, CASE WHEN c <= 4 THEN 'freq<=4' WHEN df < 3 THEN 'df<3' END AS early,
    2 * (
      CASE WHEN c > 0 THEN c * ln(c / (c1 * c2 / n)) ELSE 0 END
      + CASE WHEN c1 - c > 0 AND n > c2 THEN (c1 - c) * ln((c1 - c) / (c1 * (n - c2) / n)) ELSE 0 END
      + CASE WHEN c2 - c > 0 AND n > c1 THEN (c2 - c) * ln((c2 - c) / ((n - c1) * c2 / n)) ELSE 0 END
      + CASE WHEN n - c1 - c2 + c > 0 AND n > c1 AND n > c2
          THEN (n - c1 - c2 + c) * ln((n - c1 - c2 + c) / ((n - c1) * (n - c2) / n)) ELSE 0 END
    ) AS raw
  FROM counted
), gated AS (
  SELECT w1, w2, c::BIGINT AS c, df, c1::BIGINT AS c1, c2::BIGINT AS c2, round(raw, 4) AS llr,
    coalesce(early, CASE WHEN raw <= 3.84 THEN 'llr<=3.84' END) AS rejected_reason,
    CASE WHEN raw > 6.63 THEN 'golden' ELSE 'normal' END AS level
  FROM scored
)"""

_ENTROPY = """
counts AS (
  SELECT w1, w2, sum(c)::BIGINT AS c FROM pairs
  WHERE lower(w2) NOT IN ('true', 'false', 'yes', 'no', 'none', 'null', 'null值', 'undefined') GROUP BY w1, w2
), shares AS (
  SELECT w1, w2, c, (c + 1.0::DOUBLE) / (sum(c) OVER (PARTITION BY w1) + count(*) OVER (PARTITION BY w1)) AS p,
    row_number() OVER (PARTITION BY w1 ORDER BY c DESC, w2) AS rank
  FROM counts
), each AS (
  SELECT w1, sum(c)::BIGINT AS c_v, count(*) AS n_nouns, 0 - sum(p * log2(p)) AS h,
    string_agg(w2, ',' ORDER BY rank) FILTER (rank <= 5) AS top_nouns
  FROM shares GROUP BY w1
), normed AS (SELECT *, h / log2(greatest(2, n_nouns)) AS hn FROM each),
entropy AS (
  SELECT w1, c_v, n_nouns, round(h, 4) AS h, round(hn, 4) AS h_norm,
    CASE WHEN c_v < 5 THEN 'Keep_Watch' WHEN n_nouns < 3 THEN 'Keep_Watch' WHEN hn >= 0.85 THEN 'Drop_Light_Verb'
      WHEN hn <= 0.35 THEN 'Active_LU' ELSE 'Keep_Watch' END AS tag,
    CASE WHEN c_v < 5 THEN 'sample_limited(c<5)' WHEN n_nouns < 3 THEN 'objects<3'
      WHEN hn >= 0.85 THEN 'high_entropy>=0.85' WHEN hn <= 0.35 THEN 'low_entropy<=0.35' ELSE '0.35<h_norm<0.85' END AS note,
    top_nouns
  FROM normed
)"""

_TRIGRAMS = """
triples AS (
  SELECT doc_id, word AS w1, lead(word) OVER s AS w2, lead(word, 2) OVER s AS w3
  FROM words WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY idx)
), trigrams AS (
  SELECT w1, w2, w3, count(*) AS c, count(DISTINCT doc_id) AS df
  FROM triples WHERE w3 IS NOT NULL GROUP BY ALL
)"""

SQL = {
    "sentence_filter": f"WITH {_SENTENCES} SELECT * FROM sentences",
    "unigram_counts": f"WITH {_SENTENCES}, {_PAIRS} SELECT * FROM uni",
    "colloc_llr": f"""WITH {_SENTENCES}, {_PAIRS}, {_GATED}
SELECT w1, w2, c AS c11, df, c1, c2, llr, level FROM gated WHERE rejected_reason IS NULL""",
    "colloc_rejected": f"""WITH {_SENTENCES}, {_PAIRS}, {_GATED}
SELECT rejected_reason, count(*) AS pairs, sum(c)::BIGINT AS edges FROM gated WHERE rejected_reason IS NOT NULL GROUP BY 1""",
    "colloc_examples": f"""WITH {_SENTENCES}, {_PAIRS}, {_GATED}, seen AS (
  SELECT DISTINCT e.w1, e.w2, doc_id, sent_id FROM edges e JOIN gated g ON g.w1 = e.w1 AND g.w2 = e.w2 WHERE rejected_reason IS NULL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY doc_id, sent_id) AS rank FROM seen)
SELECT w1, w2, string_agg(doc_id || ':' || sent_id, ',' ORDER BY rank) AS sents,
  min(substr(sentence, 1, 80)) FILTER (rank = 1) AS example
FROM ranked JOIN sentences USING (doc_id, sent_id) WHERE rank <= 5 GROUP BY w1, w2""",
    "colloc_top": f"""WITH {_SENTENCES}, {_PAIRS}, {_GATED}
SELECT * FROM (
  SELECT level, (row_number() OVER (PARTITION BY level ORDER BY llr DESC, w1, w2))::INT AS rank, w1, w2, llr
  FROM gated WHERE rejected_reason IS NULL) WHERE rank <= 100""",
    "word_entropy": f"WITH {_SENTENCES}, {_PAIRS}, {_ENTROPY} SELECT * FROM entropy",
    "trigram_pmi": f"""WITH {_SENTENCES}, {_PAIRS}, {_TRIGRAMS}
SELECT w1, w2, w3, t.c, df, round(log2(t.c::DOUBLE * n / (a.c::DOUBLE * b.c * d.c)), 4) AS pmi3
FROM trigrams t JOIN uni a ON a.word = w1 JOIN uni b ON b.word = w2 JOIN uni d ON d.word = w3, total""",
    "trigram_partial_pmi": f"""WITH {_SENTENCES}, {_PAIRS}, {_TRIGRAMS}, both_ways AS (
  SELECT w1, w2, sum(c)::BIGINT AS c12 FROM (SELECT w1, w2, c FROM pairs UNION ALL SELECT w2, w1, c FROM pairs) GROUP BY 1, 2
), partial AS (
  SELECT w1, w2, w3, t.c, c12, log2(t.c::DOUBLE * n / (c12::DOUBLE * d.c)) AS raw
  FROM trigrams t JOIN both_ways USING (w1, w2) JOIN uni d ON d.word = w3, total WHERE t.c >= 2
) SELECT w1, w2, w3, c, c12, round(raw, 4) AS pmi_partial, raw >= 1.5 AS passed FROM partial""",
    "colloc_whitelist": f"""WITH {_SENTENCES}, {_PAIRS}, {_GATED}, {_ENTROPY}
SELECT w1 AS word FROM entropy WHERE tag = 'Active_LU' UNION SELECT w1 FROM gated WHERE rejected_reason IS NULL""",
    "colloc_report": f"""WITH {_SENTENCES}, {_PAIRS}, {_GATED}
SELECT 'documents' AS stage, count(*) AS n_rows FROM documents UNION ALL SELECT 'sentences', count(*) FROM sentences
UNION ALL SELECT 'edges', count(*) FROM edges WHERE w2 IS NOT NULL UNION ALL SELECT 'pairs', count(*) FROM pairs
UNION ALL SELECT 'passed', count(*) FROM gated WHERE rejected_reason IS NULL""",
}
