"""Reports of the given tables, written as cards and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.lineage import shared_folder
from loomery.plans.common import table
from loomery.plans.knowledge_queries import RELATIONS_SQL, relations
from loomery.sinks import reports
from loomery.sources.cards import CardSource


def _lexicon(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers' nations as frames: segments as elements, customers as units, suppliers' money as relations."""
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    frame = lambda column: F.concat(F.lit("N"), F.col(column).cast("string")).alias("frame")
    core = F.when(F.length("c_mktsegment") > 9, "Peripheral").otherwise("Core").alias("core")
    about = F.concat(F.lit("Customers of the segment "), F.col("c_mktsegment")).alias("definition")
    known = n.where("n_nationkey <> 3").select(frame("n_nationkey"), F.concat(F.lit(" "), F.repeat(F.concat(F.col("n_name"), F.lit(" trades. ")), F.lit(60))).alias("definition"))
    far = F.concat(F.lit("N"), ((F.col("s_suppkey") * 7) % 25).cast("string"))
    return {
        "frames": known,
        "elements": c.select(frame("c_nationkey"), F.col("c_mktsegment").alias("fe"), core, about).distinct(),
        "units": c.select(F.col("c_custkey").cast("string").alias("lemma"), F.lower(F.left("c_mktsegment", F.lit(1))).alias("pos"), frame("c_nationkey")),
        "relations": s.select(
            F.when(F.col("s_acctbal") > 0, "Using").otherwise("See_also").alias("type"), frame("s_nationkey").alias("sub"), far.alias("super"), F.col("s_suppkey").cast("int").alias("ord")
        ),
    }


def lexicon_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lexicon_reports(_lexicon(spark, sf_dir))


def lexicon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unknown_frames(_lexicon(spark, sf_dir))


def annotation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: orders are fragments and their lines annotated words; written as cards, a file a document, and read back."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fragment = F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("fragment_id")
    value = F.element_at(F.array(*map(F.lit, reports.VALUES)), (F.left("o_orderpriority", F.lit(1)).cast("int") % 4 + 1)).alias("value")
    doc = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id")
    fragments = o.select(doc, fragment, value)
    words = o.select(doc, fragment, "o_orderkey").join(l.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    sure = F.element_at(F.array(*map(F.lit, reports.CONFIDENCES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    frame = F.when(F.col("l_partkey") % 4 != 3, F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")))
    annotations = words.select(
        "doc_id", "fragment_id", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"),
        F.concat(F.col("l_returnflag"), F.col("l_partkey").cast("string")).alias("word"), frame.alias("frame"), sure.alias("confidence"),
    )
    tied = relations(spark, sf_dir).where("type <> 'See_also'")
    tied = tied.groupBy("sub", "super", "type").agg(F.min("ord").alias("ord")).select(
        F.col("sub").alias("doc_id"), F.col("sub").alias("source"), F.col("super").alias("target"), F.col("type").alias("kind"), F.concat(F.lit("order "), F.col("ord").cast("string")).alias("detail")
    )
    made = reports.annotation_reports(fragments, annotations, tied)
    spark.dataSource.register(CardSource)
    root = f"{shared_folder(spark).removeprefix('file://')}/loomery-reports-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    made.select(F.lit("debug").alias("stage"), F.lit("labeling").alias("layer"), F.col("doc_id").alias("artifact_id"), none.alias("title"), F.col("report").alias("content")).write.format(
        "cards"
    ).mode("append").save(root)
    return spark.read.format("cards").load(root).select(F.col("artifact_id").alias("doc_id"), F.col("content").alias("report"))


QUERIES = {f.__name__: f for f in (lexicon_reports, lexicon_gaps, annotation_reports)}

_LEX = """f AS (SELECT 'N' || n_nationkey AS frame, repeat(n_name || ' trades. ', 60) AS d FROM nation WHERE n_nationkey <> 3),
e AS (SELECT DISTINCT 'N' || c_nationkey AS frame, c_mktsegment AS fe, CASE WHEN length(c_mktsegment) > 9 THEN 'Peripheral' ELSE 'Core' END AS core FROM customer),
u AS (SELECT 'N' || c_nationkey AS frame, c_custkey || '.' || lower(c_mktsegment[1]) AS unit FROM customer),
r AS (SELECT CASE WHEN s_acctbal > 0 THEN 'Using' ELSE 'See_also' END AS type, 'N' || s_nationkey AS sub, 'N' || (s_suppkey * 7 % 25) AS super, s_suppkey AS ord FROM supplier)"""
_NL = "chr(10)"
SQL = {
    "lexicon_gaps": f"""WITH {_LEX}, x AS (SELECT 'units' AS part, frame FROM u UNION ALL SELECT 'elements', frame FROM e
  UNION ALL SELECT 'relations', sub FROM r UNION ALL SELECT 'relations', super FROM r)
SELECT part, frame, count(*) AS n FROM x WHERE frame NOT IN (SELECT frame FROM f) GROUP BY ALL""",
    "lexicon_reports": f"""WITH {_LEX}, es AS (
  SELECT frame, string_agg('- **' || fe || '**: Customers of the segment ' || fe, {_NL} ORDER BY fe) FILTER (core = 'Core') AS c,
    string_agg('- **' || fe || '**: Customers of the segment ' || fe, {_NL} ORDER BY fe) FILTER (core = 'Peripheral') AS p FROM e GROUP BY 1
), us AS (SELECT frame, string_agg('`' || unit || '`', ', ' ORDER BY unit) AS u FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY unit) AS k FROM u) WHERE k <= 20 GROUP BY 1),
b AS (SELECT sub AS frame, * FROM r UNION ALL SELECT super, * FROM r WHERE super <> sub),
rs AS (SELECT frame, string_agg('- ' || type || ': ' || sub || ' → ' || super, {_NL} ORDER BY ord) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ord) AS k FROM b) WHERE k <= 15 GROUP BY 1)
SELECT frame, '# ' || frame || {_NL} || {_NL} || substr(trim(d), 1, 500) || {_NL} || {_NL} || '## Core elements' || {_NL} || {_NL} || coalesce(c, '(none)')
  || {_NL} || {_NL} || '## Peripheral elements' || {_NL} || {_NL} || coalesce(p, '(none)')
  || coalesce({_NL} || {_NL} || '## Units (first 20)' || {_NL} || {_NL} || u, '') || coalesce({_NL} || {_NL} || '## Relations' || {_NL} || {_NL} || r, '') || {_NL} AS report
FROM f LEFT JOIN es USING (frame) LEFT JOIN us USING (frame) LEFT JOIN rs USING (frame)""",
    "annotation_reports": f"""WITH f AS (
  SELECT 'c' || o_custkey AS doc_id, 'F' || o_orderkey AS fid, o_orderkey, ['high', 'medium', 'low', 'skip'][o_orderpriority[1]::INT % 4 + 1] AS v FROM orders
), a AS (
  SELECT doc_id, fid, l_linenumber AS p1, l_partkey AS p2, l_suppkey AS p3, l_extendedprice AS p4, l_returnflag || l_partkey AS word,
    CASE WHEN l_partkey % 4 <> 3 THEN 'S' || (l_suppkey % 10) END AS frame, l_partkey % 4 AS k FROM f JOIN lineitem ON l_orderkey = o_orderkey
), c AS (
  SELECT doc_id, count(*) AS n, [count(*) FILTER (v = 'high'), count(*) FILTER (v = 'medium'), count(*) FILTER (v = 'low'), count(*) FILTER (v = 'skip')] AS vs,
    string_agg(fid, ', ' ORDER BY fid) FILTER (v IN ('low', 'skip')) AS skipped FROM f GROUP BY 1
), w AS (SELECT doc_id, [count(*) FILTER (k = 0), count(*) FILTER (k = 1), count(*) FILTER (k = 2), count(*) FILTER (k = 3)] AS ks FROM a GROUP BY 1),
x AS (
  SELECT doc_id, frame, string_agg(DISTINCT word, ', ' ORDER BY word) AS ws, string_agg(DISTINCT fid, ', ' ORDER BY fid) AS fs, min(k) AS best FROM a WHERE frame IS NOT NULL GROUP BY 1, 2
), i AS (
  SELECT doc_id, string_agg('| ' || frame || ' | ' || ws || ' | ' || fs || ' | ' || ['[+++] high', '[++] medium', '[+] low'][best + 1] || ' |', {_NL} ORDER BY frame) AS t FROM x GROUP BY 1
), e AS (
  SELECT doc_id, fid, string_agg(word || ': ' || coalesce(frame, '-'), '; ' ORDER BY p1, p2, p3, p4, word || ': ' || coalesce(frame, '-')) AS t FROM a GROUP BY 1, 2
), es AS (SELECT doc_id, string_agg('- ' || fid || ' ' || t, {_NL} ORDER BY fid) AS t FROM e GROUP BY 1),
{RELATIONS_SQL}, g AS (SELECT sub, super, type, min(ord) AS ord FROM relations WHERE type <> 'See_also' GROUP BY 1, 2, 3),
r AS (SELECT sub AS doc_id, string_agg('| ' || sub || ' | ' || super || ' | ' || type || ' | order ' || ord || ' |', {_NL} ORDER BY super, type) AS t FROM g GROUP BY 1)
SELECT c.doc_id, '# Annotation of ' || c.doc_id || {_NL} || {_NL} || '## Figures' || {_NL} || {_NL} || '| What | Number |' || {_NL} || '|---|---|' || {_NL}
  || '| fragments | ' || n || ' |' || {_NL} || array_to_string([['high', 'medium', 'low', 'skip'][j] || ' value | ' || vs[j] for j in range(1, 5)], ' |' || {_NL} || '| ')
    .regexp_replace('^', '| ') || ' |' || {_NL}
  || array_to_string([['high', 'medium', 'low', 'none'][j] || ' confidence | ' || coalesce(ks[j], 0) for j in range(1, 5)], ' |' || {_NL} || '| ').regexp_replace('^', '| ') || ' |'
  || coalesce({_NL} || {_NL} || '## Frames' || {_NL} || {_NL} || '| Frame | Words | Fragments | Confidence |' || {_NL} || '|---|---|---|---|' || {_NL} || i.t, '')
  || coalesce({_NL} || {_NL} || '## Relations' || {_NL} || {_NL} || '| Source | Target | Kind | Detail |' || {_NL} || '|---|---|---|---|' || {_NL} || r.t, '')
  || coalesce({_NL} || {_NL} || '## Fragments' || {_NL} || {_NL} || es.t, '') || coalesce({_NL} || {_NL} || '## Left out' || {_NL} || {_NL} || skipped, '') || {_NL} AS report
FROM c LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN es USING (doc_id) LEFT JOIN r USING (doc_id)""",
}
