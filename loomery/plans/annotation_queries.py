"""Queries of annotation, retrieval and id operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text, vectors
from loomery.lineage import stored
from loomery.operators import chat, entities, lexicon, store
from loomery.operators import collocations as c
from loomery.plans.common import table
from loomery.plans.parsing_queries import _EDGES, _TAGGED, parsed
from loomery.plans.state_queries import _VECTOR, QUERY_VECTOR

# Fixed value: the DNS namespace of name-based UUIDs.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
TEMPLATE = "Word {word} in {place}: choose one of {frames}. {word}?"


def tagged_trigram_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples around verbs with count, documents and the first five sentences; written once, as parsing costs much more than its triples."""
    found = stored(c.sentence_trigrams(parsed(spark, sf_dir, verbs=True)))
    by = ("w1", "w2", "w3", "type")
    samples = F.array_join(F.transform("sents", lambda s: F.concat_ws(":", s["doc_id"].cast("string"), s["sent_id"].cast("string"))), ",")
    return c.pair_counts(found, by).join(c.first_examples(found, by).withColumn("sents", samples), list(by))


def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotations of their customer: priority as confidence, status as source."""
    o = table(spark, sf_dir, "orders")
    confidence = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium")
    confidence = confidence.when(F.col("o_orderpriority").startswith("3"), "low")
    source = F.when(F.col("o_orderstatus") == "F", "lu").when(F.col("o_orderstatus") == "O", "llm")
    return lexicon.distribution(o.select(F.col("o_custkey").alias("fragment_id"), confidence.alias("confidence"), source.alias("source")))


def used_tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each line of an assistant's turn as the tools it called."""
    turns = table(spark, sf_dir, "conversations")
    calls = F.transform(F.split("text", "\n"), lambda line: F.lower(F.substring_index(line, " ", 1)))
    made = chat.used_tools(turns.select("conv_id", "role", calls.alias("calls")))
    return made.select("conv_id", F.size("tools").alias("n"), F.array_join("tools", ",").alias("tools"))


def two_stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of four vectors: ten by their best one, among the first 81 vectors."""
    e = table(spark, sf_dir, "embeddings")
    score = F.round(vectors.cosine(F.col("embedding"), F.array(*map(F.lit, QUERY_VECTOR))), 6)
    return store.two_stage_limit(e.select(F.floor(F.col("vec_id") / 4).alias("item"), F.col("vec_id").alias("path"), score.alias("score")), 10, 4)


def vector_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose brand and type have a vector already (those of the smaller sizes), and how many have none."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("name"), F.col("p_type").alias("text"))
    key = F.md5(F.concat_ws("|", "name", "text")).alias("fingerprint")
    cache = p.where("p_size <= 5").select(key, F.length("text").alias("vector")).distinct()
    found, missing = store.cached_vectors(cache, p)
    each = [rows.groupBy("name").agg(F.count(F.lit(1)).alias(n)) for rows, n in ((found, "found"), (missing, "missing"))]
    zero = F.lit(0).cast("long")
    return each[0].join(each[1], "name", "full").select("name", F.coalesce("found", zero).alias("found"), F.coalesce("missing", zero).alias("missing"))


def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based and time-ordered ids of events."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    name = F.concat_ws("/", "event_type", F.col("event_id").cast("string"))
    return e.select("event_id", text.name_id(NAMESPACE, name).alias("named"), text.time_id(micros, F.col("event_id"), F.col("user_id")).alias("timed"))


def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many Latin words it has and a digest of where they are."""
    rows = c.word_offsets(table(spark, sf_dir, "documents"))
    at = F.col("start") * F.length("word") + F.col("end")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last_end"), F.sum(at).alias("places"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    frames = F.array_join(F.array_sort(F.split("p_name", " ")), ", ")
    prompt = text.filled(TEMPLATE, word=F.col("p_type"), place=F.when(F.col("p_size") > 10, F.col("p_brand")), frames=frames)
    return p.select("p_partkey", prompt.alias("prompt"))


def derived_qualia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each nation's frame out of parts: by a placeholder, a type and an element's value."""
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    roles = F.create_map(F.lit("telic"), F.split("p_name", " "), F.lit("formal"), F.array("p_type"))
    things = p.select("id", F.col("p_brand").alias("type"), roles.alias("qualia"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("frame"), F.col("n_nationkey").alias("k"))
    rule = lambda fe, kind, ref, role: F.struct(F.lit(fe).alias("fe"), F.lit(kind).alias("kind"), ref.alias("ref"), F.lit(role).alias("role"))
    key = F.col("k").cast("string")
    listed = F.array(
        rule("goal", "placeholder", F.concat(F.lit("p"), key), "telic"), rule("form", "type", F.concat(F.lit("Brand#"), key), "formal"),
        rule("use", "element", F.lit("tool"), "telic"),
    )
    rules = n.select("frame", F.explode(listed).alias("r")).select("frame", "r.*")
    context = n.select(F.concat(F.lit("p"), key).alias("name"), (F.col("k") + 1).cast("string").alias("id"))
    bound = n.select("frame", F.lit("tool").alias("fe"), F.when(F.col("k") < 20, (F.col("k") + 2).cast("string")).alias("value"))
    found = entities.derived_qualia(rules, context, bound, things)
    return found.groupBy("frame", "fe", "value").agg(F.count(F.lit(1)).alias("n"))


def activated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as actions, that stand for a region's frame."""
    actions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.col("c_mktsegment").alias("action"))
    segments = F.row_number().over(c.Window.orderBy("action"))  # five segments
    roles = actions.select("action").distinct().withColumn("k", segments - 1)
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("frame"), F.col("r_name").alias("name"), F.lower("r_name").alias("definition"))
    named = roles.join(r, F.col("k") == F.col("frame")).select("action", "name")
    return entities.activated(actions, named, r)


QUERIES = {
    f.__name__: f
    for f in (
        tagged_trigram_samples, confidence_distribution, used_tool_names, two_stage_topk, vector_cache_keys, event_ids, word_offsets, prompt_texts,
        derived_qualia, activated_frames,
    )
}

_SPACE = NAMESPACE.replace("-", "")
_CUT = lambda x: " || '-' || ".join(f"substr({x}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

SQL = {
    "tagged_trigram_samples": f"""WITH {_TAGGED}, {_EDGES}, heads AS (
  SELECT doc_id, sent_id, dep, rel, row_number() OVER (PARTITION BY doc_id, sent_id, dep ORDER BY score DESC, head, rel) AS r FROM edges
), parsed AS (
  SELECT t.*, h.rel FROM tokens t LEFT JOIN heads h ON h.doc_id = t.doc_id AND h.sent_id = t.sent_id AND h.dep = t.idx AND h.r = 1
), found AS (
  SELECT v.doc_id, v.sent_id, v.idx AS v, v.word AS verb,
    arg_min(x.word, x.idx) FILTER (x.idx > v.idx AND x.pos[1] = 'n' AND x.rel = 'obj') AS obj,
    arg_min(x.word, x.idx) FILTER (abs(x.idx - v.idx) <= 2 AND x.pos[1] = 'd') AS adv,
    arg_min(x.word, x.idx) FILTER (x.idx < v.idx AND x.pos[1] = 'p') AS prep, min(x.idx) FILTER (x.idx < v.idx AND x.pos[1] = 'p') AS p
  FROM parsed v JOIN parsed x ON x.doc_id = v.doc_id AND x.sent_id = v.sent_id WHERE v.pos[1] = 'v' GROUP BY ALL
), triples AS (
  SELECT doc_id, sent_id, adv AS w1, verb AS w2, obj AS w3, 'adv_v_n' AS type FROM found WHERE adv IS NOT NULL AND obj IS NOT NULL
  UNION ALL SELECT f.doc_id, f.sent_id, prep, arg_min(x.word, x.idx), verb, 'prep_n_v' FROM found f JOIN parsed x
    ON x.doc_id = f.doc_id AND x.sent_id = f.sent_id AND x.idx > f.p AND x.idx < f.v AND x.pos[1] = 'n' GROUP BY f.doc_id, f.sent_id, f.v, prep, verb
), counts AS (SELECT w1, w2, w3, type, count(*) AS c, count(DISTINCT doc_id) AS df FROM triples GROUP BY ALL),
seen AS (SELECT DISTINCT w1, w2, w3, type, doc_id, sent_id FROM triples),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w1, w2, w3, type ORDER BY doc_id, sent_id) AS r FROM seen)
SELECT w1, w2, w3, type, any_value(c) AS c, any_value(df) AS df, string_agg(doc_id || ':' || sent_id, ',' ORDER BY r) AS sents
FROM counts JOIN ranked USING (w1, w2, w3, type) WHERE r <= 5 GROUP BY 1, 2, 3, 4""",
    "confidence_distribution": """SELECT o_custkey AS fragment_id, count(*) FILTER (o_orderpriority[1] = '1') AS confidence_high,
  count(*) FILTER (o_orderpriority[1] = '2') AS confidence_medium, count(*) FILTER (o_orderpriority[1] = '3') AS confidence_low,
  count(*) FILTER (o_orderpriority[1] NOT IN ('1', '2', '3')) AS confidence_none, count(*) FILTER (o_orderstatus = 'F') AS source_lu,
  count(*) FILTER (o_orderstatus = 'O') AS source_llm, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS source_none FROM orders GROUP BY 1""",
    "used_tool_names": """WITH w AS (SELECT DISTINCT conv_id, lower(split_part(unnest(string_split(text, chr(10))), ' ', 1)) AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, count(*)::INT AS n, string_agg(w, ',' ORDER BY w) AS tools FROM w GROUP BY 1""",
    "two_stage_topk": f"""WITH s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS score FROM embeddings),
f AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 81)
SELECT vec_id // 4 AS item, max(score) AS score FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "vector_cache_keys": """WITH k AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 5)
SELECT p.p_brand AS name, count(k.p_type) AS found, count(*) - count(k.p_type) AS missing FROM part p LEFT JOIN k ON k.p_brand = p.p_brand AND k.p_type = p.p_type GROUP BY 1""",
    "event_ids": f"""WITH d AS (SELECT event_id, sha1(unhex('{_SPACE}') || encode(event_type || '/' || event_id)) AS s,
  lower(lpad(to_hex(epoch_us(ts) * 10 + 122192928000000000), 15, '0')) AS t, lower(to_hex((event_id & 16383) | 32768)) AS q, lower(lpad(to_hex(user_id), 12, '0')) AS n FROM events),
h AS (SELECT event_id, substr(s, 1, 12) || '5' || substr(s, 14, 3) || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(s, 17, 1))::INT, 1) || substr(s, 18, 15) AS a,
  substr(t, 1, 12) || '6' || substr(t, 13, 3) || q || n AS b FROM d)
SELECT event_id, {_CUT("a")} AS named, {_CUT("b")} AS timed FROM h""",
    "word_offsets": """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z'']+|[^A-Za-z'']+')) AS w, unnest(range(length(text))) AS i FROM documents),
o AS (SELECT doc_id, w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r WHERE w IS NOT NULL)
SELECT doc_id, count(*) AS n, max(e)::BIGINT AS last_end, sum((e - length(w)) * length(w) + e)::BIGINT AS places FROM o WHERE regexp_matches(w, '^[A-Za-z'']') GROUP BY 1""",
    "prompt_texts": """SELECT p_partkey, 'Word ' || p_type || ' in ' || CASE WHEN p_size > 10 THEN p_brand ELSE '' END || ': choose one of '
  || array_to_string(list_sort(string_split(p_name, ' ')), ', ') || '. ' || p_type || '?' AS prompt FROM part""",
    "derived_qualia": """WITH h AS (
  SELECT n_name AS frame, 'goal' AS fe, p_name AS words FROM nation JOIN part ON p_partkey = n_nationkey + 1
  UNION ALL SELECT n_name, 'use', p_name FROM nation JOIN part ON p_partkey = n_nationkey + 2 WHERE n_nationkey < 20
), v AS (SELECT frame, fe, unnest(string_split(words, ' ')) AS value FROM h
  UNION ALL SELECT n_name, 'form', p_type FROM nation JOIN part ON p_brand = 'Brand#' || n_nationkey)
SELECT frame, fe, value, count(*) AS n FROM v GROUP BY 1, 2, 3""",
    "activated_frames": """WITH s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey AS request, r_regionkey AS frame, lower(r_name) AS definition FROM customer JOIN s USING (c_mktsegment) JOIN region ON r_regionkey = k""",
}
