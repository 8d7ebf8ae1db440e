"""Queries of element, frame, text and vector operators that others do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import json_paths, stats, text, vectors
from loomery.operators import entities, lexicon, store, tools
from loomery.plans.common import table
from loomery.plans.knowledge_queries import LEXICON, RELATIONS_SQL, relations

STOP = ("red", "big")


def name_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, bare name, fingerprint, token estimate and shortened text of part names."""
    p = table(spark, sf_dir, "part")
    noted = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ["), "p_type", F.lit("]"))).otherwise(F.lit(" (spare)")))
    rows = p.select("p_partkey", noted.alias("noted"), F.concat_ws("_", "p_name", "p_brand", F.lit("xy")).alias("key"))
    return rows.select(
        "p_partkey", F.array_join(text.keywords(F.col("key"), STOP), ",").alias("keywords"), text.without_suffix_note(F.col("noted")).alias("bare"),
        text.fingerprint(F.col("key"), F.col("noted")).alias("fingerprint"),
        text.token_estimate(F.repeat("noted", F.lit(12))).alias("tokens"), text.truncated(F.col("noted"), 14).alias("short"),
    )


def answer_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers without thinking and fences, and the line range their anchor names."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("<think>"), "role", F.lit("\nwell</think>\n```json\n"), "text", F.lit("\n```\n"))
    anchor = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("L"), F.col("turn") + 1)).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("L"), F.col("turn") + 1, F.lit("-L"), F.col("turn") + 9)
    ).otherwise(F.lit("page=2"))
    at = text.line_range(anchor)
    return c.select("conv_id", "turn", F.md5(text.without_thinking(said)).alias("clean_md5"), at["first"].alias("first"), at["last"].alias("last"))


SCHEMES = ("repo", "file", "http", "https", "s3", "db", "chat")


def canonical_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, SCHEMES)), (F.col("page_id") % 7 + 1).cast("int")).alias("scheme"))
    part = lambda prefix: F.concat(F.lit(prefix), F.col("page_id").cast("string"))
    repo = F.col("scheme") == "repo"
    made = text.canonical_uri(
        F.col("scheme"), F.when(F.col("page_id") % 2 == 0, part("./a/")).otherwise(part("host/a/")),
        F.when(repo & (F.col("page_id") % 3 > 0), part("r")), F.when(repo & (F.col("page_id") % 5 > 0), part("sub/")),
        F.when(F.col("page_id") % 4 > 0, part("L")),
    )
    return rows.select("page_id", made.alias("uri"))


def json_path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts at a path of JSON documents, and JSON healed out of loose text."""
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"a": {"b": ['), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(']}, "p": '), "props", F.lit("}"))
    loose = F.concat(F.lit("Sure: {not json} ```json\n"), "props", F.lit("\n``` done"))
    rows = e.select("event_id", doc.alias("doc"), json_paths.healed(loose).alias("healed"))
    paths = {"last": "a.b[-1]", "all": "a.b[*]", "k": "p.k", "none": "a.x"}
    rows = text.once(rows, ["event_id", "healed"], v=json_paths.parsed(F.col("doc")))
    return rows.select("event_id", "healed", *[F.array_join(json_paths.texts(F.col("v"), path), ",").alias(name) for name, path in paths.items()])


def order_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fitting way into a document of orders by customer: wildcards, field sets, indices, all inside the JVM."""
    o = table(spark, sf_dir, "orders")
    one = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.left("o_orderpriority", F.lit(1)).alias("level"), F.col("o_orderstatus").alias("state")).alias("s"))
    doc = F.to_json(F.struct(F.struct(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).alias("span"), F.array_sort(F.collect_list(one)).alias("orders")))
    rows = o.groupBy("o_custkey").agg(doc.alias("doc"))
    rows = text.once(rows, ["o_custkey"], v=json_paths.parsed(F.col("doc")))
    paths = {"ids": "orders[*].id", "newest": "orders[-1].s.{state,level}", "first": "orders[0].s.*", "span": "{span.lo,span.hi,none}", "whole": "orders[1].s"}
    return rows.select("o_custkey", *[F.array_join(json_paths.texts(F.col("v"), path), ",").alias(name) for name, path in paths.items()])


def item_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by containment, nested equality and namespace prefix."""
    e = table(spark, sf_dir, "events")
    value = F.to_json(F.struct(
        F.struct(F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("level")).alias("meta"),
        F.array(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string"))).alias("tags"),
    ))
    spaces = F.array(F.lit("docs"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), F.col("event_type"))
    rows = e.select("event_id", value.alias("value"), spaces.alias("namespace"))
    one = store.contains(F.col("value"), {"meta": {"kind": "click"}, "tags": ["t1", "t2"]})
    two = store.item_filter({"meta.kind": "view", "meta.level": {"$gte": 3}})
    three = store.has_prefix(F.col("namespace"), ("docs", "u1"))
    return rows.select("event_id", one.alias("contains"), two.alias("nested"), three.alias("prefixed"))


def positive_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey")).agg(F.round(stats.positive_mean(F.col("c_acctbal")), 4).alias("confidence"))


def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part type's names in order, repeats kept."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("frame"), F.col("p_name").alias("word"), F.col("p_partkey").alias("pos"))
    return lexicon.inverted_index(p)


def global_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all annotations: words, fragments, highest confidence and what the first says."""
    o = table(spark, sf_dir, "orders")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("fragment_id"), F.col("o_orderpriority").alias("word"),
        (F.col("o_custkey") % 40).alias("frame"), level.alias("confidence"), F.concat(F.lit("c"), "o_custkey").alias("core"), F.concat(F.lit("s"), "o_orderkey").alias("source"),
    )
    made = lexicon.frame_index(rows)
    return made.select("frame", F.array_join("words", ",").alias("words"), F.array_join("fragments", ",").alias("fragments"), "confidence", "core", "source")


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct relations between the customers of the even nations, with the element mappings that the order's lines give."""
    names = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("frame"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ord"), F.struct("l_linenumber", "l_partkey").alias("place"), F.col("l_returnflag").alias("sub_fe"), F.col("l_linestatus").alias("super_fe")
    )
    made = lexicon.related_pairs(names, relations(spark, sf_dir), lines)
    return made.withColumn("mappings", F.array_join("mappings", ","))


def selection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the part table with the frames chosen or inferred for them."""
    p = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word"), F.col("p_partkey").alias("position"), "p_size")
    chosen = p.where("p_size > 20").select(F.col("position").alias("ord"), "word", F.concat(F.lit("F"), "p_size").alias("frame"), F.lit("high").alias("confidence")).where("word < 'm'")
    inferred = p.where("word >= 'r'").select("word", F.lit("Guess").alias("frame"), F.lit("low").alias("confidence")).distinct()
    own = p.select("word", "position")
    return lexicon.merge_selections(own.where("word < 'p'"), chosen, own.where("word >= 'p'"), inferred)


def lexicon_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words restricted to a set of names, by frame."""
    rows = spark.sql(f"SELECT * FROM {LEXICON} AS t(word, pos, frame)")
    seen = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    return rows.join(seen.groupBy("word").agg(F.count(F.lit(1)).alias("documents")), "word")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, l1 distance to a fixed vector, dot product at length 1, and sign bits that differ."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fixed = F.transform("v", lambda x, i: F.lit(1.0) / (i + 1))
    rows = v.select("vec_id", "v", fixed.alias("f"), vectors.normalised(F.col("v")).alias("u"))
    bits = lambda c: F.transform(c, lambda x: (x > 0.05).cast("int"))
    return rows.select(
        "vec_id", F.round(vectors.norm(F.col("v")), 4).alias("length"), F.round(vectors.l1_distance(F.col("v"), F.col("f")), 4).alias("l1"),
        F.round(vectors.dot(F.col("u"), F.col("f")), 4).alias("unit_dot"), vectors.hamming_distance(bits("v"), bits("f")).alias("hamming"),
    )


def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and vector scores of orders blended; a strong rule overrides."""
    o = table(spark, sf_dir, "orders")
    vector, rule = F.col("o_orderkey") % 101 / 100.0, F.col("o_custkey") % 21 / 20.0
    return o.select("o_orderkey", F.round(tools.blended(vector, rule), 4).alias("score"))


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as elements of their nation's frame; those without money have no value."""
    c = table(spark, sf_dir, "customer")
    value = F.when(F.col("c_acctbal") > 3000, F.concat(F.lit("v"), F.col("c_custkey").cast("string")))
    return c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("frame"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("fe"),
        value.alias("value"), (F.col("c_custkey") % 3 == 0).alias("core"), (F.col("c_custkey") % 2 == 0).alias("required"),
        F.when(value.isNotNull(), "filled").otherwise("missing").alias("status"),
    )


def answered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for hard gaps, every second answered, and the steps that follow."""
    b = _bindings(spark, sf_dir)
    asked = entities.questions(entities.gaps(b, b.where("value is not null and frame = 'none'")))
    last = F.substring("fe", -1, 1)
    answers = asked.select("fe", F.when(last.isin("0", "4", "8"), F.concat(F.lit("said "), F.length("question"))).alias("answer"))
    return entities.steps(entities.with_answers(b, answers))


def frame_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = entities.saturated(_bindings(spark, sf_dir))
    return made.select("frame", "saturated", F.array_join("missing", ",").alias("missing"))


def frame_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements without a value take that of the frame beside theirs, named in another case."""
    b = _bindings(spark, sf_dir)
    frames = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("frame"), F.col("n_name").alias("name"))
    rules = table(spark, sf_dir, "customer").where("c_acctbal <= 3000").select(
        F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(".e"), F.col("c_custkey"), F.lit(".frame_refs[0]")).alias("key"),
        F.concat(F.lit("nation_"), (F.col("c_nationkey") + 1) % 25).alias("ref_frame"), F.concat(F.lit("e"), F.col("c_custkey") + 1).alias("ref_fe"),
    )
    return entities.reference_candidates(b, rules, frames)


def frame_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bindings(spark, sf_dir)
    own = F.array(F.concat(F.lit("as "), "fe"), F.lit("by default"))
    return entities.assumptions(b.select("frame", "fe", own.alias("assumptions"), F.when(F.col("core"), F.array(F.lit("overridden"))).alias("override")))


def escalation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bindings(spark, sf_dir)
    found = entities.gaps(b, b.where("false")).join(b.select("fe", "frame"), "fe")
    made = entities.escalation(b, found)
    return made.select("frame", F.length("record").alias("size"), F.md5("record").alias("record_md5"))


def qualia_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualia of one role, and list fields, as candidates of parts."""
    p = table(spark, sf_dir, "part")
    roles = F.create_map(F.lit("telic"), F.split("p_name", " "), F.lit("formal"), F.array("p_type"))
    rows = p.select(F.col("p_partkey").alias("id"), roles.alias("qualia"), F.split("p_brand", "#").alias("marks"))
    both = entities.qualia_candidates(rows, "telic").unionByName(entities.field_candidates(rows, "marks", "entity"))
    return both.groupBy("value", "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


QUERIES = {
    f.__name__: f
    for f in (
        name_features, answer_cleaning, canonical_uris, json_path_values, order_json_paths, item_containment, positive_confidence, word_index, global_frames,
        frame_pairs, selection_merge, lexicon_frames, vector_norms, blended_scores, answered_steps, frame_saturation, frame_references,
        frame_assumptions, escalation_records, qualia_values,
    )
}

_B = """b AS (
  SELECT 'n' || c_nationkey AS frame, 'e' || c_custkey AS fe, CASE WHEN c_acctbal > 3000 THEN 'v' || c_custkey END AS value,
    c_custkey % 3 = 0 AS core, c_custkey % 2 = 0 AS required, CASE WHEN c_acctbal > 3000 THEN 'filled' ELSE 'missing' END AS status,
    c_custkey, c_nationkey
  FROM customer
)"""
SQL = {
    "name_features": """WITH t AS (SELECT p_partkey, p_name, p_type, p_brand,
  p_name || CASE WHEN p_partkey % 2 = 0 THEN ' [' || p_type || ']' ELSE ' (spare)' END AS noted, p_name || '_' || p_brand || '_xy' AS key FROM part),
w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(key), '[_\\-\\s]+')) AS w, unnest(range(20)) AS i FROM t),
k AS (SELECT p_partkey, string_agg(w, ',' ORDER BY i) AS keywords FROM (SELECT p_partkey, w, min(i) AS i FROM w WHERE length(w) >= 3 AND w NOT IN ('red', 'big') GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey, coalesce(keywords, '') AS keywords, p_name AS bare, md5(key || '|' || noted) AS fingerprint,
  greatest(50, length(noted) * 12 // 3)::INT AS tokens, CASE WHEN length(noted) > 14 THEN substr(noted, 1, 14) || '...' ELSE noted END AS short
FROM t LEFT JOIN k USING (p_partkey)""",
    "answer_cleaning": """SELECT conv_id, turn, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS clean_md5,
  CASE WHEN turn % 3 < 2 THEN turn + 1 END::INT AS first, CASE turn % 3 WHEN 0 THEN turn + 1 WHEN 1 THEN turn + 9 END::INT AS last FROM conversations""",
    "canonical_uris": """WITH p AS (SELECT page_id, ['repo', 'file', 'http', 'https', 's3', 'db', 'chat'][page_id % 7 + 1] AS s,
  CASE WHEN page_id % 2 = 0 THEN './a/' ELSE 'host/a/' END || page_id AS l FROM pages)
SELECT page_id, CASE WHEN s = 'repo' THEN 'repo:' || l || CASE WHEN page_id % 3 > 0 THEN '#r' || page_id ELSE '' END || CASE WHEN page_id % 5 > 0 THEN ':sub/' || page_id ELSE '' END
  WHEN s = 'file' AND page_id % 2 = 0 THEN 'file:' || l ELSE s || '://' || l END || CASE WHEN page_id % 4 > 0 THEN '#L' || page_id ELSE '' END AS uri FROM p""",
    "json_path_values": """SELECT event_id, props AS healed, user_id::VARCHAR AS last, event_id || ',' || user_id AS all, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS none FROM events""",
    "order_json_paths": """WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderpriority[1] AS l, o_orderstatus AS s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS d FROM orders)
SELECT o_custkey, string_agg(k::VARCHAR, ',' ORDER BY k) AS ids, any_value(s || ',' || l) FILTER (d = 1) AS newest, any_value(l || ',' || s) FILTER (r = 1) AS first,
  min(k) || ',' || max(k) AS span, coalesce(any_value('{"level":"' || l || '","state":"' || s || '"}') FILTER (r = 2), '') AS whole FROM o GROUP BY 1""",
    "item_containment": """WITH t AS (SELECT event_id, event_type, user_id, ['t' || (user_id % 3), 't' || (event_id % 4)] AS tags FROM events)
SELECT event_id, event_type = 'click' AND list_contains(tags, 't1') AND list_contains(tags, 't2') AS contains,
  event_type = 'view' AND user_id % 5 >= 3 AS nested, user_id % 10 = 1 AS prefixed FROM t""",
    "positive_confidence": "SELECT c_nationkey, round(coalesce(avg(c_acctbal) FILTER (c_acctbal > 0), 0), 4) AS confidence FROM customer GROUP BY 1",
    "word_index": "SELECT p_type AS frame, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS place, p_name AS word FROM part",
    "global_frames": """SELECT o_custkey % 40 AS frame, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS words,
  string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS fragments, ['high', 'medium', 'low', 'none'][min(o_orderkey % 4) + 1] AS confidence,
  'c' || arg_min(o_custkey, o_orderkey) AS core, 's' || min(o_orderkey) AS source FROM orders GROUP BY 1""",
    "frame_pairs": f"""WITH {RELATIONS_SQL}, n AS (SELECT 'c' || c_custkey AS frame FROM customer WHERE c_nationkey % 2 = 0),
p AS (SELECT least(sub, super) AS source, greatest(sub, super) AS target, *, row_number() OVER (PARTITION BY least(sub, super), greatest(sub, super) ORDER BY ord) AS k
  FROM relations WHERE sub IN (FROM n) AND super IN (FROM n) AND sub <> super),
l AS (SELECT l_orderkey AS ord, string_agg(l_returnflag || ' -> ' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_returnflag || ' -> ' || l_linestatus) AS m FROM lineitem GROUP BY 1)
SELECT source, target, type AS relation, CASE type WHEN 'Inheritance' THEN 'hierarchical' WHEN 'Using' THEN 'hierarchical' WHEN 'Subframe' THEN 'compositional'
  WHEN 'Causative_of' THEN 'causal' WHEN 'Precedes' THEN 'temporal' ELSE 'associative' END AS kind,
  CASE WHEN super = source THEN 'parent_to_child' ELSE 'child_to_parent' END AS direction, coalesce(m, '') AS mappings FROM p LEFT JOIN l USING (ord) WHERE k = 1""",
    "selection_merge": """WITH p AS (SELECT string_split(p_name, ' ')[1] AS word, p_partkey AS position, p_size FROM part),
s AS (SELECT word, arg_max('F' || p_size, position) AS frame FROM p WHERE p_size > 20 AND word < 'm' GROUP BY 1)
SELECT word, position, frame, 'high' AS confidence, 'lexicon' AS source FROM p JOIN s USING (word) WHERE word < 'p' UNION ALL
SELECT word, position, CASE WHEN word >= 'r' THEN 'Guess' END, CASE WHEN word >= 'r' THEN 'low' ELSE 'none' END, CASE WHEN word >= 'r' THEN 'inferred' ELSE 'none' END
FROM p WHERE word >= 'p'""",
    "lexicon_frames": rf"""WITH l AS (SELECT * FROM ({LEXICON}) AS t(word, pos, frame)),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '(\p{{L}}+)')) AS word FROM documents),
d AS (SELECT word, count(*) AS documents FROM w GROUP BY 1)
SELECT word, pos, frame, documents FROM l JOIN d USING (word)""",
    "vector_norms": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT vec_id, v, list_transform(range(1, len(v) + 1), lambda i: 1.0::DOUBLE / i) AS f, sqrt(list_inner_product(v, v)) AS n FROM v)
SELECT vec_id, round(n, 4) AS length, round(list_sum(list_transform(list_zip(v, f), lambda x: abs(x[1] - x[2]))), 4) AS l1,
  round(list_inner_product(v, f) / n, 4) AS unit_dot, len(list_filter(list_zip(v, f), lambda x: (x[1] > 0.05) <> (x[2] > 0.05)))::INT AS hamming FROM f""",
    "blended_scores": """WITH s AS (SELECT o_orderkey, o_orderkey % 101 / 100.0::DOUBLE AS v, o_custkey % 21 / 20.0::DOUBLE AS r FROM orders)
SELECT o_orderkey, round(CASE WHEN r >= 0.85 THEN greatest(0.7::DOUBLE * v + (1 - 0.7::DOUBLE) * r, r) ELSE 0.7::DOUBLE * v + (1 - 0.7::DOUBLE) * r END, 4) AS score FROM s""",
    "answered_steps": f"""WITH {_B}, a AS (SELECT frame, fe, required, coalesce(CASE WHEN status <> 'filled' AND core AND required AND right(fe, 1) IN ('0', '4', '8')
  THEN 'said ' || length('Which value has ' || fe || '?') END, value) AS value FROM b)
SELECT frame, fe, value, (row_number() OVER (PARTITION BY frame ORDER BY fe))::INT AS step FROM a WHERE required AND value IS NOT NULL""",
    "frame_saturation": f"""WITH {_B} SELECT frame, bool_and(NOT (required AND status = 'missing')) AS saturated,
  coalesce(string_agg(fe, ',' ORDER BY fe) FILTER (required AND status = 'missing'), '') AS missing FROM b GROUP BY 1""",
    "frame_references": f"""WITH {_B} SELECT b.frame, b.fe, o.value FROM b JOIN b o ON o.c_custkey = b.c_custkey + 1 AND o.c_nationkey = (b.c_nationkey + 1) % 25
WHERE b.value IS NULL AND o.value IS NOT NULL""",
    "frame_assumptions": f"""WITH {_B} SELECT frame, fe, 0 AS place, '[' || frame || '.' || fe || '] ' || CASE WHEN core THEN 'overridden' ELSE 'as ' || fe END AS assumption FROM b
UNION ALL SELECT frame, fe, 1, '[' || frame || '.' || fe || '] by default' FROM b WHERE NOT core""",
    "escalation_records": f"""WITH {_B}, j AS (SELECT frame, '{{"frame":"' || frame || '","bindings":[' || string_agg('{{"fe":"' || fe || '"' || CASE WHEN value IS NULL THEN '' ELSE ',"value":"' || value || '"' END
    || ',"status":"' || status || '"}}', ',' ORDER BY fe) || '],"gaps":['
    || coalesce(string_agg('{{"fe":"' || fe || '","gap":"' || CASE WHEN NOT core THEN 'peripheral' WHEN required THEN 'hard' ELSE 'pending' END || '"}}', ',' ORDER BY fe) FILTER (status <> 'filled'), '')
    || ']}}' AS record FROM b GROUP BY 1)
SELECT frame, length(record)::INT AS size, md5(record) AS record_md5 FROM j""",
    "qualia_values": """SELECT value, source, count(*) AS n, min(id) AS first_id FROM (
  SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS value, 'qualia' AS source FROM part UNION ALL
  SELECT p_partkey, unnest(string_split(p_brand, '#')), 'entity' FROM part) GROUP BY 1, 2""",
}
