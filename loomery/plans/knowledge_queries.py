"""Lexicon, knowledge-card, entity and tool queries over the driver's tables and small inline ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import entities, knowledge, lexicon, similarity, tools
from loomery.plans.common import table

LEXICON = """VALUES ('the', 'a', 'Definiteness'), ('of', 'p', 'Partitive'), ('in', 'p', 'Containing'), ('that', 'n', 'Pointing'),
  ('that', 'a', 'Identicality'), ('for', 'p', 'Purpose'), ('with', 'p', 'Accompaniment'), ('th', 'n', 'Order'), ('er', 'v', 'Hesitating')"""



def doc_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lexicon.fragments(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "id", F.length("text").alias("size"), "category", "value", "paragraph", "sentence", "prev_id", "next_id")


def fragment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lexicon.fragments(table(spark, sf_dir, "documents"))
    return made.groupBy("value", "category").agg(F.count(F.lit(1)).alias("n_fragments"), F.count_distinct("doc_id").alias("n_docs"))


def fragment_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lexicon.eligible(lexicon.fragments(table(spark, sf_dir, "documents")), skip_low=True)
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("eligible"))


def lookup_join_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = spark.sql(f"SELECT * FROM {LEXICON} AS t(lemma, pos, frame)")
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word"), F.lit(None).cast("string").alias("pos"))
    return lexicon.lookup(words, lex).select("word", "frame", "lemma")


def frame_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return lexicon.search_names(names, "rings", 20).select("name", "score")


KINDS_OF_RELATION = ("Inheritance", "Using", "Subframe", "Causative_of", "See_also")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as frames: each order relates its customer to that of the next order, by the kind its priority names.

    A frame has many parents, of which the first order's counts as the first, and there are cycles.
    """
    o = table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, KINDS_OF_RELATION))
    kind = F.element_at(names, F.left("o_orderpriority", F.lit(1)).cast("int"))
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("super"))
    own = o.select("o_orderkey", kind.alias("type"), F.concat(F.lit("c"), "o_custkey").alias("sub"))
    return own.join(after, "o_orderkey").select("type", "sub", "super", F.col("o_orderkey").alias("ord"))


def ancestors_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.ancestors(relations(spark, sf_dir)).select("frame", "ancestor", "depth")


def common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the customers of orders two apart."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("c"))
    later = o.select((F.col("o_orderkey") - 2).alias("o_orderkey"), F.col("c").alias("d"))
    pairs = o.join(later, "o_orderkey").where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
    return lexicon.common_ancestors(lexicon.ancestors(relations(spark, sf_dir)), pairs)


def relation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).groupBy(lexicon.relation_kind(F.col("type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    letters = knowledge.characters(F.col("text"), r"\p{L}") / F.greatest(F.length("text"), F.lit(1))
    early = F.coalesce(knowledge.code_or_file_score(F.col("text")), knowledge.chat_score(F.col("text")), knowledge.web_score(F.col("text")))
    scored = text.once(docs, ["doc_id"], score=F.round(knowledge.quality(F.col("text"), early, letters), 4))
    return scored.where("score >= 0.5").select("doc_id", "score")


def source_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    body = F.col("html")
    return pages.select(
        "page_id", knowledge.code_or_file_score(body).alias("code"), knowledge.chat_score(body).alias("chat"), knowledge.web_score(body).alias("web")
    )


def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.short_id("lbl_", F.col("text")).alias("label_id"), text.short_id("info_", F.col("text"), 16).alias("info_id"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    return docs.select(
        pick(list(knowledge.STAGES), 3).alias("stage"), pick(list(knowledge.LAYERS), 4).alias("layer"),
        F.concat(F.lit("a"), (F.floor(F.col("doc_id") / 2)).cast("string")).alias("artifact_id"), F.col("text").alias("content"),
    )


QUESTION = "that the error from one shner of heonand hationre with thtion"


def token_recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = knowledge.recall_top(_cards(spark, sf_dir), QUESTION, 25)
    return made.select("artifact_id", "stage", "layer", F.round("score", 4).alias("score"))


def keep_last_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("id"), "event_id", "event_type")
    return knowledge.keep_last(rows, "id", "event_id")


def keep_max_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("relation_id"), F.col("l_extendedprice").alias("degree"), "l_orderkey")
    return knowledge.keep_strongest(rows)


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_discount") * 10).alias("degree"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("label_1"), F.col("l_suppkey").alias("label_2")
    )
    labels = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("label_id"))
    made = knowledge.valid_relations(rows, labels, ("A", "R"))
    return made.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label_1").alias("labels"))


def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers tied by orders of one day."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate").alias("day")
    hubs = o.groupBy(day).agg(F.min("o_custkey").alias("v"))
    edges = o.select(F.col("o_custkey").alias("u"), day).join(hubs, "day").select("u", "v").distinct()
    return knowledge.components(o.select(F.col("o_custkey").alias("vertex")), edges)


TOOLS = """VALUES ('search', array('find', 'search'), array(), true, true, 120), ('fetch', array('url', 'page'), array('search'), true, true, 200),
  ('parse', array('json'), array('fetch'), true, true, 90), ('old', array('find'), array(), false, true, 50),
  ('report', array('error', 'page', 'json'), array('parse', 'plot'), true, true, 300), ('plot', array('chart'), array(), true, true, 250),
  ('legacy', array('page'), array('old'), true, true, 40), ('secret', array('find'), array(), true, false, 10)"""


def _tools(spark: SparkSession) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {TOOLS} AS t(name, keywords, dependencies, enabled, compliant, tokens)")
    return rows.withColumn("dependencies", F.col("dependencies").cast("array<string>"))


CONTEXT = "find the small red ring, then weigh a blue bolt"


def _scored_tools(t: DataFrame, context: str, recent: Column) -> DataFrame:
    hits = tools.keyword_hits(F.lit(context), F.col("keywords"))
    rows = t.withColumn("hits", hits).withColumn("similarity", tools.rule_similarity(F.col("hits"), F.col("keywords")))
    score = tools.linear_score(F.col("similarity"), recent, F.col("enabled"), F.col("compliant"), F.col("tokens"))
    return rows.select("name", "hits", F.round("similarity", 4).alias("similarity"), F.round(score, 4).alias("score"))


def _part_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools: the words of the name are keywords, the size is the cost."""
    p = table(spark, sf_dir, "part")
    about = F.concat_ws(" ", "p_name", F.lit("by"), "p_brand", F.lit("for"), "p_type", F.lit("work at"), F.col("p_retailprice").cast("int").cast("string"), F.lit("a piece"))
    return p.select(
        F.col("p_partkey").alias("name"), F.split("p_name", " ").alias("keywords"), (F.col("p_size") > 3).alias("enabled"),
        (F.col("p_brand") != "Brand#13").alias("compliant"), F.col("p_size").alias("tokens"), about.alias("description"),
    )


def tool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a request; those of the largest size count as used lately."""
    return _scored_tools(_part_tools(spark, sf_dir), CONTEXT, F.col("tokens") == 50)


def tool_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.listed(_part_tools(spark, sf_dir))


def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools in words; every third has no parameters."""
    p = table(spark, sf_dir, "part")
    given = F.when(F.col("p_partkey") % 3 > 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_type"))
    return p.select("p_partkey", text.rich_text(name, F.concat(F.lit(" "), F.repeat(F.concat("p_brand", F.lit(" ")), F.col("p_size"))), given).alias("text"))


def dep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tools that need the customer of a third of their number and, in one segment, the next one."""
    c = table(spark, sf_dir, "customer")
    more = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") + 1)
    need = F.array_compact(F.array(F.floor(F.col("c_custkey") / 3).cast("long"), more))
    return tools.closure(c.select(F.col("c_custkey").alias("name"), need.alias("dependencies")))


def greedy_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's request against the registry, with a budget by its number."""
    t = _tools(spark)
    scored = _scored_tools(t, "find the JSON page, then chart it", F.col("name") == "plot")
    scores = scored.join(t.select("name", "tokens"), "name")
    bundles = tools.closure(t).join(scores.select(F.col("name").alias("member"), "score", "tokens"), "member")
    bundles = bundles.groupBy("name").agg(F.collect_list(F.struct(F.col("member").alias("name"), "score", "tokens")).alias("members"))
    requests = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id")).distinct()
    asked = requests.withColumn("token_budget", (F.lit(150) + F.col("request_id") % 8 * 100).cast("int"))
    listed = scores.where("score >= 0.3").join(bundles, "name").agg(F.collect_list(F.struct("name", "score", "members")).alias("bundles"))
    return tools.chosen(asked.crossJoin(F.broadcast(listed)), "bundles")


def _named_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the words of name, brand and type."""
    words = text.words(F.concat_ws(" ", "p_name", "p_type"))
    brand = F.concat(F.lit("b"), F.substring_index("p_brand", "#", -1))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(words, F.array(brand)).alias("tokens"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of parts' words that share a word, a pair a row, however weak; parts with one set of words are one class."""
    _, pairs = similarity.overlapping_sets(_named_words(spark, sf_dir), key="p_partkey")
    return pairs.select("a", "b", F.round("similarity", 4).alias("jaccard"))


def similar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the class of its words (the smallest number) and how many others are like it by three fifths or more."""
    members, pairs = similarity.similar_sets(_named_words(spark, sf_dir), 0.6, key="p_partkey")
    return similarity.joined_classes(members, pairs)


def argmax_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    source = F.element_at(F.array(*map(F.lit, ("frame", "entity", "qualia", "role", "query", "default"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = o.select(F.col("o_custkey").alias("fe"), source.alias("source"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("value"))
    return entities.argmax(rows)


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    bindings = c.select(
        F.col("c_custkey").alias("fe"), (F.col("c_nationkey") % 2 == 0).alias("core"), (F.col("c_acctbal") > 0).alias("required"),
        F.when(F.col("c_mktsegment") == "BUILDING", "filled").otherwise("missing").alias("status"),
    )
    candidates = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("fe"))
    made = entities.gaps(bindings, candidates)
    return made.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def relation_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nations' regions as entities that point at their nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rel = F.array(F.struct(F.lit("located_in").alias("type"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target")))
    ents = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Supplier").alias("type"), rel.alias("relations"))
    none = F.array().cast("array<struct<type:string,target:string>>")
    ents = ents.unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Nation").alias("type"), none.alias("relations")))
    return entities.traverse(ents, "located_in", ("Nation",))


def inverse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.lit("produces").alias("type"), F.col("s_nationkey").cast("long").alias("target"))
    return entities.with_inverse(rows, {"produces": "produced_by"})


def frame_inherit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' elements, some left open or without a parent, that inherit from their nation's."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    element = lambda fe, kind, required: F.struct(F.lit(fe).alias("fe"), kind.alias("type_ref"), required.alias("required"))
    none, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    above = F.array(element("segment", F.lit("Segment"), F.lit(True)), element("balance", F.concat(F.lit("Money"), "n_regionkey"), F.col("n_regionkey") > 2))
    parents = n.select(F.col("n_nationkey").alias("frame"), F.explode(above).alias("e")).select("frame", "e.*")
    own = F.array(
        element("segment", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), no_flag),
        element("balance", none, F.when(F.col("c_acctbal") < 0, False)), element("name", F.col("c_name"), F.lit(True)),
    )
    parent = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey"))
    children = c.select(F.col("c_custkey").alias("frame"), parent.alias("parent"), F.explode(own).alias("e")).select("frame", "parent", "e.*")
    return entities.inherit(children, parents)


def dangling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return entities.unmatched(left, right)


def _stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(text.words(F.col("p_name"))).alias("word")).distinct()


def stem_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stem_words(spark, sf_dir).select("word", F.size(text.stem_variants(F.col("word"))).alias("n_variants"))


_LOCAL = (
    doc_fragments, fragment_stats, fragment_eligible, lookup_join_fallback, frame_search, ancestors_bounded, common_ancestor,
    relation_kinds, quality_gate, source_heuristics, deterministic_ids, token_recall_topk, keep_last_by_id, keep_max_degree,
    dangling_edges, label_components, tool_scores, tool_listing, tool_texts, dep_closure, greedy_knapsack, jaccard_pairs, similar_parts, argmax_priority, gap_report,
    relation_traverse, inverse_relations, frame_inherit_merge, dangling_ids, stem_variants,
)
QUERIES = {f.__name__: f for f in _LOCAL}

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

def _fragments_sql() -> str:
    quoted = {k: v.replace("'", "''") for k, v in {
        "CODE": lexicon.CODE_SIGNATURE, "TICK": lexicon.BACKTICK, "RET": lexicon.RETURNS, "IMPL": lexicon.IMPLEMENTATION,
        "ACT": lexicon.ACTION, "NAT": lexicon.NATURAL, "CLS": lexicon.CLASS_HEAD, "WS": _WS,
    }.items()}
    quoted["WS"] = _WS
    sql = r"""
paras AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(p, @WS@)), lambda p: p <> '') AS ps FROM documents
), para AS (SELECT doc_id, unnest(range(1, len(ps) + 1))::INT AS paragraph, unnest(ps) AS p FROM paras),
sents AS (
  SELECT doc_id, paragraph, list_filter(list_transform(string_split(
    regexp_replace(p, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, @WS@)), lambda s: s <> '') AS ss FROM para
), frags AS (SELECT doc_id, paragraph, len(ss) AS n, unnest(range(1, len(ss) + 1))::INT AS j, unnest(ss) AS text FROM sents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, j) AS o FROM frags),
scored AS (
  SELECT *, CASE WHEN o < 100 THEN 'F' || lpad(o::VARCHAR, 2, '0') ELSE 'F' || o END AS id,
    len(regexp_extract_all(text, '@CODE@')) AS code, len(regexp_extract_all(text, '@TICK@')) AS ticks,
    regexp_matches(text, '@RET@')::INT AS returns, regexp_matches(text, '@NAT@') AS nat,
    greatest(1, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS nw
  FROM numbered
), classed AS (
  SELECT *, CASE WHEN regexp_matches(text, '@CLS@') THEN 1 WHEN regexp_matches(text, '@IMPL@') THEN 2
    WHEN code >= 1 AND (code + ticks + returns) / nw > 0.1 THEN 3
    WHEN (ticks >= 2 OR returns = 1) AND (code + ticks + returns) / nw > 0.05 THEN 4
    WHEN regexp_matches(text, '@ACT@') AND nat THEN 5 WHEN nat THEN 6 ELSE 7 END AS rule FROM scored
), fragments AS (
  SELECT doc_id, id, length(text)::INT AS size,
    ['code_syntax', 'impl_detail', 'code_syntax', 'code_example', 'nl_action', 'nl_description', 'code_syntax'][rule] AS category,
    ['low', 'skip', 'low', 'low', 'medium', 'high', 'low'][rule] AS value, paragraph, CASE WHEN n > 1 THEN j END AS sentence,
    lag(id) OVER (PARTITION BY doc_id ORDER BY o) AS prev_id, lead(id) OVER (PARTITION BY doc_id ORDER BY o) AS next_id FROM classed
)"""
    for k, v in quoted.items():
        sql = sql.replace(f"@{k}@", v)
    return sql


_FRAGMENTS = _fragments_sql()
RELATIONS_SQL = f"""relations AS (
  SELECT {list(KINDS_OF_RELATION)}[o.o_orderpriority[1]::INT] AS type, 'c' || o.o_custkey AS sub, 'c' || n.o_custkey AS super, o.o_orderkey AS ord
  FROM orders o JOIN orders n ON n.o_orderkey = o.o_orderkey + 1
)"""
_WORD_CLASSES = r"""n AS (SELECT p_partkey AS id, list_sort(list_distinct(list_concat(regexp_extract_all(lower(p_name || ' ' || p_type), '(\p{L}+)'),
  ['b' || string_split(p_brand, '#')[-1]]))) AS w FROM part),
c AS (SELECT min(id) AS rep, w, count(*) AS size FROM n GROUP BY w)"""
_WALK = f"""{RELATIONS_SQL}, r AS (SELECT * FROM relations WHERE type <> 'See_also' AND sub <> super),
f AS (SELECT sub, arg_min(super, ord) AS first FROM r GROUP BY sub),
walk(frame, here, depth, path) AS (
  SELECT DISTINCT sub, sub, 1, [sub] FROM r
  UNION ALL SELECT frame, first, depth + 1, list_append(path, first) FROM walk JOIN f ON f.sub = here WHERE depth < 5 AND NOT list_contains(path, first)
)"""

SQL = {
    "doc_fragments": f"WITH {_FRAGMENTS} SELECT * FROM fragments",
    "fragment_stats": f"WITH {_FRAGMENTS} SELECT value, category, count(*) AS n_fragments, count(DISTINCT doc_id) AS n_docs FROM fragments GROUP BY ALL",
    "fragment_eligible": f"WITH {_FRAGMENTS} SELECT doc_id, count(*) AS eligible FROM fragments WHERE value IN ('high', 'medium') GROUP BY 1",
    "lookup_join_fallback": rf"""WITH lex AS (SELECT * FROM ({LEXICON}) AS t(lemma, pos, frame)),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\p{{L}}+)')) AS word FROM benchmark),
forms AS (
  SELECT word, unnest([0, 1, 2, 3, 4]) AS rank,
    unnest([word, regexp_replace(word, '[s]+$', ''), regexp_replace(word, '[ed]+$', ''), regexp_replace(word, '[ing]+$', ''), word || 'e']) AS lemma FROM words
), hits AS (SELECT *, min(rank) OVER (PARTITION BY word) AS best FROM forms JOIN lex USING (lemma))
SELECT word, frame, min(lemma) AS lemma FROM hits WHERE rank = best GROUP BY word, frame
QUALIFY row_number() OVER (PARTITION BY word ORDER BY frame) <= 8""",
    "frame_search": """WITH names AS (SELECT DISTINCT p_name AS name FROM part),
v AS (SELECT unnest(['rings', 'ring', 'ringing', 'ringtion', 'ringsion', 'ringment', 'ringness', 'ringence', 'ringance', 'ringable',
  'ringible', 'ringful', 'ringless', 'ringous', 'ringive', 'ringal', 'ringed', 'ringes', 'ringer', 'ringy']) AS v)
SELECT name, max(CASE WHEN lower(name) = v THEN 100 WHEN starts_with(lower(name), v) OR starts_with(v, lower(name)) THEN 80
  WHEN contains(lower(name), v) OR contains(v, lower(name)) THEN 60 ELSE 0 END)::INT AS score
FROM names, v GROUP BY name HAVING score > 0 ORDER BY score DESC, name LIMIT 20""",
    "ancestors_bounded": f"""WITH RECURSIVE {_WALK} SELECT frame, super AS ancestor, depth FROM walk JOIN r ON r.sub = here""",
    "common_ancestor": f"""WITH RECURSIVE {_WALK},
up AS (SELECT frame, super AS ancestor, min(depth) AS depth FROM walk JOIN r ON r.sub = here GROUP BY 1, 2),
pairs AS (SELECT DISTINCT least('c' || x.o_custkey, 'c' || y.o_custkey) AS a, greatest('c' || x.o_custkey, 'c' || y.o_custkey) AS b
  FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 2 WHERE x.o_custkey <> y.o_custkey)
SELECT a, b, x.ancestor, x.depth AS depth_a, y.depth AS depth_b FROM pairs JOIN up x ON x.frame = a JOIN up y ON y.frame = b AND x.ancestor = y.ancestor
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY x.depth, y.depth, x.ancestor) = 1""",
    "relation_kinds": f"""WITH {RELATIONS_SQL}
SELECT CASE type WHEN 'Inheritance' THEN 'hierarchical' WHEN 'Using' THEN 'hierarchical' WHEN 'Subframe' THEN 'compositional'
  WHEN 'Causative_of' THEN 'causal' WHEN 'Precedes' THEN 'temporal' ELSE 'associative' END AS kind, count(*) AS n FROM relations GROUP BY 1""",
    "quality_gate": rf"""WITH l AS (
  SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ls FROM documents
), s AS (
  SELECT doc_id, CASE WHEN length(trim(text, {_WS})) < 10 THEN 0.0 ELSE coalesce(
    CASE WHEN len(ls) = 0 THEN 0.0 WHEN len(list_filter(ls, lambda x: NOT (starts_with(x, 'import ') OR starts_with(x, 'from ') OR starts_with(x, '#')
      OR starts_with(x, '//') OR starts_with(x, '/*')))) = 0 THEN 0.1 END,
    CASE WHEN len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]')) / greatest(length(text), 1) < 0.30 THEN 0.1 END,
    CASE WHEN (contains(lower(text), 'all rights reserved')::INT + contains(lower(text), 'copyright ©')::INT + contains(lower(text), '隐私政策')::INT
      + contains(lower(text), '用户协议')::INT) >= 2 AND length(text) < 200 THEN 0.1 END,
    len(regexp_extract_all(text, '\p{{L}}')) / greatest(length(text), 1)) END::DOUBLE AS raw FROM l
) SELECT doc_id, round(least(1.0, greatest(0.0, raw)), 4) AS score FROM s WHERE round(raw, 4) >= 0.5""",
    "source_heuristics": rf"""WITH l AS (
  SELECT page_id, html AS text, list_filter(list_transform(string_split_regex(html, '\r\n|\r|\n'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ls FROM pages
) SELECT page_id,
    (CASE WHEN len(ls) = 0 THEN 0.0 WHEN len(list_filter(ls, lambda x: NOT (starts_with(x, 'import ') OR starts_with(x, 'from ') OR starts_with(x, '#')
      OR starts_with(x, '//') OR starts_with(x, '/*')))) = 0 THEN 0.1 END)::DOUBLE AS code,
    (CASE WHEN len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]')) / greatest(length(text), 1) < 0.30 THEN 0.1 END)::DOUBLE AS chat,
    (CASE WHEN (contains(lower(text), 'all rights reserved')::INT + contains(lower(text), 'copyright ©')::INT) >= 2 AND length(text) < 200 THEN 0.1 END)::DOUBLE AS web
FROM l""",
    "deterministic_ids": """SELECT doc_id, 'lbl_' || substr(sha256(lower(trim(text))), 1, 12) AS label_id, 'info_' || substr(sha256(lower(trim(text))), 1, 16) AS info_id FROM documents""",
    "token_recall_topk": rf"""WITH q AS (SELECT list_distinct(regexp_extract_all('{QUESTION}', '[a-z0-9_]{{2,}}')) AS qt),
cards AS (
  SELECT ['gold', 'release', 'debug'][doc_id % 3 + 1] AS stage, ['ontology', 'labeling', 'relating', 'information'][doc_id % 4 + 1] AS layer,
    doc_id % 3 AS sp, doc_id % 4 AS lp, 'a' || (doc_id // 2) AS artifact_id, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS w FROM documents
), s AS (
  SELECT *, len(list_intersect(qt, w)) / len(qt) AS share, [1.0, 0.8, 0.4][sp + 1]::DOUBLE * [1.5, 1.2, 1.0, 0.9][lp + 1]::DOUBLE AS weight FROM cards, q
), best AS (SELECT * FROM s WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY sp, lp) = 1)
SELECT artifact_id, stage, layer, round(share * weight, 4) AS score FROM best ORDER BY round(share * weight, 12) DESC, artifact_id LIMIT 25""",
    "keep_last_by_id": "SELECT user_id % 50 AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "keep_max_degree": """SELECT l_partkey AS relation_id, l_extendedprice AS degree, l_orderkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey DESC) = 1""",
    "dangling_edges": """WITH labels AS (SELECT p_partkey AS id FROM part WHERE p_size < 10)
SELECT l_returnflag AS kind, count(*) AS n, count(DISTINCT l_partkey) AS labels FROM lineitem
WHERE l_discount * 10 >= 0.5 AND l_returnflag IN ('A', 'R') AND l_partkey <> l_suppkey
  AND l_partkey IN (SELECT id FROM labels) AND l_suppkey IN (SELECT id FROM labels) GROUP BY 1""",
    "label_components": """WITH RECURSIVE o AS (SELECT o_custkey AS u, min(o_custkey) OVER (PARTITION BY o_orderdate::DATE) AS v FROM orders),
e AS (SELECT u, v FROM o UNION SELECT v, u FROM o),
reach(vertex, other) AS (SELECT u, u FROM o UNION SELECT vertex, v FROM reach JOIN e ON e.u = other)
SELECT vertex, min(other) AS component FROM reach GROUP BY vertex""",
    "tool_scores": rf"""WITH t AS (SELECT p_partkey AS name, string_split(p_name, ' ') AS keywords, p_size AS tokens, p_size > 3 AS enabled, p_brand <> 'Brand#13' AS compliant FROM part),
h AS (SELECT *, len(list_filter(keywords, lambda k: regexp_matches('{CONTEXT}', '\b' || k || '\b')))::INT AS hits FROM t),
s AS (SELECT *, CASE WHEN hits <= 0 THEN 0.0 WHEN len(keywords) = 1 THEN 1.0
  ELSE 0.85 + 0.15 * least(1.0, (hits - 1) / greatest(1, len(keywords) - 1)) END::DOUBLE AS sim FROM h)
SELECT name, hits, round(sim, 4) AS similarity, round(CASE WHEN NOT compliant THEN -1000 ELSE 2 * sim + (tokens = 50)::INT
  - CASE WHEN enabled THEN 0 ELSE 5000 END - 0.001::DOUBLE * tokens END, 4) AS score FROM s""",
    "tool_listing": """WITH d AS (SELECT p_partkey AS name, p_name || ' by ' || p_brand || ' for ' || p_type || ' work at ' || trunc(p_retailprice)::INT || ' a piece' AS t
  FROM part WHERE p_brand <> 'Brand#13')
SELECT name, CASE WHEN length(t) > 60 THEN left(t, 60) || '...' ELSE t END AS description FROM d""",
    "tool_texts": """WITH t AS (SELECT p_partkey, p_name, replace(p_name, ' ', ' ') || ' ' || lower(p_type) AS name, trim(left(' ' || repeat(p_brand || ' ', p_size), 300)) AS d FROM part)
SELECT p_partkey, 'Tool: ' || name || '. Purpose: ' || d || '.' || CASE WHEN p_partkey % 3 > 0 THEN ' Parameters: ' || replace(p_name, ' ', ', ') || '.' ELSE '' END AS text FROM t""",
    "dep_closure": """WITH RECURSIVE d AS (SELECT c_custkey AS name, c_custkey // 3 AS dep FROM customer
  UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_mktsegment = 'BUILDING'),
reach(name, member) AS (SELECT c_custkey, c_custkey FROM customer
  UNION SELECT r.name, dep FROM reach r JOIN d ON d.name = r.member WHERE dep IN (SELECT c_custkey FROM customer))
SELECT * FROM reach""",
    "jaccard_pairs": f"""WITH {_WORD_CLASSES},
p AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM c a JOIN c b ON a.rep < b.rep)
SELECT a, b, round(j, 4) AS jaccard FROM p WHERE j > 0""",
    "similar_parts": f"""WITH {_WORD_CLASSES},
p AS (SELECT a.rep, sum(b.size) AS far FROM c a JOIN c b ON a.rep <> b.rep AND 5 * len(list_intersect(a.w, b.w)) >= 3 * len(list_distinct(list_concat(a.w, b.w))) GROUP BY 1)
SELECT id, c.rep, (size - 1 + coalesce(far, 0))::BIGINT AS links FROM n JOIN c USING (w) LEFT JOIN p ON p.rep = c.rep""",
    "argmax_priority": """SELECT fe, source, value FROM (
  SELECT o_custkey AS fe, ['frame', 'entity', 'qualia', 'role', 'query', 'default'][o_orderkey % 6 + 1] AS source, o_orderstatus AS value,
    row_number() OVER (PARTITION BY o_custkey ORDER BY [80, 60, 40, 20, 20, 10][o_orderkey % 6 + 1] DESC, o_orderkey) AS r FROM orders) WHERE r = 1""",
    "gap_report": """WITH c AS (SELECT o_custkey AS fe, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT CASE WHEN NOT (c_nationkey % 2 = 0) THEN 'peripheral' WHEN c_acctbal > 0 AND n IS NULL THEN 'hard' ELSE 'pending' END AS gap, count(*) AS n
FROM customer LEFT JOIN c ON fe = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""",
    "relation_traverse": "SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "inverse_relations": """SELECT s_suppkey AS source, 'produces' AS type, s_nationkey::BIGINT AS target FROM supplier
UNION ALL SELECT s_nationkey::BIGINT, 'produced_by', s_suppkey FROM supplier""",
    "frame_inherit_merge": """WITH own AS (
  SELECT *, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey END AS parent FROM customer
), e AS (
  SELECT c_custkey AS frame, parent, 'segment' AS fe, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS type_ref, NULL::BOOLEAN AS required FROM own
  UNION ALL SELECT c_custkey, parent, 'balance', NULL, CASE WHEN c_acctbal < 0 THEN false END FROM own
  UNION ALL SELECT c_custkey, parent, 'name', c_name, true FROM own
), p AS (
  SELECT n_nationkey AS parent, 'segment' AS fe, 'Segment' AS t, true AS q FROM nation
  UNION ALL SELECT n_nationkey, 'balance', 'Money' || n_regionkey, n_regionkey > 2 FROM nation
) SELECT frame, e.fe, coalesce(type_ref, t) AS type_ref, coalesce(required, q) AS required FROM e LEFT JOIN p ON p.parent = e.parent AND p.fe = e.fe""",
    "dangling_ids": """SELECT c_custkey AS id, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
}
