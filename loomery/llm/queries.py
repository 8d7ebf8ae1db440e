"""The queries ``op1_...`` to ``op13_...`` over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import alignment, audit, fingerprints, language, linededup, minhash, packing, pieces, pii, quality, rules, sharding, urls
from loomery.llm.util import read


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=16)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.compare_with_edits(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op4_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    made = pii.find(docs, pii.train(docs))
    return made.select(
        "doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(rules.ledger(read(spark, sf_dir, "documents")))


URL_RULES = """VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"""


def op7_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.sql(f"SELECT * FROM {URL_RULES} AS t(host, path, verdict)")
    return urls.filter_urls(read(spark, sf_dir, "pages"), listed)


def op8_piece_rounds(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    made = pieces.encode_documents(read(spark, sf_dir, "documents"), model)
    return made.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts_as="lines")
    return made.select("doc_id", "text", "lines.n_lines", "lines.n_dropped")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), model or public_tokenizers.path("byte_bpe_50k.json"))


def op11_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    byte_model = byte_model or public_tokenizers.path("byte_bpe_50k.json")
    piece_model = piece_model or public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(read(spark, sf_dir, "documents"), byte_model, piece_model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_weighted_fingerprints": op3_weighted_fingerprints,
    "op4_factorisation_quality": op4_factorisation_quality,
    "op5_skip_chain_pii": op5_skip_chain_pii,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_url_range_join": op7_url_range_join,
    "op8_piece_rounds": op8_piece_rounds,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_byte_language": op11_byte_language,
    "op12_filter_audit": op12_filter_audit,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN []::VARCHAR[]
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM reach r JOIN both_ways e ON e.u = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

OP6_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
    unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k + 2])) AS g
  FROM words WHERE len(w) >= 3
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c >= 2),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n - lines.d, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines, length(text) AS n_chars,
    text
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT AS b0, (100 * n_repeat_words > 50 * n_words)::BIGINT AS b1,
    (100 * n_symbols > 25 * n_words)::BIGINT AS b2, (100 * n_dup_lines > 50 * n_lines)::BIGINT AS b3,
    (10 * word_chars < 20 * n_words)::BIGINT AS b4, (word_chars > 20 * n_words)::BIGINT AS b5,
    (2 * length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))
      < n_chars + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')))::BIGINT AS b6,
    (10 * (SELECT count(DISTINCT x) FROM unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS u(x)) < n_words
      AND n_words < 1000)::BIGINT AS b7
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  b0 + b1 > 0 AS base_failed, b0 + b1 + b2 + b3 + b4 + b5 + b6 = 0 AS kept,
  b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 + 128 * b7 AS failed
FROM f
"""

OP7_SQL = f"""
WITH rules AS (SELECT * FROM ({URL_RULES}) AS t(rule_host, rule_path, verdict)),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(r, '^([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(a)))::BIGINT AS line, unnest(a) AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), worded AS (
  SELECT *, string_split(l, ' ') AS w FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), firsts AS (SELECT w, min((doc_id, line)) AS pos FROM worded GROUP BY w),
long_ AS (SELECT *, len(w) AS n FROM firsts WHERE len(w) >= 8),
cuts AS (
  SELECT pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT pos, n, w, unnest(range(1, n + 1)) AS i FROM long_)
), near AS (
  SELECT a.pos FROM cuts a JOIN cuts b ON a.v = b.v AND a.n = b.n AND a.i = b.i AND b.pos < a.pos
  UNION SELECT a.pos FROM cuts a JOIN long_ b ON a.v = array_to_string(b.w, ' ') AND a.n = b.n + 1 AND b.pos < a.pos
  UNION SELECT b.pos FROM cuts a JOIN long_ b ON a.v = array_to_string(b.w, ' ') AND a.n = b.n + 1 AND a.pos < b.pos
), kept AS (SELECT pos FROM firsts WHERE pos NOT IN (SELECT pos FROM near)),
marked AS (
  SELECT lines.*, NOT regexp_matches(l, '[^\x20\x09-\x0D]') OR kept.pos IS NOT NULL AS stays
  FROM lines LEFT JOIN kept ON kept.pos = (doc_id, line)
), built AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY line) FILTER (stays) AS text,
    count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(b.text, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN built b USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) < doc_id AS e FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), sums AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM judged GROUP BY ALL
), letters AS (SELECT unnest(string_split('ABCDE', '')) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), places AS (SELECT o, s::INTEGER AS s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) AS r(s)),
met AS (
  SELECT part, o, s, f, n, g, x, fails, contains(fails, f) AS own,
    length(translate(fails, before, '')) < length(fails) AS gone
  FROM sums, places
), counted AS (
  SELECT part, o AS filter_order, s AS step, f,
    coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(g) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (own AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

SQL: dict[str, str] = {
    "op12_filter_audit": OP12_SQL,
    "op9_line_dedup": OP9_SQL,
    "op6_rule_ledger": OP6_SQL,
    "op7_url_range_join": OP7_SQL,
    "op2_minhash_dedup": OP2_SQL,
}
