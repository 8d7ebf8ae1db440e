"""Collocation mining: sentences, word pairs, significance, entropy and templates.

The stages are plain DataFrame transformations over one lazy plan; ``tokens`` is the only
stage that several others read.  Thresholds are parameters with the defaults in ``Params``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import stats, text


@dataclass(frozen=True)
class Params:
    """Thresholds; the comparisons are strict or not as the names say."""

    split: str = text.SENTENCE_ENDS
    script: str | None = text.CJK  # sentences need two characters of it; None: any script
    min_length: int = 4
    max_length: int = 200
    confidence: float = 0.7
    reject_count_up_to: int = 4
    reject_docs_below: int = 3
    reject_llr_up_to: float = 3.84
    golden_llr_above: float = 6.63
    entropy_drop_from: float = 0.85
    entropy_active_to: float = 0.35
    seed_count: int = 5
    seed_objects: int = 3
    alpha: float = 1.0
    template_count: int = 2
    template_information: float = 1.5
    stopwords: tuple[str, ...] = ()


LATIN = Params(split=text.SENTENCE_ENDS + ".", script=None)


def sentences(docs: DataFrame, p: Params = LATIN, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, sent_id, sentence): cleaned sentences; sent_id is the place among all segments."""
    cut = docs.select(F.col(key).alias("doc_id"), F.posexplode_outer(text.split_class(F.col(body), p.split)).alias("sent_id", "s"))
    whole = text.once(cut, ["doc_id", "sent_id"], s=text.strip(F.col("s")))
    whole = whole.where((F.length("s") >= p.min_length) & ~F.col("s").rlike(text.NOISE))
    bared = text.once(whole, ["doc_id", "sent_id", "s"], bare=text.strip(F.regexp_replace("s", text.LEADER, "")))
    good = F.col("bare") != ""
    if p.script:
        good = good & F.col("bare").rlike(p.script)
    kept = bared.withColumn("s", F.when(good, F.col("bare")).otherwise(F.col("s")))
    if p.script:
        kept = kept.where(F.regexp_count("s", F.lit(p.script)) >= 2)
    return kept.select("doc_id", "sent_id", F.substring("s", 1, p.max_length).alias("sentence"))


def word_lists(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, w): a sentence's words, worked out once a sentence."""
    return text.once(sents, ["doc_id", "sent_id"], w=text.words(F.col("sentence")))


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, word)."""
    rows = word_lists(sents).select("doc_id", "sent_id", F.posexplode_outer("w").alias("idx", "word"))
    return rows.where("idx is not null")


def _neighbours(sents: DataFrame, size: int) -> DataFrame:
    """(doc_id, sent_id, idx, w1 .. w``size``) of neighbouring words; arrays zipped inside a row, no shuffle."""
    n = F.greatest(F.size("w") - (size - 1), F.lit(0))
    names = [f"w{i}" for i in range(1, size + 1)]
    zipped = F.arrays_zip(*[F.slice("w", i, n).alias(name) for i, name in enumerate(names, 1)])
    rows = word_lists(sents).select("doc_id", "sent_id", F.posexplode_outer(zipped).alias("idx", "t")).where("idx is not null")
    return rows.select("doc_id", "sent_id", "idx", *[F.col("t")[name].alias(name) for name in names])


def adjacent_edges(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, w1, w2): each word with its next one."""
    return _neighbours(sents, 2)


def unigrams(sents: DataFrame) -> DataFrame:
    """(word, c): in how many sentences a word occurs; the words are made distinct inside the row."""
    rows = word_lists(sents).select(F.explode_outer(F.array_distinct("w")).alias("word")).where("word is not null")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def pair_counts(edges: DataFrame, by: tuple[str, ...] = ("w1", "w2")) -> DataFrame:
    """Per pair: c (edges) and df (documents): counted by document first, so no distinct set is kept."""
    by_doc = edges.groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy(*by).agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("df"))


def ngram_counts(sents: DataFrame, most: int = 2, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """(w1 .. w``most``, c, df) of words, pairs and so on up to ``most`` neighbouring words, in one pass over the sentences.

    Words that a shorter one lacks are null.  A word's c is the number of its sentences, a longer
    one's that of its places; df is the number of documents.  Cut the lineage of the result and
    take the parts of it (:func:`of_length`), so that the sentences are worked out once for all.  ``lengths``: those to
    count, by default all.  Sentences dealt out by document are counted by document where they are.
    """
    w, n = F.col("w"), F.size("w")
    grams, every = w, {1: F.array_distinct(w)}
    for k in range(1, most):
        left = F.greatest(n - k, F.lit(0))
        grams = F.zip_with(F.slice(grams, 1, left), F.slice(w, k + 1, left), lambda a, b: F.concat(a, F.lit(" "), b))
        every[k + 1] = grams
    asked = [every[k] for k in lengths or every]
    rows = word_lists(sents).select("doc_id", F.explode(F.concat(*asked)).alias("gram"))
    by_doc = rows.groupBy("gram", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = by_doc.groupBy("gram").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("df"))
    # Words are letters only, so a space parts them.
    parts = F.split("gram", " ")
    return counted.select(*[F.get(parts, F.lit(i)).alias(f"w{i + 1}") for i in range(most)], "c", "df")


def of_length(counts: DataFrame, size: int) -> DataFrame:
    """The part of :func:`ngram_counts` with that many words: (word, c) for one, else (w1 .. , c, df)."""
    names = [c for c in counts.columns if c.startswith("w")]
    own = counts.where(F.col(names[size - 1]).isNotNull())
    own = own.where(F.col(names[size]).isNull()) if size < len(names) else own
    return own.select(F.col("w1").alias("word"), "c") if size == 1 else own.select(*names[:size], "c", "df")


def first_examples(edges: DataFrame, by: tuple[str, ...] = ("w1", "w2"), limit: int = 5) -> DataFrame:
    """The first supporting sentences of each pair: a ranked limit, pushed before the shuffle by Spark."""
    seen = edges.select(*by, "doc_id", "sent_id").distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "sent_id"))
    few = seen.withColumn("rank", rank).where(F.col("rank") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "sent_id")))
    return few.groupBy(*by).agg(listed.alias("sents"))


def classified_edges(parsed: DataFrame, p: Params = Params()) -> DataFrame:
    """Edges of a dependency parse as typed pairs.

    ``parsed``: doc_id, sent_id, head_word, dep_word, dep_idx, rel, score.  obj and nsubj whose
    dependent is also the object of a preposition in the sentence are left out; edges of low
    confidence are marked ``candidate`` and only count as weak evidence.
    """
    pobj = parsed.where("rel = 'pobj'").select("doc_id", "sent_id", "dep_idx").distinct()
    own = parsed.where("rel in ('obj', 'nsubj')").join(pobj, ["doc_id", "sent_id", "dep_idx"], "left_anti")
    rest = parsed.where("rel in ('advmod', 'prep', 'pobj')")
    kind = (
        F.when(F.col("rel").isin("obj", "nsubj"), "pred_noun")
        .when(F.col("rel") == "advmod", "pred_adv")
        .when(F.col("rel") == "prep", "pred_prep")
        .otherwise("prep_pobj")
    )
    typed = own.unionByName(rest).select(
        "doc_id", "sent_id", F.col("head_word").alias("w1"), F.col("dep_word").alias("w2"),
        kind.alias("type"), "rel", (F.col("score") < p.confidence).alias("candidate"),
    )
    if p.stopwords:
        typed = typed.where(~F.col("w1").isin(*p.stopwords) & ~F.col("w2").isin(*p.stopwords))
    return typed


def typed_edges(sentences: DataFrame, p: Params = Params()) -> DataFrame:
    """:func:`classified_edges` out of whole sentences (doc_id, sent_id, w, edges): no join, nothing moves."""
    bound = F.transform(F.filter("edges", lambda e: e["rel"] == "pobj"), lambda e: e["dep"])
    rows = text.once(sentences, ["doc_id", "sent_id", "w", "edges"], bound=bound)
    free = F.filter("edges", lambda e: ~(e["rel"].isin("obj", "nsubj") & F.array_contains("bound", e["dep"])))
    rows = rows.select("doc_id", "sent_id", "w", F.explode(free).alias("e"))
    rel = F.col("e.rel")
    kind = F.when(rel.isin("obj", "nsubj"), "pred_noun").when(rel == "advmod", "pred_adv").when(rel == "prep", "pred_prep").otherwise("prep_pobj")
    typed = rows.select(
        "doc_id", "sent_id", F.get("w", F.col("e.head")).alias("w1"), F.get("w", F.col("e.dep")).alias("w2"),
        kind.alias("type"), rel.alias("rel"), (F.col("e.score") < p.confidence).alias("candidate"),
    )
    if p.stopwords:
        typed = typed.where(~F.col("w1").isin(*p.stopwords) & ~F.col("w2").isin(*p.stopwords))
    return typed


def sentence_trigrams(sentences: DataFrame, listed: DataFrame | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """:func:`tagged_trigrams` out of whole sentences (doc_id, sent_id, w, places, edges); all verbs unless some are listed."""
    w, at = F.col("w"), lambda name: F.col(f"places.{name}")
    stop = (lambda i: F.get(w, i).isin(*stopwords)) if stopwords else (lambda i: F.lit(False))

    def first_head(j: Column) -> Column:
        own = F.filter("edges", lambda e: e["dep"] == j)
        return F.array_min(F.transform(own, lambda e: F.struct((-e["score"]).alias("s"), e["head"].alias("h"), e["rel"].alias("rel"))))["rel"]

    rows = text.once(
        sentences.where(F.size(at("verbs")) > 0), ["doc_id", "sent_id", "w", "places"],
        objects=F.filter(at("nouns"), lambda j: first_head(j) == "obj"),
    )
    near = F.transform(
        at("verbs"),
        lambda v: F.struct(
            v.alias("v"), F.array_min(F.filter("objects", lambda j: j > v)).alias("obj"),
            F.array_min(F.filter(at("adverbs"), lambda j: F.abs(j - v) <= 2)).alias("adv"),
            F.array_min(F.filter(at("preps"), lambda j: (j < v) & ~stop(j))).alias("prep"),
        ),
    )
    rows = rows.select("doc_id", "sent_id", "w", "places", F.explode(near).alias("x"))
    between = F.array_min(F.filter(at("nouns"), lambda j: (j > F.col("x.prep")) & (j < F.col("x.v")) & ~stop(j)))
    rows = text.once(rows, ["doc_id", "sent_id", "w", "x"], pobj=between)
    word = lambda i: F.get(w, i)
    triple = lambda a, b, c, kind: F.struct(word(a).alias("w1"), word(b).alias("w2"), word(c).alias("w3"), F.lit(kind).alias("type"))
    x = lambda name: F.col(f"x.{name}")
    found = F.array(
        F.when(x("obj").isNotNull() & x("adv").isNotNull(), triple(x("adv"), x("v"), x("obj"), "adv_v_n")),
        F.when(F.col("pobj").isNotNull(), triple(x("prep"), F.col("pobj"), x("v"), "prep_n_v")),
    )
    out = rows.select("doc_id", "sent_id", word(x("v")).alias("verb"), F.explode(F.array_compact(found)).alias("t"))
    if listed is not None:
        out = out.join(listed.select(F.col("word").alias("verb")), "verb", "left_semi")
    return out.select("doc_id", "sent_id", "t.*")


def with_counts(pairs: DataFrame, uni: DataFrame, absent: int = 0) -> DataFrame:
    """Adds c1, c2 (``absent`` where a word has no count) and n, the sum of all word counts."""
    one = uni.select(F.col("word").alias("w1"), F.col("c").alias("c1"))
    two = uni.select(F.col("word").alias("w2"), F.col("c").alias("c2"))
    total = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))  # one row
    joined = pairs.join(one, "w1", "left").join(two, "w2", "left").crossJoin(F.broadcast(total))
    return joined.withColumn("c1", F.coalesce("c1", F.lit(absent))).withColumn("c2", F.coalesce("c2", F.lit(absent)))


def promising(counts: DataFrame, p: Params = LATIN) -> DataFrame:
    """Of counted words and pairs the words, and the pairs that :func:`gated` does not reject by their own counts.

    Only these pairs can pass, so only they need to be written and their words' counts.
    """
    return counts.where(F.col("w2").isNull() | (F.col("c") > p.reject_count_up_to) & (F.col("df") >= p.reject_docs_below))


def rejected_early(pairs: DataFrame, p: Params = LATIN) -> DataFrame:
    """(rejected_reason, c) of the pairs (w1, w2, c, df) that :func:`gated` rejects by their own counts: the rest of :func:`promising`."""
    return pairs.select(_early(p).alias("rejected_reason"), "c").where("rejected_reason is not null")


def _early(p: Params) -> Column:
    stop = F.col("w1").isin(*p.stopwords) | F.col("w2").isin(*p.stopwords) if p.stopwords else F.lit(False)
    return (
        F.when(stop, "stopword")
        .when(F.col("c") <= p.reject_count_up_to, f"freq<={p.reject_count_up_to}")
        .when(F.col("df") < p.reject_docs_below, f"df<{p.reject_docs_below}")
    )


def gated(counted: DataFrame, p: Params = LATIN) -> DataFrame:
    """Adds llr, passed, level and rejected_reason; the reasons are tried in order and rows are kept."""
    llr = stats.log_likelihood(F.col("c"), F.col("c1"), F.col("c2"), F.col("n"))
    rows = counted.withColumn("early", _early(p)).withColumn("raw", F.when(F.col("early").isNull(), llr))
    weak = F.when(F.col("raw") <= p.reject_llr_up_to, f"llr<={p.reject_llr_up_to:.2f}")
    return (
        rows.withColumn("rejected_reason", F.coalesce("early", weak))
        .withColumn("passed", F.col("rejected_reason").isNull())
        .withColumn("llr", F.round("raw", 4))
        .withColumn("level", F.when(F.col("passed"), F.when(F.col("raw") > p.golden_llr_above, "golden").otherwise("normal")))
        .drop("early", "raw")
    )


def is_placeholder(word: Column) -> Column:
    """Boolean-like words, digits and punctuated numbers say nothing about a verb's objects."""
    # Fixed values.
    like = ("true", "false", "yes", "no", "none", "null", "null值", "undefined")
    return F.lower(word).isin(*like) | word.rlike(r"^[0-9./:%+\-]+$")


def object_entropy(pairs: DataFrame, p: Params = LATIN) -> DataFrame:
    """Per w1: c_v, n_nouns, h, h_norm, tag, note, and the five commonest w2 (ties by word).

    ``pairs``: w1, w2, c.  The distribution is smoothed by ``alpha`` and the entropy set
    against that of an even one.  With t the sum of all c + alpha, the entropy is
    log2 t - sum((c + alpha) log2(c + alpha)) / t: sums that are partial before they move,
    so a word with very many objects is no task of its own.
    """
    counts = pairs.where(~is_placeholder(F.col("w2"))).groupBy("w1", "w2").agg(F.sum("c").alias("c"))
    smooth = F.col("c") + F.lit(p.alpha)
    sums = counts.groupBy("w1").agg(
        F.sum("c").alias("c_v"), F.count(F.lit(1)).alias("n_nouns"), F.sum(smooth).alias("t"), F.sum(smooth * F.log2(smooth)).alias("s")
    )
    each = sums.withColumn("h", F.log2("t") - F.col("s") / F.col("t"))
    # Spark keeps the first five of a word before rows move.
    rank = F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("c"), "w2"))
    first = counts.withColumn("rank", rank).where("rank <= 5").groupBy("w1").agg(F.array_sort(F.collect_list(F.struct("rank", "w2"))).alias("top"))
    each = each.join(first, "w1").withColumn("top", F.transform("top", lambda x: x["w2"]))
    norm = F.col("h") / F.log2(F.greatest(F.lit(2), F.col("n_nouns")))
    tag, note = tagged(F.col("c_v"), norm, F.col("n_nouns"), p)
    return each.select(
        "w1", "c_v", "n_nouns", F.round("h", 4).alias("h"), F.round(norm, 4).alias("h_norm"),
        tag.alias("tag"), note.alias("note"), F.array_join("top", ",").alias("top_nouns"),
    )


def tagged(count: Column, h_norm: Column, objects: Column, p: Params = LATIN) -> tuple[Column, Column]:
    """(tag, note) by the thresholds, tried in order."""
    steps = (
        (count < p.seed_count, "Keep_Watch", f"sample_limited(c<{p.seed_count})"),
        (objects < p.seed_objects, "Keep_Watch", f"objects<{p.seed_objects}"),
        (h_norm >= p.entropy_drop_from, "Drop_Light_Verb", f"high_entropy>={p.entropy_drop_from:.2f}"),
        (h_norm <= p.entropy_active_to, "Active_LU", f"low_entropy<={p.entropy_active_to:.2f}"),
    )
    tag = note = None
    for condition, name, why in steps:
        tag = F.when(condition, name) if tag is None else tag.when(condition, name)
        note = F.when(condition, why) if note is None else note.when(condition, why)
    return tag.otherwise("Keep_Watch"), note.otherwise("0.35<h_norm<0.85")


def whitelist(entropy: DataFrame, passed: DataFrame) -> DataFrame:
    """Active words and the first words of passed pairs, each once."""
    active = entropy.where("tag = 'Active_LU'").select(F.col("w1").alias("word"))
    return active.unionByName(passed.where("passed").select(F.col("w1").alias("word"))).distinct()


def trigram_edges(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, w1, w2, w3) of neighbouring words."""
    return _neighbours(sents, 3).drop("idx")


def tagged_trigrams(parsed_tokens: DataFrame, listed: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Adverb-verb-noun and preposition-noun-verb triples around listed verbs of tagged sentences.

    ``parsed_tokens``: doc_id, sent_id, idx, word, pos, dep_rel; one row a word.  Around a
    listed verb: the first object to its right with the first adverb within two places; the
    first preposition before it with the first noun between.
    """
    noun = F.col("pos").startswith("n") | (F.col("pos") == "eng")
    stop = F.col("word").isin(*stopwords) if stopwords else F.lit(False)
    verbs = (
        parsed_tokens.where(F.col("pos").startswith("v"))
        .join(listed, "word", "left_semi")
        .select("doc_id", "sent_id", F.col("idx").alias("v"), F.col("word").alias("verb"))
    )
    near = verbs.join(parsed_tokens.withColumn("noun", noun).withColumn("stop", stop), ["doc_id", "sent_id"])
    own = ("doc_id", "sent_id", "v", "verb")

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.struct("idx", "word")))

    right = (F.col("idx") > F.col("v")) & F.col("noun") & (F.col("dep_rel") == "obj")
    beside = (F.abs(F.col("idx") - F.col("v")) <= 2) & F.col("pos").startswith("d")
    before = (F.col("idx") < F.col("v")) & F.col("pos").startswith("p") & ~F.col("stop")
    found = near.groupBy(*own).agg(first(right).alias("obj"), first(beside).alias("adv"), first(before).alias("prep"))
    between = (
        found.where("prep is not null")
        .join(parsed_tokens.withColumn("noun", noun).withColumn("stop", stop), ["doc_id", "sent_id"])
        .where((F.col("idx") > F.col("prep")["idx"]) & (F.col("idx") < F.col("v")) & F.col("noun") & ~F.col("stop"))
        .groupBy(*own, "prep")
        .agg(F.min(F.struct("idx", "word")).alias("pobj"))
    )
    one = found.where("obj is not null and adv is not null").select(
        "doc_id", "sent_id", F.col("adv")["word"].alias("w1"), F.col("verb").alias("w2"),
        F.col("obj")["word"].alias("w3"), F.lit("adv_v_n").alias("type"),
    )
    two = between.select(
        "doc_id", "sent_id", F.col("prep")["word"].alias("w1"), F.col("pobj")["word"].alias("w2"),
        F.col("verb").alias("w3"), F.lit("prep_n_v").alias("type"),
    )
    return one.unionByName(two)


def frequent_words(uni: DataFrame, most: int = 100_000) -> DataFrame:
    """The most frequent words (word, c), ``most`` at most: all with a count of at least a bound that is found from a histogram of 10,000 rows at most."""
    sizes = uni.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    bound, held = None, 0
    for size, n in sorted(sizes, reverse=True):
        held += n
        if held > most:
            break
        bound = size
    return uni.where(F.col("c") >= bound) if bound is not None else uni.limit(0)


def trigram_information(trigrams: DataFrame, uni: DataFrame, most: int = 100_000) -> DataFrame:
    """Adds pmi3; word counts are 1 at least.  ``trigrams``: w1, w2, w3, c, ...

    The counts of the ``most`` most frequent words are sent to all, a table of that size whatever the input's.  Only
    triples with another word, few of all, move to meet the other words' counts.
    """
    total = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    names = [f"c{i}" for i in (1, 2, 3)]

    def met(rows: DataFrame, words: DataFrame, into: str) -> DataFrame:
        for i in (1, 2, 3):
            rows = rows.join(words.select(F.col("word").alias(f"w{i}"), F.col("c").alias(f"{into}{i}")), f"w{i}", "left")
        return rows

    # Both branches below ask for words anyway; said before them, the rows they read are one shuffle's.
    trigrams = trigrams.where("w1 is not null and w2 is not null and w3 is not null")
    first = met(trigrams, F.broadcast(frequent_words(uni, most)), "c")
    whole = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in names])
    rest = met(first.where(~whole), uni, "_c")
    rest = rest.select(*trigrams.columns, *[F.coalesce(name, f"_{name}").alias(name) for name in names])
    rows = first.where(whole).select(*trigrams.columns, *names).unionByName(rest)
    rows = rows.withColumns({name: F.greatest(F.lit(1), F.coalesce(name, F.lit(1))) for name in names}).crossJoin(F.broadcast(total))
    pmi = stats.pointwise_information(F.col("c"), F.col("n"), F.col("c1"), F.col("c2"), F.col("c3"))
    return rows.withColumn("pmi3", F.round(pmi, 4))


def symmetric_counts(pairs: DataFrame) -> DataFrame:
    """(w1, w2, c12) with a pair's count in both directions summed."""
    turned = pairs.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "c")
    return pairs.select("w1", "w2", "c").unionByName(turned).groupBy("w1", "w2").agg(F.sum("c").alias("c12"))


def templates(trigrams: DataFrame, pairs: DataFrame, uni: DataFrame, p: Params = LATIN) -> DataFrame:
    """Adds pmi_partial (of the third word given the first two) and passed; rare rows and unseen pairs go."""
    third = uni.select(F.col("word").alias("w3"), F.col("c").alias("cw3"))
    total = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    often = trigrams.where(F.col("c") >= p.template_count)
    # Pairs that begin no such triple need no sum.
    asked = often.select("w1", "w2").distinct()
    turned = asked.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"))
    some = pairs.join(asked.unionByName(turned).distinct(), ["w1", "w2"], "left_semi")
    rows = (
        often.join(symmetric_counts(some), ["w1", "w2"])
        .join(third, "w3", "left")
        .crossJoin(F.broadcast(total))
    )
    partial = stats.pointwise_information(F.col("c"), F.col("n"), F.col("c12"), F.coalesce("cw3", F.lit(1)))
    return (
        rows.where("c12 > 0")
        .withColumn("raw", partial)
        .withColumn("pmi_partial", F.round("raw", 4))
        .withColumn("passed", F.col("raw") >= p.template_information)
        .drop("raw")
    )


def word_offsets(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, place, word, start, end) of the Latin words with apostrophes; offsets in characters, end exclusive.

    A text is cut into runs that are words or not, the two kinds in turn; a word's place is that among
    the runs, and it starts where the runs before it end.  That is summed inside the text's own row, in blocks
    of runs so that long texts take linear time: rows that share an id are apart, and nothing moves.  A block's
    starts are copied with each run, so short texts have short blocks.
    """
    runs = F.regexp_extract_all(body, F.lit("[A-Za-z']+|[^A-Za-z']+"), F.lit(0))
    rows = text.once(docs, [F.col(key).alias("doc_id")], runs=runs).where(F.size("runs") > 0)
    rows = rows.withColumn("block", F.least(F.lit(256), F.greatest(F.lit(16), F.sqrt(F.size("runs")).cast("int"))))
    block = F.col("block")
    last = F.floor((F.size("runs") - 1) / block).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("runs", b * block + 1, block))
    rows = text.once(rows, ["doc_id", "block"], parts=parts)
    rows = text.once(rows, ["doc_id", "block", "parts"], sizes=F.transform("parts", lambda own: F.length(F.array_join(own, ""))))
    rows = rows.select("doc_id", "block", "sizes", F.posexplode("parts").alias("b", "part"))
    start = F.aggregate(F.slice("sizes", F.lit(1), F.col("b")), F.lit(0), lambda s, x: s + x)
    rows = text.once(rows, ["doc_id", "block", "b", "part"], first=start)
    blank = F.struct(F.col("first").alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
    starts = F.aggregate("part", blank, step)["starts"]
    rows = text.once(rows, ["doc_id", "block", "b", "part"], starts=starts)
    rows = rows.select("doc_id", "block", "b", F.posexplode(F.arrays_zip("part", "starts")).alias("i", "x"))
    rows = rows.select("doc_id", (F.col("b") * block + F.col("i")).alias("place"), F.col("x.part").alias("word"), F.col("x.starts").cast("long").alias("start"))
    return rows.where(F.col("word").rlike("^[A-Za-z']")).withColumn("end", F.col("start") + F.length("word"))


def word_counts(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, word, n): how often a document has each word of :func:`word_offsets`.

    Documents are dealt out by their id first, so that their words are counted where they are cut and only what
    is counted moves on.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(body).alias("_body")).repartition("doc_id")
    each = rows.select("doc_id", F.explode(F.regexp_extract_all("_body", F.lit("[A-Za-z']+"), F.lit(0))).alias("word"))
    return each.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
