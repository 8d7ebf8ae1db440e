"""Tagging, shallow dependencies and sense clusters of tokenised sentences.

A token table has doc_id, sent_id, idx, word, pos, with tags that begin with n (noun), v
(verb), d (adverb), p (preposition), r (pronoun), a (adjective), u (particle) or w (mark).
Whole sentences are arrays in one row, and neighbour searches are array functions over them: the
last (or next) place that is wanted counts if no barrier stands between.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text

# Closed word classes of the Latin-script tagger.
CLOSED = {
    "p": "of in to for with on at by from into over under".split(),
    "r": "i you he she it we they this that who which".split(),
    "d": "not very also now then already often never always".split(),
    "u": "the a an and or but".split(),
    "v": "is are was were be has have had do does did make makes made take takes took use uses used".split(),
}
SENTENCE = ("doc_id", "sent_id")


def tag_of(word: Column, terms: dict[str, str] | None = None) -> Column:
    """A domain term's own tag, else the closed class, else by ending, else noun."""
    listed = {w: tag for tag, words in CLOSED.items() for w in words} | (terms or {})
    by_tag: dict[str, list[str]] = {}
    for known, tag in listed.items():
        by_tag.setdefault(tag, []).append(known)
    # A hashed set a tag: a literal map would be searched from its start for every word.
    ends = lambda *of: reduce(lambda a, b: a | b, [word.endswith(end) for end in of])
    pos = F.when(ends("ly"), "d").when(ends("ing", "ed", "ise", "ize"), "v").otherwise("n")
    # Most words are in no set, so one of all of them is asked first.
    known = F.lit("n")
    for tag, own in by_tag.items():
        known = F.when(F.lower(word).isin(*own), tag).otherwise(known)
    return F.when(F.lower(word).isin(*listed), known).otherwise(pos)


def tagged(tokens: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    """Adds pos (:func:`tag_of`)."""
    return tokens.withColumn("pos", tag_of(F.col("word"), terms))


def is_verb(pos: str = "pos") -> Column:
    return F.col(pos).startswith("v")


def is_noun(pos: str = "pos") -> Column:
    return F.col(pos).startswith("n") | (F.col(pos) == "eng")


def _nearest(places: str, i: Column, before: bool) -> Column:
    """Of listed places in a sentence the nearest one on one side of ``i``, null if there is none."""
    if before:
        return F.array_max(F.filter(f"places.{places}", lambda j: j < i))
    return F.array_min(F.filter(f"places.{places}", lambda j: j > i))


def parsed_sentences(lists: DataFrame, terms: dict[str, str] | None = None, verbs: bool = False) -> DataFrame:
    """Whole sentences (doc_id, sent_id, w) with pos, places and edges, all inside their row: nothing moves.  ``verbs``: only those with a verb.

    ``places`` has the places of the verbs, nouns, subjects (nouns and pronouns), prepositions and adverbs;
    ``edges`` is that of :func:`dependency_edges` as an array of head, dep (places), rel and score.
    """
    rows = text.once(lists.where(F.size("w") > 0), [*SENTENCE, "w"], pos=F.transform("w", lambda x: tag_of(x, terms)))
    return with_edges(rows.where(F.exists("pos", lambda p: p.startswith("v"))) if verbs else rows)


def with_edges(rows: DataFrame) -> DataFrame:
    """Sentences (w and pos arrays, other columns kept) with places and edges."""
    kept = rows.columns
    at = lambda test: F.filter(F.sequence(F.lit(0), F.size("pos") - 1), lambda i: test(F.get("pos", i)))
    noun = lambda p: p.startswith("n") | (p == "eng")
    places = F.struct(
        at(lambda p: p.startswith("v")).alias("verbs"), at(noun).alias("nouns"), at(lambda p: noun(p) | p.startswith("r")).alias("subjects"),
        at(lambda p: p.startswith("p")).alias("preps"), at(lambda p: p.startswith("d")).alias("adverbs"),
    )
    rows = text.once(rows, kept, places=places)
    near = lambda name, i, before, alias: _nearest(name, i, before).alias(alias)
    rows = text.once(
        rows, [*kept, "places"],
        vs=F.transform("places.verbs", lambda i: F.struct(
            i.alias("i"), near("subjects", i, True, "s"), near("verbs", i, True, "b"), near("nouns", i, False, "o"), near("verbs", i, False, "a"))),
        ps=F.transform("places.preps", lambda i: F.struct(i.alias("i"), near("nouns", i, False, "o"), near("verbs", i, False, "v"))),
        ds=F.transform("places.adverbs", lambda i: F.struct(i.alias("i"), F.coalesce(_nearest("verbs", i, False), _nearest("verbs", i, True)).alias("v"))),
    )

    def edge(where: Column, head: Column, dep: Column, rel: str, near: int, high: float, low: float) -> Column:
        score = F.when(F.abs(head - dep) <= near, high).otherwise(low)
        return F.when(where, F.struct(head.alias("head"), dep.alias("dep"), F.lit(rel).alias("rel"), score.alias("score")))

    def held(s: Column) -> Column:
        """A noun is a preposition's own if one stands before it with no other noun between."""
        prep, other = _nearest("preps", s, True), _nearest("nouns", s, True)
        return F.array_contains("places.nouns", s) & prep.isNotNull() & (other.isNull() | (prep > other))

    def subject(x: Column) -> Column:
        own = x["s"].isNotNull() & (x["b"].isNull() | (x["s"] > x["b"]))
        return edge(F.when(own, ~held(x["s"])).otherwise(False), x["i"], x["s"], "nsubj", 1, 0.8, 0.65)

    found = F.concat(
        F.transform("ds", lambda x: edge(x["v"].isNotNull(), x["v"], x["i"], "advmod", 1, 0.8, 0.65)),
        F.transform("ps", lambda x: edge(x["o"].isNotNull(), x["i"], x["o"], "pobj", 2, 0.7, 0.55)),
        F.transform("ps", lambda x: edge(x["o"].isNotNull() & x["v"].isNotNull(), x["v"], x["i"], "prep", 2, 0.7, 0.55)),
        F.transform("vs", subject),
        F.transform("vs", lambda x: edge(x["o"].isNotNull() & (x["a"].isNull() | (x["o"] < x["a"])), x["i"], x["o"], "obj", 1, 0.8, 0.65)),
    )
    return text.once(rows, [*kept, "places"], edges=F.array_compact(found))


def dependency_edges(tokens: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(doc_id, sent_id, head, dep, rel, score, candidate) of a shallow parse of a token table.

    Verbs get the nearest noun or pronoun before them (nsubj) and noun behind (obj), adverbs
    hang on the nearest verb (behind first), prepositions take the nearest noun behind (pobj)
    and hang on the next verb (prep).  Other verbs are barriers for subjects and objects.
    Near words score higher.  A sentence's words are gathered in one row.
    """
    words = F.array_sort(F.collect_list(F.struct("idx", "pos")))
    rows = tokens.groupBy(*SENTENCE).agg(words.alias("t")).select(*SENTENCE, F.col("t.idx").alias("at"), F.col("t.pos").alias("pos"))
    out = with_edges(rows).select(*SENTENCE, "at", F.explode("edges").alias("e"))
    out = out.select(*SENTENCE, F.get("at", F.col("e.head")).alias("head"), F.get("at", F.col("e.dep")).alias("dep"), "e.rel", "e.score")
    return out.withColumn("candidate", F.col("score") < confidence)


def first_heads(edges: DataFrame) -> DataFrame:
    """One head a dependent: that of the highest score, then the first head."""
    best = F.row_number().over(Window.partitionBy(*SENTENCE, "dep").orderBy(F.desc("score"), "head", "rel"))
    return edges.withColumn("_r", best).where("_r = 1").drop("_r")


class _Senses:
    """Single-link clusters of one word's bags, taken in their order; bags after the ``most``-th cluster appears are only counted."""

    def __init__(self, lu: str, threshold: float, most: int) -> None:
        self.lu, self.threshold, self.most = lu, threshold, most
        self.n, self.made = 0, []  # clusters: {bag: how often}

    def full(self) -> bool:
        return len(self.made) >= self.most

    def put(self, bag: frozenset) -> None:
        for c in self.made:
            if bag in c:  # all that it links is in its cluster already
                c[bag] += 1
                return
        linked = [c for c in self.made if any(len(bag & x) > self.threshold * len(bag | x) for x in c)]
        joined = {x: n for c in linked for x, n in c.items()} | {bag: 1}
        self.made = [c for c in self.made if not any(c is x for x in linked)] + [joined]

    def rows(self, least: int, usable: int) -> list[tuple]:
        sizes = [(sum(c.values()), c) for c in self.made]
        found = [(size, c) for size, c in sizes if size >= 2] if self.n >= usable else []
        order = lambda x: (-x[0], sorted(sorted(bag) for bag, n in x[1].items() for _ in range(n)))
        out = []
        for place, (size, c) in enumerate(sorted(found, key=order), 1):
            count: dict[str, int] = {}
            for bag, n in c.items():
                for w in bag:
                    count[w] = count.get(w, 0) + n
            top = sorted(count, key=lambda w: (-count[w], w))[:8]
            out.append((self.lu, place, size, top, least <= len(found) <= self.most))
        return out


def sense_clusters(
    bags: DataFrame, threshold: float = 0.30, least: int = 2, most: int = 3, usable: int = 4, limit: int = 500
) -> DataFrame:
    """Senses of each word from the words around it: (lu, sense, size, signature, polysemy).

    ``bags``: lu, doc_id, sent_id, words array<string>.  Clusters depend on the order of the
    bags, which is (doc_id, sent_id); at most ``limit`` bags a word are looked at, a limit
    of the method itself, so a group is bounded.  Clusters of one bag are no senses.
    A task reads its words' bags in order as one stream and holds one word's at a time.
    """
    rank = F.row_number().over(Window.partitionBy("lu").orderBy("doc_id", "sent_id"))
    few = bags.withColumn("_r", rank).where(F.col("_r") <= limit)
    others = F.array_distinct(F.filter("words", lambda w: w != F.col("lu")))
    # A word's rows are in one task since the window; bags without words were counted by the limit.
    own = text.once(few, ["lu", "_r"], words=others).where(F.size("words") > 0).sortWithinPartitions("lu", "_r")
    schema = pa.schema([("lu", pa.string()), ("sense", pa.int32()), ("size", pa.int32()), ("signature", pa.list_(pa.string())), ("polysemy", pa.bool_())])

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Senses | None = None
        for batch in batches:
            made, words = [], batch.column(1)
            for i, lu in enumerate(batch.column(0).to_pylist()):
                if now is None or lu != now.lu:
                    made += now.rows(least, usable) if now else []
                    now = _Senses(lu, threshold, most)
                now.n += 1
                if not now.full():
                    now.put(frozenset(words[i].as_py()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in made], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in now.rows(least, usable)], schema=schema)

    return own.select("lu", "words").mapInArrow(cluster, "lu string, sense int, size int, signature array<string>, polysemy boolean")


def phrase_counts(edges: DataFrame) -> DataFrame:
    """(phrase, n) of noun-of-noun phrases: head_word, dep_word, sentence_score; weak sentences don't count."""
    rows = edges.where("rel = 'amod'").select(F.concat("dep_word", F.lit("的"), "head_word").alias("phrase"), "sentence_score")
    return rows.groupBy("phrase").agg(F.count_if(F.col("sentence_score") >= 0.7).alias("n")).where("n > 0")


def merge_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Words (lu, tag) with their phrases (lu, phrase); phrases of unknown words come as rows of their own."""
    listed = phrases.groupBy("lu").agg(F.array_sort(F.collect_list("phrase")).alias("phrases"))
    rows = words.join(listed, "lu", "full_outer")
    return rows.withColumn("tag", F.coalesce("tag", F.lit("Deverbal_Noun")))


def parsed_by(tokens: DataFrame, backend=None, confidence: float = 0.7) -> DataFrame:
    """Edges by a parser of one's own (a function of the tokens, with ``dependency_edges``' columns), else by rules.

    A backend that cannot make its plan gives way to the rules.  Its rows are lazy: failures
    while they are worked out are the job's.
    """
    wanted = ["doc_id", "sent_id", "head", "dep", "rel", "score", "candidate"]
    if backend is not None:
        try:
            return backend(tokens).select(*wanted)
        except Exception:  # noqa: BLE001  any failure means the rules
            pass
    return dependency_edges(tokens, confidence).select(*wanted)
