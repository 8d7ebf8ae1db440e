"""Words of scripts without spaces: the most probable path through a sentence's word graph.

A dictionary has terms with frequencies and tags; terms of a domain are injected over it with a
frequency of their own.  A sentence is cut into blocks of word characters.  In a block each dictionary term
that stands there, and each *atom* (one character of the script, or a whole run of other letters, digits and ``_``),
is an edge of the word graph; a term of other letters counts only as a whole run.  The path of the
highest product of relative frequencies wins, the longer first word where two are equal;
an unknown atom counts as if seen once.

The dictionary goes to every task, so it is bounded (``most`` terms; more raise).

Defined results: null and empty texts have no words; terms are told apart by case; a repeated term has the
highest frequency of its rows, an injected one its own; terms with other characters than those of
words are found where their characters stand side by side in one block only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are words of their own if no term holds them.
CJK = "一-鿿"
INJECTED = 9999
_WORDS = "array<struct<word:string,tag:string,start:int>>"


@dataclass
class Lexicon:
    """Terms with frequency and tag, and every beginning of one."""

    terms: dict[str, tuple[float, str]]
    script: str = CJK
    beginnings: set[str] = field(default_factory=set)
    total: float = 1.0

    def __post_init__(self) -> None:
        for term in self.terms:
            self.beginnings.update(term[:n] for n in range(1, len(term) + 1))
        self.total = max(1.0, sum(f for f, _ in self.terms.values()))
        self._block = re.compile(rf"[{self.script}\w+#&.%-]+")
        self._own = re.compile(f"[{self.script}]")
        self._run = re.compile(rf"(?:(?![{self.script}])\w)+")

    def cut(self, text: str) -> list[tuple[str, str, int]]:
        """(word, tag, start) of every word."""
        out = []
        for block in self._block.finditer(text):
            out += [(w, tag, block.start() + at) for w, tag, at in self._path(block[0])]
        return out

    def _path(self, s: str) -> list[tuple[str, str, int]]:
        n, log = len(s), math.log(self.total)
        # Where the run of other letters that a place lies in begins and ends.
        edge = [(i, i) for i in range(n + 1)]
        for m in self._run.finditer(s):
            for i in range(m.start(), m.end()):
                edge[i] = (m.start(), m.end())
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            first, last = edge[i]
            stops = {i + 1 if last == i else last: 0.0}  # the atom
            if first == i or last == i:
                j = i + 1
                while j <= n and s[i:j] in self.beginnings:
                    inside = j < n and edge[j][0] < j and edge[j][1] > j
                    if not inside and s[i:j] in self.terms:
                        stops[j] = math.log(self.terms[s[i:j]][0])
                    j += 1
            else:  # no word begins inside a run
                continue
            best[i] = max((weight - log + best[j][0], j) for j, weight in stops.items())
        out, i = [], 0
        while i < n:
            j = best[i][1]
            word = s[i:j]
            if word in self.terms or self._own.match(word) or self._run.match(word):
                out.append((word, self._tag(word), i))
            i = j
        return out

    def _tag(self, word: str) -> str:
        if word in self.terms:
            return self.terms[word][1]
        return "x" if self._own.match(word) else "m" if word.isdigit() else "eng"


def lexicon(terms: DataFrame, injected: DataFrame | None = None, script: str = CJK, most: int = 1_000_000) -> Lexicon:
    """A dictionary out of tables: ``terms`` (term, freq, tag), ``injected`` (term; freq and tag if it has them).

    An injected term without a tag is ``nz`` if it has a letter, else ``n``.
    """
    rows = terms.select("term", F.col("freq").cast("double").alias("freq"), F.col("tag").cast("string").alias("tag"), F.lit(0).alias("own"))
    if injected is not None:
        named = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), other) if c in injected.columns else other
        tag = F.when(F.col("term").rlike(r"\p{L}"), "nz").otherwise("n")
        rows = rows.unionByName(
            injected.select("term", named("freq", "double", F.lit(float(INJECTED))).alias("freq"), named("tag", "string", tag).alias("tag"), F.lit(1).alias("own"))
        )
    best = rows.where("term is not null and term <> '' and freq > 0").groupBy("term").agg(F.max(F.struct("own", "freq", "tag")).alias("r"))
    found = best.select("term", "r.freq", "r.tag").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a dictionary of more than {most} terms is not sent to every task")
    return Lexicon({r["term"]: (r["freq"], r["tag"] or "x") for r in found}, script)


def segment(rows: DataFrame, lex: Lexicon, body: str = "text", into: str = "words") -> DataFrame:
    """``rows`` with a column of words: array of (word, tag, start in characters)."""
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    @F.udf(_WORDS, useArrow=True)
    def cut(text):
        return shared.value.cut(text) if text else []

    return rows.withColumn(into, cut(F.col(body).cast("string")))


def sentence_words(sents: DataFrame, lex: Lexicon, least: int = 2) -> DataFrame:
    """Sentences (doc_id, sent_id, sentence) with w and pos arrays, as the parser takes them; of fewer words than ``least`` they go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.cut(t) if t else [] for t in batch.column(2).to_pylist()]
            keep = [i for i, words in enumerate(found) if len(words) >= least]
            kept = batch.take(pa.array(keep, pa.int64()))
            w = pa.array([[x[0] for x in found[i]] for i in keep], pa.list_(pa.string()))
            pos = pa.array([[x[1] for x in found[i]] for i in keep], pa.list_(pa.string()))
            yield pa.record_batch([kept.column(0), kept.column(1), w, pos], names=["doc_id", "sent_id", "w", "pos"])

    shared = sents.sparkSession.sparkContext.broadcast(lex)
    kind = sents.schema["doc_id"].dataType.simpleString()
    return sents.select("doc_id", "sent_id", "sentence").mapInArrow(run, f"doc_id {kind}, sent_id int, w array<string>, pos array<string>")
