"""Alignment of two tokenizers over a corpus: which tokens share bytes, and how often all over.

A text's bytes are cut by a byte-level BPE (A, of a space and the text) and by a piece model (B, which
adds that space itself).  Where a token of A and one of B end together a group ends; two tokens
are linked if they share a byte, so each stretch between two ends of either side is one link.

1. One scan tokenises.  A unit (a space and the word behind it, a line break and the word behind it)
   ends for both tokenizers, so its tokens, groups and links are worked out once and remembered;
   texts with other white space are aligned whole.  It writes a row a document and *postings*: for
   some documents and one token of B, its partners in A and for each the documents that hold the pair and how
   often.  Both go to a table in the shared folder, so texts are tokenised once.
2. A pair's count is the sum over its postings, partial before it moves.
3. Counts and postings meet by token of B.  A token with many postings is dealt into parts by
   their documents and its counts go to each part.  Within a part Spark's (spilling)
   sort puts the counts, at most A's vocabulary, before the postings; these
   stream past, and what each adds to its documents is summed by document.

Nothing is dropped: a part's size is bounded by dealing, not by a cap.

Defined results: a null or empty text, and one whose tokens' bytes are not a space and the text
(it holds the piece model's mark U+2581 itself), has no tokens, zero in every number and an empty
hash; repeated rows and null ids are rows of their own; an empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import flat, packing, pieces
from loomery.llm.util import cut

#: Bytes of text whose postings are made together; their documents are numbered in 16 bits.
TEXT = 4 << 20
#: Postings of one token of B that a part gets, about.
PART = 400_000
_BATCH = 1 << 40  # numbers of documents in one task of the scan
_NONE = (0, "", b"")
#: A unit whose tokens are not its bytes: no text that holds it has any.
_BAD = (-(1 << 50), "", b"")

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class PlainTokens(packing.Tokens):
    """Byte-level ids where a special token's string is text like any other."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.model.encode_special_tokens = True
        self.added = []


class Aligner:
    """Two tokenizers, and the alignment of the units met so far (up to a bound)."""

    def __init__(self, byte_model: str, piece_model: str, remember: int = 200_000) -> None:
        self.a, self.b = PlainTokens(byte_model), pieces.Pieces(piece_model, remember=0)
        plain = packing._byte_of_character()
        vocabulary = self.a.model.get_vocab(with_added_tokens=False)
        self.text_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.text_a[i] = bytes([plain[c] for c in piece])
        self.width_a = np.array([len(t) for t in self.text_a])
        self.width_b = np.array([len(t) for t in self.b.text])
        self.text_b = self.b.text
        self.size_a = len(self.width_a)
        self.names = [str(i) for i in range(max(self.size_a, self.b.size))]
        self.remember = remember
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _side_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of B for texts that begin with their space, cut into its own units first."""
        marked = [t.replace(" ", pieces.SPACE) for t in texts]
        cuts = [[m] if m.find("\n") < 0 and m.rfind(pieces.SPACE) < 1 else pieces._UNIT.findall(m) for m in marked]
        units = [u for c in cuts for u in c]
        sizes = np.array([len(u) for u in units])
        short = np.flatnonzero(sizes <= pieces._LONG)
        merged: list[np.ndarray] = [None] * len(units)
        for i, symbols in zip(short.tolist(), self.b.merge([units[i] for i in short.tolist()])):
            merged[i] = symbols
        for i in np.flatnonzero(sizes > pieces._LONG).tolist():
            merged[i] = self.b.merge_long(units[i])
        count = np.array([len(m) for m in merged], dtype=np.int64)
        symbols = np.concatenate(merged) if merged else np.empty(0, np.int64)
        loose = np.flatnonzero(symbols >= pieces._LOOSE)
        if len(loose):  # characters outside the vocabulary: their bytes instead
            spelt = [[self.b.bytes[x] for x in chr(c).encode("utf-8", "replace")] for c in (symbols[loose] - pieces._LOOSE).tolist()]
            width = np.ones(len(symbols), dtype=np.int64)
            width[loose] = [len(x) for x in spelt]
            unit = np.repeat(np.arange(len(units)), count)
            count = np.bincount(unit, weights=width, minlength=len(units)).astype(np.int64)
            starts = np.cumsum(width) - width
            symbols = np.repeat(symbols, width)
            symbols[np.repeat(starts[loose], width[loose]) + _places(width[loose])] = [x for own in spelt for x in own]
        own = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        return symbols, np.bincount(own, weights=count, minlength=len(texts)).astype(np.int64)

    def align(self, texts: list[str], side_a: list[list[int]]) -> list[tuple[int, str, bytes]]:
        """(n_a, groups, pairs) of each text, ``_BAD`` where the two sides' bytes are not the text.

        ``pairs`` are its links as 64-bit numbers, token of B times A's size plus token of A.
        """
        a = np.array([x for own in side_a for x in own], dtype=np.int64)
        count_a = np.array([len(own) for own in side_a], dtype=np.int64)
        b, count_b = self._side_b(texts)
        bodies = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(x) for x in bodies], dtype=np.int64)
        text_a, text_b, of = self.text_a, self.text_b, np.arange(len(texts))
        of_a, of_b = np.repeat(of, count_a), np.repeat(of, count_b)
        size_a = np.bincount(of_a, weights=self.width_a[a], minlength=len(texts))
        size_b = np.bincount(of_b, weights=self.width_b[b], minlength=len(texts))
        good = (size_a == sizes) & (size_b == sizes) & (sizes > 0)
        if not good.all():
            a, b, of_a, of_b = a[good[of_a]], b[good[of_b]], of_a[good[of_a]], of_b[good[of_b]]
        whole = b"".join([x for x, ok in zip(bodies, good.tolist()) if ok])
        joined_a, joined_b = b"".join([text_a[x] for x in a.tolist()]), b"".join([text_b[x] for x in b.tolist()])
        if not whole == joined_a == joined_b:
            body, left, right = (np.frombuffer(x, np.uint8) for x in (whole, joined_a, joined_b))
            wrong = np.repeat(of[good], sizes[good])[(body != left) | (body != right)]
            good[wrong] = False
            a, b, of_a, of_b = a[good[of_a]], b[good[of_b]], of_a[good[of_a]], of_b[good[of_b]]
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        ends = np.union1d(end_a, end_b)  # each ends one link
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pair = b[at_b] * self.size_a + a[at_a]
        both = np.flatnonzero((end_a[at_a] == ends) & (end_b[at_b] == ends)) if len(ends) else at_a
        names_a, names_b = [self.names[x] for x in a.tolist()], [self.names[x] for x in b.tolist()]
        groups, x, y = [], 0, 0
        for p, q in zip((at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()):
            groups.append(
                f"{names_a[x]}|{names_b[y]}" if p == x + 1 and q == y + 1 else f"{','.join(names_a[x:p])}|{','.join(names_b[y:q])}"
            )
            x, y = p, q
        stop = np.cumsum(np.where(good, sizes, 0))
        link_edge = np.searchsorted(ends, stop, side="right")
        group_edge = np.searchsorted(both, link_edge).tolist()
        body, link_edge = pair.tobytes(), (8 * link_edge).tolist()
        out, i, j = [], 0, 0
        for ok, n, k, m in zip(good.tolist(), count_a.tolist(), group_edge, link_edge):
            out.append((n, ";".join(groups[i:k]), body[j:m]) if ok else _BAD)
            i, j = k, m
        return out

    def _units(self, text: str) -> list[str] | None:
        """Units that end for both tokenizers; None where the white space is of other kinds."""
        spaced = " " + text
        if packing._GAPS.search(spaced) or "\0" in spaced or any(r in spaced for r in packing._RUNS):
            return None
        return spaced.replace("\n", " \n").split(" ")[1:]

    def learn(self, keys: list[str]) -> dict[str, tuple[int, str, bytes]]:
        fresh = {}
        encode = self.a.units.encode_ordinary
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            texts = [k if k[:1] == "\n" else " " + k for k in part]
            fresh.update(zip(part, self.align(texts, [encode(t) for t in texts])))
        if len(self.known) < self.remember:
            self.known.update((k, v) for k, v in fresh.items() if len(k) <= 40)
        return fresh

    def documents(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(n_a, groups, pairs) of each text; of texts without tokens ``_NONE``."""
        units = [self._units(t) if t else [] for t in texts]
        get = self.known.get
        found = [None if own is None else [get(u) for u in own] for own in units]
        fresh = self.learn(list({u for own, got in zip(units, found) if got and None in got for u, g in zip(own, got) if g is None}))
        out = []
        for t, own, got in zip(texts, units, found):
            if own is None:
                spaced = " " + t
                ids = np.frombuffer(self.a.ids([spaced])[0], dtype="<u4").tolist()
                aligned = self.align([spaced], [ids])[0]
                out.append(_NONE if aligned is _BAD else aligned)
                continue
            if None in got:
                got = [fresh[u] if g is None else g for u, g in zip(own, got)]
            n = sum([g[0] for g in got])
            out.append((n, ";".join([g[1] for g in got]), b"".join([g[2] for g in got])) if n > 0 else _NONE)
        return out


def _numbers(own: list[tuple[int, str, bytes]]) -> list[list[int]]:
    """n_a, n_b, n_groups, n_links: a group of p and q tokens has p + q - 1 links."""
    n_a, n_groups, n_links = [g[0] for g in own], [g[1].count("|") for g in own], [len(g[2]) // 8 for g in own]
    return [n_a, [x + g - a for a, g, x in zip(n_a, n_groups, n_links)], n_groups, n_links]


_aligners: dict[tuple[str, str], Aligner] = {}


def _shared(byte_model: str, piece_model: str) -> Aligner:
    """One aligner a worker process, kept between tasks."""
    if (byte_model, piece_model) not in _aligners:
        _aligners[byte_model, piece_model] = Aligner(byte_model, piece_model)
    return _aligners[byte_model, piece_model]


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column over one buffer; ``edges`` are positions in ``values``."""
    offsets = (edges * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def posted(pairs: list[bytes], size_a: int) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(b, partners, docs, times) of some documents' links: their postings by token of B.

    ``partners``: 32-bit numbers, token of A and how many postings it has, again and again; ``docs``: the documents'
    16-bit places here; ``times``: how often, in 8 bits (a pair that is there more often has several postings).
    """
    n = len(pairs)
    flat_pairs = np.frombuffer(b"".join(pairs), dtype=np.int64)
    doc = np.repeat(np.arange(n), [len(p) // 8 for p in pairs])
    code, times = np.unique(flat_pairs * n + doc, return_counts=True)
    copies = -(-times // 255)
    if copies.max(initial=1) > 1:
        last = np.cumsum(copies) - 1
        code, spare = np.repeat(code, copies), times - 255 * (copies - 1)
        times = np.full(len(code), 255)
        times[last] = spare
    pair, doc = code // n if n else code, code % n if n else code
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
    b = pair[first] // size_a
    partner = np.column_stack([pair[first] % size_a, np.diff(np.r_[first, len(pair)])]).astype(np.int32)
    row = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
    edge = np.r_[first[row], len(pair)]
    return (
        b[row], _binaries(partner.reshape(-1), 2 * np.r_[row, len(b)]), _binaries(doc.astype(np.uint16), edge),
        _binaries(times.astype(np.uint8), edge),
    )


_DOCUMENT = "row long, {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "b int, base long, partners binary, docs binary, times binary"


def tokenised(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (``row`` set: their number, unique in the result) and of postings (``b`` set)."""
    kind = docs.select(F.col(key).alias("id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _shared(byte_model, piece_model)
        done = TaskContext.get().partitionId() * _BATCH
        for batch in batches:
            texts = batch.column(1)
            for chunk in flat.chunks(texts, TEXT):
                own = aligner.documents([t or "" for t in texts.slice(chunk.lo, chunk.n).to_pylist()])
                hashed = [hashlib.sha256(g[1].encode()).hexdigest() if g[1] else "" for g in own]
                numbers = _numbers(own)
                b, *lists = posted([g[2] for g in own], aligner.size_a)
                n, m = chunk.n, len(b)
                made = [pa.array(np.arange(done, done + n)), batch.column(0).slice(chunk.lo, n), *(pa.array(x, pa.int64()) for x in numbers), pa.array(hashed, pa.string())]
                fields = [pa.field(f"d{i}", c.type) for i, c in enumerate(made)]
                other = [pa.array(b.astype(np.int32)), pa.array(np.full(m, done)), *lists]
                fields += [pa.field(f"p{i}", c.type) for i, c in enumerate(other)]
                yield pa.record_batch([*made, *(pa.nulls(n, c.type) for c in other)], schema=pa.schema(fields))
                yield pa.record_batch([*(pa.nulls(m, c.type) for c in made), *other], schema=pa.schema(fields))
                done += n

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_DOCUMENT.format(id=f'id {kind}')}, {_POSTING}")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, n): how many links of the whole corpus hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            partners = [np.frombuffer(p, np.int32).reshape(-1, 2) for p in batch.column(1).to_pylist()]
            times = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).astype(np.int64)
            every = np.concatenate(partners) if partners else np.empty((0, 2), np.int32)
            b = np.repeat(batch.column(0).to_numpy(), [len(p) for p in partners])
            n = np.add.reduceat(times, np.cumsum(every[:, 1]) - every[:, 1]) if len(every) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(b, pa.int32()), pa.array(every[:, 0]), pa.array(n)], names=["b", "a", "n"])

    found = postings.select("b", "partners", "times").mapInArrow(run, "b int, a int, n long")
    return found.groupBy("b", "a").agg(F.sum("n").alias("n"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, part, counts before postings): what a token of B adds to each document that has it.

    A row a document and token, however the rows lie in batches and parts.
    """
    key, held, best = None, [], 0
    partner = amount = None
    for batch in batches:
        b, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        a, n, base = (batch.column(i).fill_null(-1).to_numpy() for i in (2, 3, 4))
        is_count = a >= 0
        edge = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (part[1:] != part[:-1]) | (is_count[1:] != is_count[:-1])])
        counts, highest = [], []
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
            if key != (b[lo], part[lo]):
                key, held, partner = (b[lo], part[lo]), [], None
            if is_count[lo]:
                held.append((a[lo:hi], n[lo:hi]))
                continue
            if partner is None:
                partner, amount = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.argsort(partner)
                partner, amount, best = partner[order], amount[order], amount.max()
            partners = np.frombuffer(b"".join(batch.column(5).slice(lo, hi - lo).to_pylist()), np.int32).reshape(-1, 2)
            counts.append(np.repeat(amount[np.searchsorted(partner, partners[:, 0])], partners[:, 1]))
            highest.append(counts[-1] == best)
        if not counts:
            continue
        docs = batch.column(6).drop_null().to_pylist()
        doc = np.frombuffer(b"".join(docs), np.uint16).astype(np.int64)
        times = np.frombuffer(b"".join(batch.column(7).drop_null().to_pylist()), np.uint8).astype(np.int64)
        posting = np.repeat(np.arange(len(docs)), [len(x) // 2 for x in docs])
        own, at = np.unique(posting << 16 | doc, return_inverse=True)
        row = base[~is_count][own >> 16] + (own & 0xFFFF)
        made = [
            np.bincount(at, weights=np.concatenate(highest) * times, minlength=len(own)).astype(np.int64),  # below 2**53: links of one document
            _sums(at, np.concatenate(counts) * times, len(own)),
        ]
        yield pa.record_batch([pa.array(row), *map(pa.array, made)], names=["row", "n_best", "count_sum"])


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact 64-bit sums of the values at each place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def align(docs: DataFrame, byte_model: str, piece_model: str, key: str = "doc_id", text: str = "text", part_postings: int = PART) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose pair's count is the highest of its token of B, ties included;
    ``count_sum``: the sum of the counts of its links.
    """
    every = cut(tokenised(docs, byte_model, piece_model, key, text))
    postings = every.where("b is not null").select("b", "base", "partners", "docs", "times")
    # At most a row a token of B, whatever the corpus.
    parts = postings.groupBy("b").agg(F.ceil(F.sum(F.octet_length("times")) / part_postings).cast("int").alias("parts"))
    parts = F.broadcast(parts)
    dealt = postings.join(parts, "b").select(
        "b", F.pmod(F.xxhash64("base"), "parts").cast("int").alias("part"), F.lit(None).cast("int").alias("a"),
        F.lit(None).cast("long").alias("n"), "base", "partners", "docs", "times",
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("base", "long"), ("partners", "binary"), ("docs", "binary"), ("times", "binary"))]
    counts = pair_counts(postings).join(parts, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", "n", *none)
    met = counts.unionByName(dealt).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").isNull())
    added = met.mapInArrow(_contributions, "row long, n_best long, count_sum long")
    added = added.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = every.where("row is not null").select("row", F.col("id").alias(key), *COUNTS, "groups_sha256")
    zero = F.lit(0).cast("long")
    return own.join(added, "row", "left").select(
        key, *COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
