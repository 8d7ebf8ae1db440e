"""Packing tokenised documents into sequences by best-fit decreasing.

A document's tokens are first cut into full windows; what remains is placed, longest
first, into the open window with the least capacity that still holds it, found by a
segment tree indexed by remaining capacity.

Only lengths decide, so the plan is made from the histogram of lengths (at most
``window`` numbers, whatever the input): pieces of one length go as a run into a run of
windows with one capacity, and the plan is a list of such runs.  Every piece then finds
its place from its length and its number among the pieces of that length; the numbers
are given in hashed parts of each length, as many as its count asks for, so no length is
one task.  The result is that of best-fit decreasing over all pieces at once.

The ids are those of the tokenizer as its file stands.  Texts of plain words are encoded unit
by unit through a second library with the same ranks; texts with one of the tokenizer's added
tokens, a zero character, or with unusual white space and a script whose classes differ
between regex libraries go to the tokenizer whole.

Defined results: a null or empty text is the end token alone; repeated rows are packed
each; an empty table gives no pieces.  Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.util import cut, map_batches

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class differs between regex libraries: texts with one are encoded whole.
_ODD = regex.compile(r"[\x1c-\x1f\x85]|[^\P{L}\p{Script=Latin}\p{Script=Greek}\p{Script=Cyrillic}\p{Script=Han}]")
#: White space that is no single space or line break between other characters.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_GAPS = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Byte-level BPE ids of texts; ids of units met before are remembered up to a bound.

    No token crosses from a word into the space or line break before the next one, so a text
    is cut there and each unit encoded on its own.  Texts with longer runs of white space or
    other white space are cut by the tokenizer's own pattern instead.
    """

    def __init__(self, path: str, remember: int = 600_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # The same vocabulary as ranks: a second library encodes a single unit in less time.
        plain = _byte_of_character()
        vocab = self.model.get_vocab(with_added_tokens=False)
        ranks = {bytes([plain[c] for c in piece]): i for piece, i in vocab.items() if all(c in plain for c in piece)}
        self.units = tiktoken.Encoding("units", pat_str=_WORDS.pattern, mergeable_ranks=ranks, special_tokens={})
        self.remember = remember
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, key: str) -> str:
        """A key is a unit without the space before it; 0 marks one that has none, as a line break does."""
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def _keys(self, text: str) -> list[str] | None:
        if any(t in text for t in self.added):
            return None
        if _GAPS.search(text) or "\0" in text or any(r in text for r in _RUNS):
            if _ODD.search(text) or "\0" in text:
                return None
            parts = _WORDS.findall(text)
            return [p[1:] if p[0] == " " and p[1:2] not in ("", "\n") else p if p[0] == "\n" else "\0" + p for p in parts]
        keys = text.replace("\n", " \n").split(" ")
        if keys[0]:
            keys[0] = "\0" + keys[0]
        else:
            del keys[0]
        if keys and not keys[-1]:
            keys[-1] = "\0 "
        return keys

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        keys = [self._keys(t) for t in texts]
        get = self.known.get
        found = [None if k is None else [get(x) for x in k] for k in keys]
        missing = {x for k, f in zip(keys, found) if k is not None and None in f for x, y in zip(k, f) if y is None}
        fresh = self._learn(missing)
        out = []
        for t, k, f in zip(texts, keys, found):
            if k is None:
                out.append(self.encode(t))
            elif None in f:
                out.append(b"".join([fresh[x] if y is None else y for x, y in zip(k, f)]))
            else:
                out.append(b"".join(f))
        return out

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """The ids of keys not known.  A word and the points behind it are apart for the tokenizer too."""
        known, fresh = self.known, {}
        split = {k: b for k in keys if k[-1:] in ".," and (b := k.rstrip(".,"))[-1:].isascii() and b[-1:].isalpha()}
        needed = (keys - split.keys()) | set(split.values()) | {"\0" + k[len(b) :] for k, b in split.items()}
        listed = [k for k in needed if k not in known]
        encode = self.units.encode_ordinary
        fresh.update((k, array("I", encode(self._unit(k))).tobytes()) for k in listed)
        for k, b in split.items():
            tail = "\0" + k[len(b) :]
            fresh[k] = (known.get(b) or fresh[b]) + (known.get(tail) or fresh[tail])
        if len(known) < self.remember:
            known.update((k, x) for k, x in fresh.items() if len(k) <= 40)
        return fresh


_models: dict[str, Tokens] = {}


def _shared(path: str) -> Tokens:
    if path not in _models:
        _models[path] = Tokens(path)
    return _models[path]


def tokenise(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: int = 0, window: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, crc, tokens (of the document), and its ids where asked for."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    tail = np.array([end], dtype="<u4").tobytes()
    step = 4 * window

    def make():
        tokens = _shared(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, starts, lengths, crcs, totals, bodies = [], [], [], [], [], []
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                for i, body in enumerate(tokens.ids(texts)):
                    body += tail
                    for lo in range(0, len(body), step):
                        own = body[lo : lo + step]
                        rows.append(at + i)
                        starts.append(lo // 4)
                        lengths.append(len(own) // 4)
                        crcs.append(zlib.crc32(own))
                        totals.append(len(body) // 4)
                        if keep_ids:
                            bodies.append(own)
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            names = ["id", "start", "length", "crc", "tokens"]
            if keep_ids:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("ids")
            return pa.record_batch(columns, names=names)

        return each

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, start long, length long, crc long, tokens long" + (", ids binary" if keep_ids else "")
    return map_batches(rows, make, schema)


class Capacities:
    """A segment tree over remaining capacity 0..size: how many windows are open at each."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += windows
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more with an open window."""
        node = self.leaves + least
        if self.tree[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return None
        while node < self.leaves:
            node *= 2
            if not self.tree[node]:
                node += 1
        return node - self.leaves


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first piece, pieces a window, first window, offset) that place every piece.

    Pieces of a length are numbered from 0.  Piece ``j`` belongs to the last run of its
    length whose first piece is not after it: to window ``first + (j - first piece) // each``
    at ``offset + (j - first piece) % each * length``.
    """
    open_ = Capacities(window)
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs, windows = [], 0

    def put(length: int, done: int, left: int, at: int, count: int, capacity: int) -> int:
        """Fill windows ``at`` .. of one capacity; returns how many pieces went in."""
        each = capacity // length
        full = min(count, left // each)
        for used, per in ((full, each), (int(full < count and left > full * each), left - full * each)):
            if used:
                runs.append((length, done, per, at, window - capacity))
                rest = capacity - per * length
                if rest:
                    ranges.setdefault(rest, []).append((at, used))
                    open_.add(rest, used)
                done, at = done + used * per, at + used
        return done

    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            capacity = open_.tightest(length)
            left = total - done
            if capacity is None:
                count = -(-left // (window // length))
                done = put(length, done, left, windows, count, window)
                windows += count
                continue
            at, count = ranges[capacity].pop()
            need = min(count, -(-left // (capacity // length)))
            if need < count:
                ranges[capacity].append((at + need, count - need))
            open_.add(capacity, -need)
            done = put(length, done, left, at, need, capacity)
    return runs


def pack(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: int = 0, window: int = 1024, part_rows: int = 100_000) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``part_rows``: about how many pieces of one length a task numbers.
    """
    whole = cut(tokenise(docs, model, key, text, end, window))
    histogram = {r[0]: r[1] for r in whole.groupBy("length").count().collect()}  # at most ``window`` rows
    parts = [(n, -(-rows // part_rows)) for n, rows in histogram.items()]
    parts = docs.sparkSession.createDataFrame(parts, "length long, parts long")
    # Rows without an id may all be alike; they are dealt by their place in the checkpointed table.
    mark = F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id", "start", "crc"))
    pieces = whole.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(parts), "length")
    pieces = pieces.withColumn("part", F.pmod(mark, F.col("parts"))).drop("row", "parts")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = cut(counts.withColumn("base", F.sum("rows").over(before) - F.col("rows")))
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *run in best_fit_decreasing(histogram, window):
        runs.setdefault(length, []).append(tuple(run))
    plan = docs.sparkSession.sparkContext.broadcast({n: np.array(r, dtype=np.int64) for n, r in runs.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        length, number = lengths.to_numpy(np.int64), numbers.to_numpy(np.int64)
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            run = plan.value[n]
            chosen = run[np.searchsorted(run[:, 0], number[own], side="right") - 1]
            ahead = number[own] - chosen[:, 0]
            sequence[own] = chosen[:, 2] + ahead // chosen[:, 1]
            offset[own] = chosen[:, 3] + ahead % chosen[:, 1] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    within = Window.partitionBy("length", "part").orderBy(F.col("id").asc_nulls_last(), "start", "crc", "tokens")
    # The window has dealt the pieces by length and part, so this join moves ``bases`` alone.
    numbered = pieces.withColumn("own", F.row_number().over(within)).join(bases.drop("rows"), ["length", "part"])
    placed = numbered.withColumn("at", place("length", F.col("base") + F.col("own") - 1))
    return placed.select(
        F.col("id").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        "at.sequence_id", "at.offset",
    )


def sequences(docs: DataFrame, placed: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: int = 0, window: int = 1024) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of ints, padded with ``end``), filled.

    Padded to ``window``, unless the filled length is a power of two.
    """
    pieces = tokenise(docs, model, key, text, end, window, keep_ids=True)
    places = placed.select(
        F.col(key).alias("id"), "start", "length", F.col("ids_crc32").alias("crc"), F.col("doc_tokens").alias("tokens"),
        "sequence_id", "offset",
    )
    # Pieces that are alike in all of these are numbered: each has one of their places, null ids too.
    alike = ["id", "start", "length", "crc", "tokens"]
    number = lambda *order: F.row_number().over(Window.partitionBy(*alike).orderBy(*order))
    pieces, places = pieces.withColumn("n", number("ids")), places.withColumn("n", number("sequence_id", "offset"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*alike, "n"]]
    joined = pieces.alias("a").join(places.alias("b"), same).select("sequence_id", "offset", "ids")
    rows = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    @F.pandas_udf("ids array<int>, filled long")
    def whole(parts: pd.Series) -> pd.DataFrame:
        ids, filled = [], []
        for own in parts:
            body = np.concatenate([np.frombuffer(p["ids"], dtype="<u4") for p in own]).astype(np.int32)
            n = len(body)
            filled.append(n)
            ids.append(body if n & (n - 1) == 0 else np.r_[body, np.full(window - n, end, np.int32)])
        return pd.DataFrame({"ids": ids, "filled": filled})

    return rows.select("sequence_id", whole("parts").alias("w")).select("sequence_id", "w.ids", "w.filled")
