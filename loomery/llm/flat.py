"""Flat byte-level views of Arrow string batches.

The text operators work on the UTF-8 buffer Arrow already holds: words, lines and
hashes are found with numpy over the whole batch, not row by row.  A batch is cut
into chunks of whole documents of about ``CHUNK`` bytes, so memory stays bounded
whatever the batch holds (one document longer than that is a chunk of its own).

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never
occur inside a multi-byte UTF-8 character, so byte words equal code-point words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

U64 = np.uint64
_SEED = np.random.default_rng(0x5EED)
_TABLE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers that give each place of a window its own weight.
PLACES = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` mod 2**64 (kept, grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = U64(pow(base, filled, 1 << 64))
            out[filled : 2 * filled] = out[:filled] * step
            filled *= 2
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); bijective."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _salt(width: int) -> np.uint64:
    """Keeps windows of different widths apart."""
    return U64(int(PLACES[62]) * width % (1 << 64))


@dataclass
class Chunk:
    """Whole documents ``lo..hi`` of a batch: their bytes and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole rows; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield Chunk(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def begins(chunk: Chunk) -> np.ndarray:
    """True at each byte that begins a document (empty documents mark nothing of their own)."""
    first = np.zeros(len(chunk.data) + 1, dtype=bool)
    first[chunk.offsets] = True
    return first


@dataclass
class Spans:
    """Byte spans in a chunk; ``doc`` is the row in the chunk, ``per_doc`` counts them."""

    start: np.ndarray
    end: np.ndarray
    per_doc: np.ndarray
    doc: np.ndarray
    #: index of each document's first span
    first: np.ndarray


def _spans(start: np.ndarray, end: np.ndarray, chunk: Chunk) -> Spans:
    edge = np.searchsorted(start, chunk.offsets)
    per_doc = np.diff(edge)
    return Spans(start, end, per_doc, np.repeat(np.arange(chunk.n), per_doc), edge[:-1])


def words(chunk: Chunk, between: np.ndarray = SPACE) -> Spans:
    """Every word of every document: maximal runs of bytes that are not in the table ``between``."""
    if len(chunk.data) == 0:
        none = np.empty(0, np.int64)
        return _spans(none, none, chunk)
    solid = ~between[chunk.data]
    first = begins(chunk)
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return _spans(start, end, chunk)


def running(chunk: Chunk, fold: bool) -> np.ndarray:
    """Prefix sums from which :func:`hashes` takes the hash of any span."""
    n = len(chunk.data)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _TABLE)[chunk.data] * _power(_BASE, n), out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes wherever they stand."""
    raw = (sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * PLACES[63]))


def windows(hashed: np.ndarray, spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of ``width`` words inside one document.

    Returns (hash, index of the window's first word); documents with fewer words have none.
    """
    total = len(hashed) - width + 1
    if total <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(spans.doc[:total] == spans.doc[width - 1 :])
    out = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        out += hashed[k : k + total] * PLACES[k]
    return mix(out[at] + _salt(width)), at


def whole(hashed: np.ndarray, spans: Spans, docs: np.ndarray) -> np.ndarray:
    """One hash of the whole word sequence of each listed document (few words each)."""
    out = np.empty(len(docs), dtype=np.uint64)
    for i, d in enumerate(docs):
        own = hashed[spans.first[d] : spans.first[d] + spans.per_doc[d]]
        width = len(own)
        out[i] = mix((own * PLACES[:width]).sum(keepdims=True) + _salt(width))[0]
    return out


def shingle_sets(chunk: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set of distinct word shingles, as sorted 64-bit hashes.

    Returns (hashes of all documents one after the other, where each document begins).
    A document with 1 to ``width`` - 1 words has its whole sequence as one shingle;
    one without words has none.
    """
    spans = words(chunk)
    hashed = hashes(running(chunk, True), spans.start, spans.end)
    value, at = windows(hashed, spans, width)
    doc = spans.doc[at] if len(at) else np.empty(0, np.int64)
    short = np.flatnonzero((spans.per_doc > 0) & (spans.per_doc < width))
    if len(short):
        value = np.concatenate([value, whole(hashed, spans, short)])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    edge = np.searchsorted(doc, np.arange(chunk.n + 1))
    keep = np.zeros(len(value), dtype=bool)
    value = value.copy()
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi > lo:
            own = value[lo:hi]
            own.sort()
            keep[lo] = True
            np.not_equal(own[1:], own[:-1], out=keep[lo + 1 : hi])
    kept = np.zeros(len(value) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    return value[keep], kept[edge]
