"""Measurements of whole documents, taken once for quality rules and classifiers."""

from __future__ import annotations

import numpy as np

from loomery.llm import flat

_SOLID = ~flat.SPACE
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL = _mask(b"#*$%&|<>")
_DIGIT = _mask(b"0123456789")
_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
_PUNCT = _mask(b".,;:!?")
_WIDE = _mask(bytes(range(0xC0, 0x100)))
_LINE = _mask(b"\n")

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_chars", "n_distinct_words", "n_digits", "n_upper", "n_letters", "n_punct", "n_wide", "max_word",
)


def _per_doc(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _own(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one document."""
    return flat.mix(hashed + (doc.astype(np.uint64) + np.uint64(1)) * flat.PLACES[59])


def _distinct(own: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if not len(own):
        return np.zeros(n, dtype=np.int64)
    order = np.argsort(own, kind="stable")
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = own[order][1:] != own[order][:-1]
    return np.bincount(doc[order[fresh]], minlength=n)


def measure(chunk: flat.Chunk) -> tuple[dict[str, np.ndarray], flat.Spans, np.ndarray]:
    """The measurements ``NAMES`` for each document, its words, and their exact-case hashes."""
    n, data, offsets = chunk.n, chunk.data, chunk.offsets
    spans = flat.words(chunk)
    sums = flat.running(chunk, False)
    hashed = flat.hashes(sums, spans.start, spans.end)
    out = {"n_words": spans.per_doc.astype(np.int64)}
    lead = _LEAD[data]
    out["n_chars"] = _per_doc(lead, offsets)
    out["word_chars"] = _per_doc(lead & _SOLID[data], offsets)
    for name, table in (
        ("n_symbols", _SYMBOL), ("n_digits", _DIGIT), ("n_upper", _UPPER),
        ("n_letters", _LETTER), ("n_punct", _PUNCT), ("n_wide", _WIDE),
    ):
        out[name] = _per_doc(table[data], offsets)

    own_lines = flat.words(chunk, _LINE)  # empty lines have no word and don't count
    solid = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SOLID[data], out=solid[1:])
    filled = np.flatnonzero(solid[own_lines.end] > solid[own_lines.start])
    line_doc = own_lines.doc[filled]
    line_hash = _own(flat.hashes(sums, own_lines.start[filled], own_lines.end[filled]), line_doc)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_hash, line_doc, n)

    own_words = _own(hashed, spans.doc)
    out["n_distinct_words"] = _distinct(own_words, spans.doc, n)
    window, at = flat.windows(hashed, spans, 3)
    repeated = np.zeros(len(hashed) + 1, dtype=np.int64)
    if len(window):
        own = _own(window, spans.doc[at])
        order = np.argsort(own, kind="stable")
        same = np.zeros(len(own), dtype=bool)
        equal = own[order][1:] == own[order][:-1]
        same[1:] |= equal
        same[:-1] |= equal
        twice = at[order[same]]
        np.add.at(repeated, twice, 1)
        np.subtract.at(repeated, twice + 3, 1)
    covered = np.cumsum(repeated[:-1]) > 0
    out["n_repeat_words"] = np.bincount(spans.doc[covered], minlength=n)
    out["max_word"] = np.zeros(n, dtype=np.int64)
    if len(spans.start):
        some = np.flatnonzero(spans.per_doc)
        out["max_word"][some] = np.maximum.reduceat(spans.end - spans.start, spans.first[some])
    return out, spans, hashed
