"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into units that no vocabulary piece crosses (a run of spaces and the word
behind it; a line break).  The units a task has not met yet are encoded together: their
symbols lie in one flat array, each round finds every unit's best pair (a segmented
minimum of pair ranks), merges it at its leftmost places at once, and compacts, until no
unit has a pair left.  Places are merged together only if none of the pairs this makes
ranks as well as the pair itself; else only the leftmost is, so that the result is that
of merging one by one.  A unit of more than ``_LONG`` characters (prose without spaces,
coded data) has rounds of its own, which look at the places of the best pair and their
neighbours only: its time grows with its merges, not with rounds times length.
A character outside the vocabulary falls back to its bytes.

The model is of the kind with identity normalisation, a dummy prefix and byte fallback;
others are refused.

Defined results: a null text is empty; an empty text has no pieces (only the end id where
one is asked for); repeated rows and null ids are kept.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.util import map_batches

SPACE = "▁"
_NONE = np.int64(1) << 40
_LONG = 2000
#: Symbols of characters that are no piece: this plus the code point.
_LOOSE = 1 << 22


class Pieces:
    """A vocabulary: pieces, their ranks, and the pairs that make them."""

    def __init__(self, path: str, remember: int = 300_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        loose = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(self.size)]
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        if len(self.bytes) != 256 or any("\n" in n for n in names) or any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("only models with byte fallback and no piece across spaces or lines are supported")
        if model.decode(model.encode("①  x")) != "①  x":
            raise ValueError("only models without normalisation are supported")
        self.end = model.eos_id()
        self.ids = {n: i for i, n in enumerate(names) if not loose[i]}
        self.text = [b"" if loose[i] else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        for byte, i in self.bytes.items():
            self.text[i] = bytes([byte])
        symbol = np.arange(0x110000, dtype=np.int64) + _LOOSE
        for n, i in self.ids.items():
            if len(n) == 1:
                symbol[ord(n)] = i
        self.symbol = symbol
        scores = np.array([model.get_score(i) for i in range(self.size)])
        rank = np.unique(-scores, return_inverse=True)[1]
        keys, ranks, made = [], [], []
        for n, i in self.ids.items():
            for cut in range(1, len(n)):
                left, right = self._part(n[:cut]), self._part(n[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank[i])
                    made.append(i)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.remember = remember
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _part(self, s: str) -> int | None:
        return int(self.symbol[ord(s)]) if len(s) == 1 else self.ids.get(s)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; the rank is _NONE where no piece is made."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def merge(self, units: list[str]) -> list[np.ndarray]:
        """The symbols of every unit after all merges."""
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.symbol[flat]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        done: list[np.ndarray] = [None] * len(units)

        def settle(symbols: np.ndarray, of: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for own, u in zip(np.split(symbols, starts[1:]), of[starts] if len(of) else []):
                done[u] = own

        while len(sym):
            same = unit[1:] == unit[:-1]
            rank, made = self._pairs(sym[:-1], sym[1:])
            rank[~same] = _NONE
            rank = np.r_[rank, _NONE]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(sym)])
            live = best < _NONE
            if not live.all():
                keep = np.repeat(live, length)
                settle(sym[~keep], unit[~keep])
                made = np.r_[made, 0][keep][:-1] if keep.any() else made[:0]
                sym, unit, rank = sym[keep], unit[keep], rank[keep]
                best, length = best[live], length[live]
                if not len(sym):
                    break
                starts = np.cumsum(length) - length
            place = np.flatnonzero(rank == np.repeat(best, length))
            # Of places that overlap, every second one from the left.
            fresh = np.r_[True, np.diff(place) > 1]
            run = np.cumsum(fresh) - 1
            place = place[(np.arange(len(place)) - np.flatnonzero(fresh)[run]) % 2 == 0]
            new = made[place]
            owner = unit[place]
            many = np.r_[False, owner[1:] == owner[:-1]]
            crowded = many | np.r_[many[1:], False]
            if crowded.any():
                place, new = self._leftmost(sym, unit, rank, place, new, owner, crowded)
            sym[place] = new
            keep = np.ones(len(sym), dtype=bool)
            keep[place + 1] = False
            sym, unit = sym[keep], unit[keep]
        return done

    def _leftmost(self, sym, unit, rank, place, new, owner, crowded):
        """Where units have several places, drop all but the first in those that may not merge together."""
        best = rank[place]
        after = np.minimum(place + 2, len(sym) - 1)
        inside = (place + 2 < len(sym)) & (unit[after] == owner)
        right, _ = self._pairs(new, sym[after])
        bad = inside & (right <= best)
        before = np.maximum(place - 1, 0)
        inside = (place > 0) & (unit[before] == owner)
        left = sym[before].copy()
        touching = np.r_[False, place[1:] - place[:-1] == 2]
        left[1:] = np.where(touching[1:], new[:-1], left[1:])
        made, _ = self._pairs(left, new)
        bad |= inside & (made <= best)
        unsafe = np.isin(owner, np.unique(owner[bad & crowded]))
        first = np.r_[True, owner[1:] != owner[:-1]]
        keep = ~unsafe | first
        return place[keep], new[keep]

    def merge_long(self, unit: str) -> np.ndarray:
        """The symbols of one unit after all merges; a round visits only the places of its pair."""
        sym = self.symbol[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, dtype=bool)
        rank, made = np.full(n, _NONE), np.zeros(n, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places and let them wait for their round."""
            rank[at] = _NONE
            at = at[after[at] < n]
            rank[at], made[at] = self._pairs(sym[at], sym[after[at]])
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(at) else []
            for r, places in zip(own[starts].tolist() if len(at) else [], np.split(at, starts[1:])):
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(places)

        look(np.arange(n))
        while heap:
            best = heapq.heappop(heap)
            listed = np.unique(np.concatenate(waiting.pop(best)))
            listed = listed[alive[listed] & (rank[listed] == best)]
            if not len(listed):
                continue
            fresh = np.r_[True, after[listed[:-1]] != listed[1:]]
            run = np.cumsum(fresh) - 1
            place = listed[(np.arange(len(listed)) - np.flatnonzero(fresh)[run]) % 2 == 0]
            new, second = made[place], after[place]
            third, first = after[second], before[place]
            left = sym[first]
            touching = third[:-1] == place[1:]
            left[1:] = np.where(touching, new[:-1], left[1:])
            right_rank, _ = self._pairs(new, sym[np.minimum(third, n - 1)])
            left_rank, _ = self._pairs(left, new)
            ahead = ((third < n) & (right_rank <= best)) | ((first >= 0) & (left_rank <= best))
            if ahead.any():  # what the first of these makes comes before the places behind it
                count = int(ahead.argmax()) + 1
                place, new, second, third = place[:count], new[:count], second[:count], third[:count]
            sym[place] = new
            alive[second] = False
            after[place] = third
            inside = third < n
            before[third[inside]] = place[inside]
            first = before[place]
            look(np.unique(np.r_[place, first[first >= 0]]))
            rest = listed[alive[listed] & (rank[listed] == best)]
            if len(rest):
                if best not in waiting:
                    heapq.heappush(heap, best)
                waiting.setdefault(best, []).append(rest)
        return sym[alive]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of every unit (spaces already marked)."""
        out = []
        short = iter(self.merge([u for u in units if len(u) <= _LONG]))
        for symbols in [self.merge_long(u) if len(u) > _LONG else next(short) for u in units]:
            if len(symbols) and symbols.max() < _LOOSE:
                out.append(symbols.tolist())
                continue
            ids = []
            for s in symbols.tolist():
                if s < _LOOSE:
                    ids.append(s)
                else:
                    ids += [self.bytes[b] for b in chr(s - _LOOSE).encode("utf-8", "replace")]
            out.append(ids)
        return out

    def units(self, text: str) -> list[str]:
        return _UNIT.findall((SPACE + text).replace(" ", SPACE)) if text else []

    def learn(self, units: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """(ids, the ids in decimal, the decoded bytes) of units; short ones are remembered while there is room."""
        new = list(units)
        fresh = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for u, ids in zip(part, self.encode_units(part)):
                fresh[u] = (len(ids), " ".join(map(str, ids)), b"".join([self.text[i] for i in ids]))
        if len(self.known) < self.remember:
            self.known.update((u, x) for u, x in fresh.items() if len(u) <= 40)
        return fresh

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_units(self.units(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return decoded(b"".join([self.text[i] for i in ids]))


def decoded(body: bytes) -> str:
    """The text of decoded bytes, without the dummy prefix."""
    return (body[1:] if body[:1] == b" " else body).decode("utf-8", "replace")


_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """(key, n_tokens, ids, decoded): each text's ids in decimal, joined by a space, and the text decoded from them.

    ``model`` is the vocabulary file's path, present on every executor.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def make():
        pieces = _shared(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, ids, back = [], [], []
            tail = [str(pieces.end)] if end else []
            parts = [pieces.units(t or "") for t in batch.column(1).to_pylist()]
            known = pieces.known
            fresh = pieces.learn({u for p in parts for u in p if u not in known})
            for p in parts:
                got = [known.get(u) or fresh[u] for u in p]
                count.append(sum([g[0] for g in got]) + len(tail))
                ids.append(" ".join([g[1] for g in got] + tail))
                back.append(decoded(b"".join([g[2] for g in got])))
            return pa.record_batch(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.large_string()).cast(pa.string()), pa.array(back, pa.string())],
                names=["id", "n", "ids", "decoded"],
            )

        return each

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    made = map_batches(rows, make, f"id {kind}, n long, ids string, decoded string")
    return made.select(F.col("id").alias(key), F.col("n").alias("n_tokens"), "ids", "decoded")


_models: dict[str, Pieces] = {}


def _shared(path: str) -> Pieces:
    """One vocabulary a worker process, kept between tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]

