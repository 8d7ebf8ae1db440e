"""Personal data by patterns and a skip-chain conditional random field.

Patterns find what is personal data by its form alone (e-mail and IP addresses, card and
phone numbers).  A skip-chain CRF adds what is not: its nodes are the words of a document
that have a digit or ``@``, with features of their shape; words that stand next to each
other share a chain potential, and distant words that are equal or similar (the same
letters and digits, or the same last seven digits or more) share a skip potential.  A word
whose digits, seven or more, are the last ones of a card or phone number that a pattern found
is tied to that number itself by a potential of its own, so that a number written once in
full and again, however often, without its prefix gets one label.  A run that a pattern matched
and dropped as too long is looked at in parts: one that falls wholly into parts with a card's form (two
grouped numbers side by side) has a node a part, and the longest beginning of up to 15 digits of one that
begins like a phone number has a node, as the numbers found have one.  Loopy belief propagation
runs over each document's graph; words in a span found by a pattern are fixed.  Words that no
pattern labels and that are equal share one word's evidence between them: a number does not
become a card by being repeated.

The weights are fitted by pseudo-likelihood to the patterns' own labels (a word that is tied
to a labelled one, or is a part of a run that was dropped, but has no label counts as unknown) over at most ``sample`` documents that have a digit or ``@``, in the order of a
hash of their id; of rows with one id the one with the least text teaches, by its first ``nodes``
nodes.  Words with a skip partner teach a second time with their own shape and
neighbours hidden, so that the skip weight learns what a partner's label alone says.  What a
tie to a found number is worth is learned from the found numbers themselves, each written
again without its prefix.  Skip and tie potentials are one weight each, for equal labels.
The model has a few dozen weights, whatever the input.

Memory: the documents of a batch are propagated in groups of at most ``GROUP`` nodes (one
document of more is a group) and messages in blocks, so what a worker holds is about two
kilobytes a node of the longest document.

Defined results: a null or empty text has no spans; with nothing to learn from no spans
are added; repeated rows and null ids are kept; digit runs of any length are judged.  Spans
count code points, end exclusive.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.util import map_batches

KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1  # 0: none of them

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that cannot begin an address cannot from its middle either.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'<>[]{}"
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span the patterns find, sorted."""
    if not _NODE.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


FEATURES = 18
#: The feature of a card's form: 12 to 19 digits that pass the check.
CARD_FORM = 17
#: Nodes of documents that are propagated together.
GROUP = 20_000
_BLOCK = 50_000
_RUN_WORD = re.compile(r"[0-9-]+")


def card_form(word: str) -> bool:
    if not word[:1].isdigit() or not word[-1:].isdigit() or not _CARD.fullmatch(word):
        return False
    digits = "".join(_DIGITS.findall(word))
    return 12 <= len(digits) <= 19 and luhn(digits)


def shape(word: str) -> list[float]:
    digits = len(_DIGITS.findall(word))
    letters = sum(c.isalpha() for c in word)
    dots, dashes = word.count("."), word.count("-")
    return [
        1.0, "@" in word, digits == 0, 1 <= digits <= 2, 3 <= digits <= 4, 5 <= digits <= 8,
        9 <= digits <= 11, 12 <= digits <= 19, digits > 19, letters == 0, letters > digits,
        dots == 3 and letters == 0, 1 <= dots <= 2, dashes > 0, "(" in word or ")" in word,
        word[:1] == "+", "=" in word or "/" in word or ":" in word, 12 <= digits <= 19 and card_form(word),
    ]


def card_parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the words that a run of digits, spaces and dashes is cut into, each with a card's form; none if any is left over.

    Of several ways the one with the longest parts from the right counts.
    """
    words = [(m.start(), m.end()) for m in _RUN_WORD.finditer(run)]
    digits = [int(c) for c in run if c.isdigit()]
    # Sums of the check over any stretch, by whether its last digit stands at an even or odd place.
    sums = [[0], [0]]
    for place, d in enumerate(digits):
        for even, own in enumerate(sums):
            own.append(own[-1] + (d if place % 2 == even else 2 * d - 9 * (d > 4)))
    edge = [0]
    for a, b in words:
        edge.append(edge[-1] + len(_DIGITS.findall(run, a, b)))
    best: list[int | None] = [0] + [None] * len(words)
    last = 0
    for j in range(1, len(words) + 1):
        if j - last > 19:
            return []
        own = sums[(edge[j] - 1) % 2]
        for i in range(max(0, j - 19), j):
            if best[i] is not None and 12 <= edge[j] - edge[i] <= 19 and (own[edge[j]] - own[edge[i]]) % 10 == 0:
                best[j], last = i, j
                break
    parts, j = [], len(words)
    while j and best[j] is not None:
        parts.append((words[best[j]][0], words[j - 1][1]))
        j = best[j]
    return parts[::-1] if not j else []


def phone_part(run: str) -> int:
    """Where the longest beginning with the number of digits of a phone number ends, at a word's end; 0 if none has it."""
    digits, end = 0, 0
    for m in _WORD.finditer(run):
        digits += len(_DIGITS.findall(m[0]))
        if digits > 15:
            break
        if digits >= 9 and m[0][-1:].isdigit():
            end = m.end()
    return end


def runs_in_parts(text: str) -> dict[int, int]:
    """start -> end of the parts of several words in the runs that a pattern drops as too long."""
    out = {}
    for m in _CARD.finditer(text):
        if " " in m[0] and m.end() - m.start() > 20 and len(_DIGITS.findall(m[0])) > 19:
            out.update((m.start() + a, m.start() + b) for a, b in card_parts(m[0]) if " " in text[m.start() + a : m.start() + b])
    if "+" in text:
        for m in _PHONE.finditer(text):
            if len(_DIGITS.findall(m[0])) > 15 and " " in m[0][: (end := phone_part(m[0]))]:
                out[m.start()] = m.start() + end
    return out


@dataclass
class Graph:
    """The nodes of some documents and the edges between them (positions in these lists)."""

    features: list[list[float]] = field(default_factory=list)
    fixed: list[int] = field(default_factory=list)  # a label, or -1
    spans: list[tuple[int, int]] = field(default_factory=list)
    doc: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    repeat: list[tuple[int, int]] = field(default_factory=list)  # a word of a found number, a word that repeats it
    share: list[float] = field(default_factory=list)  # of its word's evidence, where that stands several times
    whole: set[int] = field(default_factory=set)  # nodes that are a number of their own, whatever stands beside them
    found: list[tuple[int, str]] = field(default_factory=list)  # the node and digits of each card or phone number found

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        known: dict[str, int] = {}
        numbers: dict[str, tuple[int, int, int]] = {}
        wholes: dict[tuple[int, int, int], str] = {}
        for span in base:
            if span[1] >= 2:  # cards and phones
                whole = wholes[span] = "".join(_DIGITS.findall(text[span[0] : span[2]]))
                for n in range(7, len(whole) + 1):
                    numbers.setdefault(whole[-n:], span)
        nodes: dict[tuple[int, int, int], int] = {}
        equal: dict[str, list[int]] = {}
        self.share += [1.0] * (len(self.features) - len(self.share))
        again: list[tuple[int, tuple[int, int, int]]] = []
        before, ahead, past = None, 0, 0
        parts = runs_in_parts(text) | {a: b for a, kind, b in base if kind >= 2 and " " in text[a:b]}
        for number, m in enumerate(_WORD.finditer(text)):
            word = m[0]
            if not _NODE.search(word):
                continue
            core = word.strip(_EDGE)
            if not core:
                continue
            start = m.start() + word.index(core)
            end = start + len(core)
            if start < past:  # in a part that is a node already
                before = (number, before[1])
                continue
            if start in parts:
                end = past = parts[start]
                core = text[start:end]
                self.whole.add(len(self.features))
            while ahead < len(base) and base[ahead][2] <= start and all(b[2] <= start for b in base[ahead : ahead + 4]):
                ahead += 1
            own = next((s for s in base[max(0, ahead - 4) : ahead + 8] if s[0] < end and s[2] > start), None)
            label = own[1] + 1 if own else -1
            node = len(self.features)
            self.features.append(shape(core))
            if self.features[node][CARD_FORM]:
                self.whole.add(node)
            self.fixed.append(label)
            self.spans.append((start, end))
            self.doc.append(doc)
            if before is not None and before[0] == number - 1:
                self.chain.append((before[1], node))
            before = (number, node)
            plain = "".join(c for c in core.lower() if c.isalnum() or c == "@")
            digits = "".join(_DIGITS.findall(core))
            keys = {f"w{plain}"} if len(plain) >= 4 else set()
            if len(digits) >= 7:
                keys.add(f"d{digits[-7:]}")
            for key in keys:
                # Each occurrence is tied to the one before it: linear in the occurrences.
                if key in known and (known[key], node) not in self.skip[-2:]:
                    self.skip.append((known[key], node))
                known[key] = node
            self.share.append(1.0)
            if own:
                if own in wholes and own not in nodes:
                    self.found.append((node, wholes[own]))
                nodes[own] = node
            else:
                equal.setdefault(plain, []).append(node)
                if digits in numbers:
                    again.append((node, numbers[digits]))
        self.repeat += [(nodes[span], node) for node, span in again if span in nodes]
        for group in equal.values():
            for node in group:
                self.share[node] = 1.0 / len(group)


@dataclass
class SkipChain:
    """``words``: label weights of features; ``chain``: left by right label; ``skip``: symmetric; ``repeat``: what a tie to a found number is worth."""

    words: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    repeat: float = 0.0

    @classmethod
    def blank(cls) -> SkipChain:
        return cls(np.zeros((FEATURES, _LABELS)), np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS)))

    def marginals(self, graph: Graph, rounds: int = 12, damp: float = 0.3) -> np.ndarray:
        """Each node's label probabilities by loopy belief propagation."""
        n = len(graph.features)
        fixed = np.array(graph.fixed)
        unary = np.array(graph.features, dtype=np.float64).reshape(n, FEATURES) @ self.words
        if graph.share:
            unary *= np.array(graph.share)[:, None]
        held = np.flatnonzero(fixed >= 0)
        unary[held] = -1e9  # whatever any number of neighbours say
        unary[held, fixed[held]] = 0.0
        chain = np.array(graph.chain, dtype=np.int64).reshape(-1, 2)
        far = np.array([*graph.skip, *graph.repeat], dtype=np.int64).reshape(-1, 2)
        c, s, k = len(chain), len(far), len(graph.skip)
        source = np.concatenate([chain[:, 0], chain[:, 1], far[:, 0], far[:, 1]])
        target = np.concatenate([chain[:, 1], chain[:, 0], far[:, 1], far[:, 0]])
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        potentials = np.stack([self.chain, self.chain.T, self.skip, self.repeat * np.eye(_LABELS)])
        of_far = np.repeat([2, 3], [k, s - k])
        kind = np.concatenate([np.repeat([0, 1], c), of_far, of_far])
        message = np.zeros((len(source), _LABELS))

        def belief() -> np.ndarray:
            sums = [np.bincount(target, weights=message[:, label], minlength=n) for label in range(_LABELS)]
            return unary + np.stack(sums, axis=1)

        for _ in range(rounds if len(source) else 0):
            total = belief()
            fresh = np.empty_like(message)
            for at in range(0, len(source), _BLOCK):
                own = slice(at, at + _BLOCK)
                sent = (total[source[own]] - message[back[own]])[:, :, None] + potentials[kind[own]]
                top = sent.max(axis=1)
                new = top + np.log(np.exp(sent - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                fresh[own] = damp * message[own] + (1 - damp) * new
            message = fresh
        out = belief()
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def fit(features: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300) -> SkipChain:
    """Weights by pseudo-likelihood: each node's label given its neighbours' labels; gradient ascent.

    A label of -1 is unknown: such a node neither teaches nor is seen by its neighbours.
    """
    model = SkipChain.blank()
    if not len(label):
        return model
    known = label >= 0
    one = np.eye(_LABELS)[np.maximum(label, 0)] * known[:, None]
    seen = [np.full_like(w, 1e-3) for w in (model.words, model.chain, model.skip)]
    before, after = np.zeros_like(one), np.zeros_like(one)  # counts of the neighbours' labels
    np.add.at(before, chain[:, 1], one[chain[:, 0]])
    np.add.at(after, chain[:, 0], one[chain[:, 1]])
    far = np.zeros_like(one)
    np.add.at(far, skip[:, 0], one[skip[:, 1]])
    np.add.at(far, skip[:, 1], one[skip[:, 0]])
    # Once more with only the partners to go by.
    tied = np.flatnonzero(known & far.any(axis=1))
    hidden = np.zeros((len(tied), features.shape[1]))
    hidden[:, 0] = 1.0
    features = np.concatenate([features, hidden])
    before, after = (np.concatenate([x, np.zeros((len(tied), _LABELS))]) for x in (before, after))
    far, one, known = (np.concatenate([x, x[tied]]) for x in (far, one, known))
    for _ in range(steps):
        score = features @ model.words + before @ model.chain + after @ model.chain.T + far @ model.skip
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        error = (one - p) * known[:, None] / max(1, known.sum())
        # One weight for agreement, whatever the label: a tie carries labels, it does not prefer any.
        skip_ = np.eye(_LABELS) * np.trace(far.T @ error) / _LABELS
        grads = (
            features.T @ error - 1e-4 * model.words,
            before.T @ error + error.T @ after - 1e-4 * model.chain,
            skip_ + skip_.T - 1e-4 * model.skip,
        )
        for w, g, s in zip((model.words, model.chain, model.skip), grads, seen):
            s += g * g
            w += 0.3 * g / np.sqrt(s)
    return model


def fit_repeat(model: SkipChain, features: np.ndarray, label: np.ndarray, steps: int = 300) -> float:
    """What a tie to a number of its own label is worth to words of these features; the other weights stay."""
    if not len(label):
        return 0.0
    own, tie, seen = features @ model.words, 0.0, 1e-3
    one = np.eye(_LABELS)[label]
    for _ in range(steps):
        score = own + tie * one
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = float((1 - (p * one).sum(axis=1)).mean()) - 1e-4 * tie
        seen += grad * grad
        tie += 0.3 * grad / np.sqrt(seen)
    return tie


def taught_repeats(graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the found numbers written again without their prefix: the last seven digits, and all but two."""
    features, labels = [], []
    for node, digits in graph.found:
        for again in {digits[-7:], digits[max(0, min(2, len(digits) - 7)) :]}:
            features.append(shape(again))
            labels.append(graph.fixed[node])
    return np.array(features, np.float32).reshape(-1, FEATURES), np.array(labels, np.int32)


def taught_labels(graph: Graph) -> np.ndarray:
    """The patterns' labels; 0 for other words, but -1 (unknown) for those tied to a labelled word and for parts of a run that was dropped."""
    fixed = np.array(graph.fixed, dtype=np.int32)
    out = np.maximum(fixed, 0)
    parts = np.array(sorted(graph.whole), dtype=np.int64)
    out[parts[fixed[parts] < 0]] = -1
    for a, b in graph.skip:
        for node, other in ((a, b), (b, a)):
            if fixed[node] < 0 <= fixed[other]:
                out[node] = -1
    for _, node in graph.repeat:
        out[node] = -1
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 1000, nodes: int = 500) -> SkipChain:
    """Fit to the patterns' labels of at most ``sample`` documents (ids not null), at most ``nodes`` nodes each."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where("id is not null").where(F.col("text").rlike("[0-9@]"))
    picked = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` ids, and one row an id before anything is collected.
    some = rows.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, columns = [], [[] for _ in names]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                graph = Graph()
                graph.add(0, t, base_spans(t))
                if graph.features:
                    ids.append(i)
                    graph.found = [(node, digits) for node, digits in graph.found if node < nodes]
                    edges = [np.array([e for e in own if max(e) < nodes], np.int32) for own in (graph.chain, graph.skip)]
                    label = taught_labels(graph)[:nodes]
                    for column, values in zip(columns, (np.array(graph.features[:nodes], np.float32), label, *edges, *taught_repeats(graph))):
                        column.append(values.tobytes())
            return pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["id", *names])

        return each

    names = ["features", "label", "chain", "skip", "again", "kind"]
    made = map_batches(some, make, "id long, " + ", ".join(f"{n} binary" for n in names))
    features, labels, chains, skips, again, kinds, n = [], [], [], [], [], [], 0
    for r in sorted(made.collect(), key=lambda r: r["id"]):
        features.append(np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES).astype(np.float64))
        labels.append(np.frombuffer(r["label"], np.int32))
        chains.append(np.frombuffer(r["chain"], np.int32).reshape(-1, 2) + n)
        skips.append(np.frombuffer(r["skip"], np.int32).reshape(-1, 2) + n)
        again.append(np.frombuffer(r["again"], np.float32).reshape(-1, FEATURES))
        kinds.append(np.frombuffer(r["kind"], np.int32))
        n += len(labels[-1])
    if not n:
        return SkipChain.blank()
    model = fit(np.concatenate(features), np.concatenate(labels), np.concatenate(chains), np.concatenate(skips))
    model.repeat = fit_repeat(model, np.concatenate(again).astype(np.float64), np.concatenate(kinds))
    return model


def added_spans(graph: Graph, model: SkipChain, least: float) -> dict[int, list[tuple[int, int, int]]]:
    """Per document the spans of free nodes whose best kind has a probability of ``least`` or more."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not graph.features or not model.words.any():
        return out
    p = model.marginals(graph)
    label = p.argmax(axis=1)
    free = (np.array(graph.fixed) < 0) & (label > 0) & (p.max(axis=1) >= least)
    joined = {b: a for a, b in graph.chain}
    for i in np.flatnonzero(free).tolist():
        own = out.setdefault(graph.doc[i], [])
        start, end = graph.spans[i]
        left = joined.get(i)
        # Neighbours of one kind are one span.
        if not {i, left} & graph.whole and left is not None and free[left] and label[left] == label[i] and own and own[-1][2] == graph.spans[left][1]:
            own[-1] = (own[-1][0], own[-1][1], end)
        else:
            own.append((start, int(label[i]) - 1, end))
    return out


def printed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind's tag."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: SkipChain, text: str = "text", extra: tuple[str, ...] = ("doc_id",), least: float = 0.9) -> DataFrame:
    """(*extra, n_email, n_ip, n_card, n_phone, base, spans, redacted) of every row's whole text.

    Counts and ``base`` are of the patterns' spans; ``spans`` has the added ones too;
    ``redacted`` is the text without any of them, null where the text is null.
    """
    fields = docs.select(*[f"`{c}`" for c in extra]).schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(0).to_pylist()
            found, more, graph = {}, {}, Graph()
            for i, t in enumerate(texts):
                if t and _NODE.search(t):
                    found[i] = base_spans(t)
                    graph.add(i, t, found[i])
                    if len(graph.features) >= GROUP:
                        more |= added_spans(graph, model, least)
                        graph = Graph()
            more |= added_spans(graph, model, least)
            counts = np.zeros((len(KINDS), len(texts)), dtype=np.int64)
            base, spans, clean = [""] * len(texts), [""] * len(texts), texts
            for i, own in found.items():
                for _, k, _end in own:
                    counts[k, i] += 1
                every = own + more.get(i, [])
                base[i], spans[i] = printed(own), printed(every)
                clean[i] = redacted(texts[i], every)
            made = [*map(pa.array, counts), *(pa.array(x, pa.string()) for x in (base, spans, clean))]
            return pa.record_batch([*batch.columns[1:], *made], names=[*names, *kinds, "b", "s", "r"])

        return each

    kinds = [f"n{k}" for k in range(len(KINDS))]
    rows = docs.select(F.col(text).cast("string").alias("t"), *[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, fields)])
    schema = ", ".join(
        [*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)), *(f"{k} long" for k in kinds), "b string, s string, r string"]
    )
    return map_batches(rows, make, schema).select(
        *[F.col(n).alias(f.name) for n, f in zip(names, fields)],
        *[F.col(k).alias(f"n_{kind}") for k, kind in zip(kinds, KINDS)],
        F.col("b").alias("base"), F.col("s").alias("spans"), F.col("r").alias("redacted"),
    )
