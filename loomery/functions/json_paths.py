"""Text at JSON paths, and JSON found in loose text.

Paths have fields (``a.b``), indices (``[0]``, ``[-1]``, ``[*]``), the wildcard ``*`` and
field sets (``{a,b.c}``).  A document is parsed once (:func:`parsed`) and any number of paths read from
it inside the JVM (:func:`texts`); :func:`at_path` gives the texts as Python prints them (``True``, spaced
JSON with sorted keys) and walks the trees in Arrow batches, as healing loose text does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\[[^\[\]]*\]?|\{[^{}]*\}?|[^.\[{]+")


def tokens(path: str) -> list[str]:
    return _TOKEN.findall(path)


def _shown(value) -> list[str]:
    if value is None:
        return []
    if isinstance(value, (dict, list)):
        return [json.dumps(value, sort_keys=True, ensure_ascii=False)]
    return [str(value)]


def _children(value, token: str) -> list:
    if token == "*":
        return list(value.values()) if isinstance(value, dict) else list(value) if isinstance(value, list) else []
    if token[0] == "[":
        if not isinstance(value, list) or token[-1] != "]":
            return []
        if token == "[*]":
            return value
        place = re.fullmatch(r"\[\s*(-?\d+)\s*\]", token)
        return value[int(place[1]) :][:1] if place and -len(value) <= int(place[1]) < 0 else value[int(place[1]) : int(place[1]) + 1] if place and int(place[1]) >= 0 else []
    return [value[token]] if isinstance(value, dict) and token in value else []


def _field(value, path: str):
    for name in tokens(path):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def texts_at(value, path: str) -> list[str]:
    if not path or path == "$":
        return _shown(value) or ["null"]
    level = [value]
    parts = tokens(path)
    for token in parts:
        if token[0] == "{":
            if token[-1] != "}":
                return []
            names = [n.strip() for n in token[1:-1].split(",")]
            return [t for v in level if isinstance(v, dict) for n in names for t in _shown(_field(v, n))]
        level = [c for v in level for c in _children(v, token)]
    return [t for v in level for t in _shown(v)]


def parsed(document: Column) -> Column:
    """A JSON column as a variant, parsed once for all paths; null where it is no JSON."""
    return F.try_parse_json(document)


def _named(variant: Column, name: str) -> Column:
    """A field of a variant, null if there is none."""
    if re.fullmatch(r"[^'?]+", name):
        return F.try_variant_get(variant, f"$['{name}']", "variant")
    return F.try_element_at(F.try_variant_get(variant, "$", "map<string,variant>"), F.lit(name))


def _below(level: Column, token: str) -> Column:
    """The variants one token further, of an array of variants."""
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    if token == "*":
        fields = lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        return F.flatten(F.transform(level, lambda v: F.coalesce(fields(v), listed(v))))
    if token == "[*]":
        return F.flatten(F.transform(level, listed))
    if token[0] == "[":
        place = re.fullmatch(r"\[\s*(-?\d+)\s*\]", token)
        if not place:
            return F.array().cast("array<variant>")
        at = int(place[1])
        return F.array_compact(F.transform(level, lambda v: F.try_element_at(listed(v), F.lit(at if at < 0 else at + 1))))
    return F.array_compact(F.transform(level, lambda v: _named(v, token)))


def _fields(paths: list[list[str]]) -> Callable[[Column], Column]:
    """What a variant has at some paths of fields, in their order."""
    def found(v: Column) -> Column:
        ends = [reduce(_named, parts, v) for parts in paths]
        return F.array_compact(F.array(*ends))

    return found


def texts(variant: Column, path: str) -> Column:
    """The texts (array) a parsed column has at a path: strings as they are, others as compact JSON, nulls left out.

    A wildcard gives the fields of an object in the order of their names.
    """
    level = F.array_compact(F.array(variant))
    if path and path != "$":
        for token in tokens(path):
            if token[0] == "{":
                if token[-1] != "}":
                    return F.array().cast("array<string>")
                level = F.flatten(F.transform(level, _fields([tokens(n.strip()) for n in token[1:-1].split(",")])))
                break
            level = _below(level, token)
    return F.array_compact(F.transform(level, lambda v: F.try_variant_get(v, "$", "string")))


def at_path(document: Column, path: str) -> Column:
    """The texts (array) a JSON column has at a path; none if it is no JSON."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                try:
                    out.append([] if text is None else texts_at(json.loads(text), path))
                except ValueError:
                    out.append([])
            yield pd.Series(out)

    return run(document)


def first_object(text: str | None) -> str | None:
    """The first complete JSON object in loose text, straight or in a code fence, as compact JSON."""
    if text is None:
        return None
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def healed(document: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(first_object)

    return run(document)
