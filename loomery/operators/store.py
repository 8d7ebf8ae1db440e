"""A namespaced item store as DataFrames: filters, namespaces, upserts, expiry and vector search.

An item table has ``namespace array<string>, key string, value string (JSON), created_at,
updated_at, expires_at timestamp, ttl_minutes double``.  Writes return a new table; the
caller writes it where the store lives.  Reads see the table as it was before a batch's
writes.  ``now`` is always a parameter.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import vectors

_KEY = re.compile(r"^[a-zA-Z0-9_.-]+$")
_RANGES = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


def _field(value: Column, path: str) -> Column:
    if not _KEY.match(path):
        raise ValueError(f"not a filter key: {path!r}")
    return F.get_json_object(value, "$." + path)


def _text(wanted) -> str:
    return wanted if isinstance(wanted, str) else json.dumps(wanted, separators=(",", ":"), ensure_ascii=False)


def _equal(value: Column, path: str, wanted) -> Column:
    found = _field(value, path)
    if wanted is None:
        return found.isNull()
    if isinstance(wanted, dict):
        parts = [_condition(value, f"{path}.{k}", v) for k, v in wanted.items()]
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(found.try_cast("double") == F.lit(float(wanted)), F.lit(False))
    return F.coalesce(found == F.lit(_text(wanted)), F.lit(False))


def _condition(value: Column, path: str, wanted) -> Column:
    if not (isinstance(wanted, dict) and any(k.startswith("$") for k in wanted)):
        return _equal(value, path, wanted)
    parts = []
    for op, other in wanted.items():
        if op == "$eq":
            parts.append(_equal(value, path, other))
        elif op == "$ne":
            parts.append(~_equal(value, path, other))
        elif op in _RANGES:
            number = _field(value, path).try_cast("double")
            parts.append(F.coalesce(_RANGES[op](number, F.lit(float(other))), F.lit(False)))
        else:
            raise ValueError(f"unsupported operator: {op}")
    return reduce(lambda a, b: a & b, parts)


def item_filter(spec: dict, value: Column | str = "value") -> Column:
    """All conditions of a filter; a missing key is null, and no range holds for it."""
    value = F.col(value) if isinstance(value, str) else value
    return reduce(lambda a, b: a & b, [_condition(value, k, v) for k, v in spec.items()], F.lit(True))


def contains(value: Column, wanted: dict, path: str = "") -> Column:
    """JSON containment: every leaf of ``wanted`` is there; list members may stand anywhere in the list."""
    parts = []
    for k, v in wanted.items():
        own = f"{path}.{k}" if path else k
        if isinstance(v, dict):
            parts.append(contains(value, v, own))
        elif isinstance(v, list):
            have = F.from_json(_field(value, own), "array<string>")
            parts += [F.coalesce(F.array_contains(have, _text(x)), F.lit(False)) for x in v]
        else:
            parts.append(_equal(value, own, v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def has_prefix(namespace: Column, prefix: tuple[str, ...]) -> Column:
    """Element-wise: ("a", "b") is no prefix of ("a", "bc")."""
    if not prefix:
        return F.lit(True)
    return F.slice(namespace, 1, len(prefix)) == F.array(*map(F.lit, prefix))


def matches(namespace: Column, parts: tuple[str, ...], suffix: bool = False) -> Column:
    """Prefix or suffix match with ``*`` for any one element."""
    out = F.size(namespace) >= len(parts)
    for i, p in enumerate(parts):
        if p != "*":
            at = i - len(parts) if suffix else i + 1
            out = out & F.coalesce(F.try_element_at(namespace, F.lit(at)) == p, F.lit(False))
    return out


def check_namespace(namespace: tuple[str, ...]) -> None:
    if not namespace or any(not p or "." in p for p in namespace):
        raise ValueError(f"namespace labels must be non-empty and without dots: {namespace}")


def get_items(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to requests (ord, namespace, key), absent ones with nulls; order by ``ord`` to show them."""
    return requests.join(items, ["namespace", "key"], "left")


def last_writes(batch: DataFrame) -> DataFrame:
    """Of several writes of a key in a batch (ord) the last."""
    latest = F.row_number().over(Window.partitionBy("namespace", "key").orderBy(F.desc("ord")))
    return batch.withColumn("_r", latest).where("_r = 1").drop("_r")


def upsert(items: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Apply writes (ord, namespace, key, value, ttl_minutes); a null value deletes.

    A written item keeps its ``created_at`` if it was there.
    """
    writes = last_writes(batch).select("namespace", "key", F.col("value").alias("v"), F.col("ttl_minutes").alias("m"), F.lit(True).alias("hit"))
    both = items.join(writes, ["namespace", "key"], "full_outer")
    hit = F.coalesce("hit", F.lit(False))
    ttl = F.when(hit, F.col("m")).otherwise(F.col("ttl_minutes"))
    return both.where(~hit | F.col("v").isNotNull()).select(
        "namespace", "key",
        F.when(hit, F.col("v")).otherwise(F.col("value")).alias("value"),
        F.coalesce("created_at", F.when(hit, now)).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, expiry(now, ttl)).otherwise(F.col("expires_at")).alias("expires_at"),
        ttl.alias("ttl_minutes"),
    )


def expiry(now: Column, minutes: Column) -> Column:
    """``now`` plus minutes; null without."""
    return F.when(minutes.isNotNull(), F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + (minutes * 60_000_000).cast("long")))


def sweep(items: DataFrame, now: Column) -> DataFrame:
    """Items that have not expired; until swept, expired items can be read."""
    return items.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def refresh(items: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Set the expiry of read items (namespace, key) anew from their ttl."""
    read = hits.select("namespace", "key").distinct().withColumn("_hit", F.lit(True))
    new = F.when(F.col("_hit") & F.col("ttl_minutes").isNotNull(), expiry(now, F.col("ttl_minutes"))).otherwise(F.col("expires_at"))
    return items.join(read, ["namespace", "key"], "left").withColumn("expires_at", new).drop("_hit")


def list_namespaces(
    items: DataFrame,
    prefix: tuple[str, ...] = (),
    suffix: tuple[str, ...] = (),
    max_depth: int | None = None,
) -> DataFrame:
    """Distinct namespaces that match, cut to ``max_depth``."""
    ns = F.col("namespace")
    rows = items.where(matches(ns, prefix) & matches(ns, suffix, suffix=True)).select("namespace")
    if max_depth is not None:
        rows = rows.select(F.slice("namespace", 1, max_depth).alias("namespace"))
    return rows.distinct()


def namespace_counts(items: DataFrame) -> DataFrame:
    """(prefix, n): for each prefix of a namespace how many distinct namespaces lie under it, itself included; by recursion in SQL."""
    query = """
      WITH RECURSIVE up(ns) MAX RECURSION LEVEL 1000 AS (
        SELECT DISTINCT namespace FROM {items} WHERE size(namespace) > 0
        UNION ALL SELECT slice(ns, 1, size(ns) - 1) FROM up WHERE size(ns) > 1
      ) SELECT ns AS prefix, count(*) AS n FROM up GROUP BY ns"""
    return items.sparkSession.sql(query, items=items)


def search(items: DataFrame, prefix: tuple[str, ...] = (), spec: dict | None = None, limit: int = 10, offset: int = 0, newest: bool = False) -> DataFrame:
    """A page of items under a prefix that pass a filter, by key or, with ``newest``, by last update."""
    rows = items.where(has_prefix(F.col("namespace"), prefix) & item_filter(spec or {}))
    order = [F.desc("updated_at")] if newest else []
    return rows.orderBy(*order, "namespace", "key").offset(offset).limit(limit)


def vector_search(
    items: DataFrame, embeddings: DataFrame, query: list[float], kind: str = "cosine",
    limit: int = 10, offset: int = 0, fill: bool = True,
) -> DataFrame:
    """A page of items by the best score of any of their vectors; items without vectors fill up at the end.

    ``embeddings``: namespace, key, path, embedding.  The maximum is taken before the limit,
    so an item with many vectors takes one place.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = embeddings.select("namespace", "key", vectors.similarity(kind, F.col("embedding"), asked).alias("score"))
    best = scored.groupBy("namespace", "key").agg(F.max("score").alias("score"))
    rows = items.join(best, ["namespace", "key"], "left" if fill else "inner")
    return rows.orderBy(F.desc_nulls_last("score"), "namespace", "key").offset(offset).limit(limit)


def two_stage_limit(rows: DataFrame, limit: int, estimate: int, item: str = "item", score: str = "score", tie: str = "path") -> DataFrame:
    """The best ``limit`` items by their best row, looked for among the best ``limit * estimate * 2 + 1`` rows.

    ``estimate`` is the rows an item has; items whose rows all rank below the first limit are not
    seen, as the limit says.  ``vector_search`` pools all rows instead.
    """
    first = rows.orderBy(F.desc(score), tie).limit(limit * estimate * 2 + 1)
    return first.groupBy(item).agg(F.max(score).alias(score)).orderBy(F.desc(score), item).limit(limit)


def cached_vectors(cache: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of ``asked`` (name, text): vectors (fingerprint, vector) are kept by the MD5 of name and text."""
    keyed = asked.withColumn("fingerprint", F.md5(F.concat_ws("|", "name", "text")))
    return keyed.join(cache, "fingerprint"), keyed.join(cache, "fingerprint", "left_anti")
