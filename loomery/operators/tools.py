"""Tool selection under a token budget: relevance rules, linear scores, closures and a greedy knapsack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.lineage import cut

VETO = -500.0


def keyword_hits(context: Column, keywords: Column) -> Column:
    """How many keywords a context holds: whole words where a keyword's edge is a letter or digit."""

    def hit(k: Column) -> Column:
        before = F.when(F.left(k, F.lit(1)).rlike("[A-Za-z0-9_]"), F.lit(r"\b")).otherwise(F.lit(""))
        after = F.when(F.right(k, F.lit(1)).rlike("[A-Za-z0-9_]"), F.lit(r"\b")).otherwise(F.lit(""))
        return F.rlike(F.lower(context), F.concat(before, F.lit(r"\Q"), F.lower(k), F.lit(r"\E"), after))

    return F.size(F.filter(keywords, hit))


def rule_similarity(hits: Column, keywords: Column) -> Column:
    """0 without hits, 1 for a rule of one keyword, else 0.85 and up to 0.15 more by further hits."""
    n = F.size(keywords)
    more = F.least(F.lit(1.0), (hits - 1) / F.greatest(F.lit(1), n - 1))
    return F.when(hits <= 0, 0.0).when(n == 1, 1.0).otherwise(0.85 + 0.15 * more)


def blended(vector: Column, rule: Column, alpha: float = 0.7, strong: float = 0.85) -> Column:
    """A linear blend, or the larger of blend and rule where the rule is strong."""
    mixed = alpha * vector + (1 - alpha) * rule
    return F.when(rule >= strong, F.greatest(mixed, rule)).otherwise(mixed)


def linear_score(similarity: Column, recent: Column, enabled: Column, compliant: Column, tokens: Column) -> Column:
    """``2 sim + recent - 0.001 tokens``; -1000 if not compliant, -5000 more if disabled."""
    # The bonus of enabled tools and its offset cancel; disabled ones keep the penalty alone.
    state = F.when(enabled, F.lit(0.0)).otherwise(F.lit(5.0 * -1000.0))
    score = 2.0 * similarity + F.when(recent, 1.0).otherwise(0.0) + state - 0.001 * tokens.cast("double")
    return F.when(compliant, score).otherwise(F.lit(-1000.0))


def listed(tools: DataFrame, most: int = 60) -> DataFrame:
    """(name, description) of compliant tools, a longer description cut to ``most`` characters and dots."""
    text = F.coalesce("description", F.lit(""))
    short = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return tools.where(F.coalesce("compliant", F.lit(False))).select("name", short.alias("description"))


def raw_tools(selected: DataFrame, registry: DataFrame, by: str = "request_id") -> DataFrame:
    """(by, place, name, raw): the selected tools (by, ord, name) in their order as the registry (name, raw) has them; unknown ones are left out."""
    rows = selected.join(registry.groupBy("name").agg(F.first("raw").alias("raw")), "name")
    place = F.row_number().over(Window.partitionBy(by).orderBy("ord", "name"))
    return rows.select(by, place.alias("place"), "name", "raw")


def closure(tools: DataFrame, rounds: int = 40) -> DataFrame:
    """(name, member): every tool with all it depends on, itself included; unknown names are left out.

    Round k has the pairs nearer than 2^k steps and, marked as far, those exactly that far.  Only far ones are
    prolonged, by all that begin where they end, so that a pair is found by its shortest paths alone, not by every cut of every path.
    """
    names = tools.select("name")
    step = tools.select("name", F.explode("dependencies").alias("member"))
    step = step.join(names.withColumnRenamed("name", "member"), "member", "left_semi")
    nearest = lambda rows: rows.groupBy("name", "member").agg(F.min("far").alias("far"))
    own = names.select("name", F.col("name").alias("member"), F.lit(False).alias("far"))
    reach = cut(nearest(own.unionByName(step.select("name", "member", F.lit(True).alias("far")))))
    for _ in range(rounds):
        far = reach.where("far")
        if far.isEmpty():
            return reach.select("name", "member")
        further = far.alias("a").join(reach.alias("b"), F.col("a.member") == F.col("b.name")).select("a.name", "b.member", "b.far")
        # Doubled far pairs that are near by another way are near.
        reach = cut(nearest(reach.where("not far").unionByName(further)))
    raise RuntimeError("the closure did not settle")


def greedy_choice(bundles: Column, budget: Column) -> Column:
    """array<struct<name, tokens>>: what is taken of one request's bundles; a fold over its own array, so nothing leaves the JVM.

    ``bundles``: array<struct<name, score, members array<struct<name, score, tokens>>>>, in any order; see :func:`select_greedy`.
    """
    last = F.lit(float("nan"))  # a bundle without a score comes last
    ordered = F.array_sort(F.transform(bundles, lambda b: F.struct(F.coalesce(-b["score"], last).alias("rank"), b["name"].alias("name"), b["members"].alias("members"))))
    blank = F.struct(budget.cast("long").alias("room"), F.array().cast("array<struct<name:string,tokens:bigint>>").alias("taken"))

    def step(state: Column, bundle: Column) -> Column:
        has = lambda name: F.exists(state["taken"], lambda t: t["name"] == name)
        new = F.filter(bundle["members"], lambda m: ~has(m["name"]))
        cost = F.aggregate(new, F.lit(0).cast("long"), lambda total, m: total + m["tokens"].cast("long"))
        fits = ~has(bundle["name"]) & (cost <= state["room"]) & ~F.exists(new, lambda m: m["score"] <= VETO)
        more = F.transform(new, lambda m: F.struct(m["name"].alias("name"), m["tokens"].cast("long").alias("tokens")))
        return F.when(fits, F.struct((state["room"] - cost).alias("room"), F.concat(state["taken"], more).alias("taken"))).otherwise(state)

    return F.array_distinct(F.aggregate(ordered, blank, step)["taken"])


def select_greedy(candidates: DataFrame, budget: str = "token_budget") -> DataFrame:
    """Take bundles in score order while they fit; one that does not fit or has a vetoed member is passed over.

    ``candidates``: request_id, name, score, token_budget, members array<struct<name, score, tokens>>.
    The choice of one bundle depends on all before it, so a request's candidates, bounded by the tool
    registry, are gathered in one row.  Returns request_id, name, tokens.
    """
    rows = candidates.groupBy("request_id").agg(F.first(budget).alias("_budget"), F.collect_list(F.struct("name", "score", "members")).alias("_bundles"))
    return chosen(rows, "_bundles", "_budget")


def chosen(requests: DataFrame, bundles: str, budget: str = "token_budget") -> DataFrame:
    """:func:`select_greedy` of requests (request_id, budget) whose bundles are in their own row: nothing moves."""
    rows = requests.select("request_id", F.explode(greedy_choice(F.col(bundles), F.col(budget))).alias("t"))
    return rows.select("request_id", "t.name", "t.tokens")


def embed(texts: Column, function) -> Column:
    """A pluggable embedding function (list of texts -> list of vectors) as an Arrow-batched column."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(function(batch.tolist()))

    return run(texts)
