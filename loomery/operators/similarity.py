"""Pairs of similar sets: a self-join under a Jaccard bound, by prefixes of rare tokens.

Equal sets are one class first.  A class's tokens stand in one order for all, the rarest first.  Two sets of a
similarity of ``least`` or more share a token among the first ``n - ceil(least * n) + 1`` of each, so only these prefixes meet:
frequent tokens stand last and are hardly ever in one.  Classes that meet must also be near in size, and the places
where they meet must leave room for enough common tokens; what is left is verified on the whole sets.

Defined results: null and empty sets have no pairs; repeated tokens count once; of rows with one
id and set one counts; equal sets of different ids are pairs of similarity 1 between members of a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tokens_in_order(sets: DataFrame) -> DataFrame:
    """(rep, n, tokens) with the tokens as numbers of their frequency's rank, the rarest first."""
    each = sets.select("rep", F.explode("set").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    # A token's place in the order is its frequency, then itself: no global numbering is needed.
    placed = each.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("own"))
    return placed.select("rep", F.size("own").alias("n"), F.transform("own", lambda x: x["token"]).alias("tokens"))


def classes(rows: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """(id, rep): each id with the smallest id of its set."""
    sets = rows.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("set")).where("size(set) > 0")
    reps = sets.groupBy("set").agg(F.min("id").alias("rep"))
    return sets.join(reps, "set").select("id", "rep", "set").distinct()


def _least_common(a: Column, b: Column, least: float) -> Column:
    """How many tokens sets of these sizes must share for a similarity of ``least``."""
    return F.ceil(F.lit(least) / (1 + least) * (a + b) - 1e-9)


def similar_classes(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of classes (rep, set), a < b."""
    own = _tokens_in_order(sets)
    kept = (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int")
    prefix = own.select("rep", "n", F.posexplode(F.slice("tokens", F.lit(1), kept)).alias("at", "token"))
    a = prefix.select("token", *[F.col(c).alias(f"a_{c}") for c in ("rep", "n", "at")])
    b = prefix.select("token", *[F.col(c).alias(f"b_{c}") for c in ("rep", "n", "at")])
    met = a.join(b, "token").where("a_rep < b_rep").where((F.col("a_n") >= least * F.col("b_n") - 1e-9) & (F.col("b_n") >= least * F.col("a_n") - 1e-9))
    # Common tokens stand in the same order in both: no more before this one, and behind it, than the shorter stretch has.
    most = F.least("a_at", "b_at") + 1 + F.least(F.col("a_n") - F.col("a_at") - 1, F.col("b_n") - F.col("b_at") - 1)
    enough = most >= _least_common(F.col("a_n"), F.col("b_n"), least)
    pairs = met.where(enough).select("a_rep", "b_rep").distinct()
    x = sets.select(F.col("rep").alias("a_rep"), F.col("set").alias("x"))
    y = sets.select(F.col("rep").alias("b_rep"), F.col("set").alias("y"))
    full = pairs.join(x, "a_rep").join(y, "b_rep").withColumn("c", F.size(F.array_intersect("x", "y")))
    score = F.col("c") / (F.size("x") + F.size("y") - F.col("c"))
    return full.withColumn("similarity", score).where(score >= least - 1e-9).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), "similarity")


def similar_sets(rows: DataFrame, least: float, key: str = "id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each id with its class's smallest id, and the similar pairs of these (a, b, similarity), a < b."""
    if not 0 < least <= 1:
        raise ValueError("the bound is a share above 0")
    members = classes(rows, key, tokens)
    one = members.where(F.col("id") == F.col("rep")).select("rep", "set").distinct()
    return members.select("id", "rep"), similar_classes(one, least)


def overlapping_sets(rows: DataFrame, key: str = "id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """:func:`similar_sets` without a bound: (members, pairs) of all classes that share a token, however weakly.

    Every such pair is asked for, so the result itself grows with the classes a token has; copies are one class first.
    """
    members = classes(rows, key, tokens)
    one = members.where(F.col("id") == F.col("rep")).select("rep", "set").distinct()
    each = one.select("rep", F.size("set").alias("n"), F.explode("set").alias("token"))
    a = each.select("token", F.col("rep").alias("a"), F.col("n").alias("na"))
    b = each.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"))
    common = a.join(b, "token").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return members.select("id", "rep"), common.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))


def joined_classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, links): how many other ids each id is similar to, counted by class: pairs of members are never listed."""
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    far = both.join(size.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("far"))
    links = size.join(far, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return members.join(links, "rep").select("id", "rep", "links")


def top_similar(members: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """(rep, other, similarity, place): the most similar classes of each class."""
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other"), "similarity"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "other"))
    return both.withColumn("place", place).where(F.col("place") <= limit)
