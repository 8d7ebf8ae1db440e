"""Entities and frames: traversal, declarative candidates, inheritance, gaps and convergence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The higher, the sooner a candidate of the source wins.
PRIORITY = {"explicit": 100, "frame": 80, "entity": 60, "qualia": 40, "query": 20, "role": 20, "default": 10}


def targets(relations: Column, kind: str) -> Column:
    return F.transform(F.filter(relations, lambda r: r["type"] == kind), lambda r: r["target"])


def traverse(entities: DataFrame, kind: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(id, target) along one relation; targets must exist and be of the types, if any are named."""
    hops = entities.select("id", F.explode(targets(F.col("relations"), kind)).alias("target"))
    ends = entities.where(F.col("type").isin(*types)) if types else entities
    return hops.where("target is not null").join(ends.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target")


def with_inverse(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Edges (source, type, target) and, for types with an inverse, the turned edges."""
    names = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    turned = edges.where(F.col("type").isin(*inverse)).select(
        F.col("target").alias("source"), names[F.col("type")].alias("type"), F.col("source").alias("target")
    )
    return edges.select("source", "type", "target").unionByName(turned)


def inherit(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Elements (frame, fe, parent or null, overrides) with what they leave open taken from the parent's element."""
    own = [c for c in parents.columns if c not in ("frame", "fe")]
    above = parents.select(F.col("frame").alias("parent"), "fe", *[F.col(c).alias(f"_{c}") for c in own])
    joined = children.join(above, ["parent", "fe"], "left")
    return joined.select("frame", "fe", *[F.coalesce(c, f"_{c}").alias(c) for c in own])


def matching(rows: DataFrame, spec: dict[str, str], context: dict[str, str | None]) -> DataFrame:
    """Rows that meet ``{column: literal or "context.x"}``; a predicate whose context value is missing is skipped."""
    parts = []
    for column, wanted in spec.items():
        if wanted.startswith("context."):
            if (value := context.get(wanted.removeprefix("context."))) is None:
                continue
        else:
            value = wanted
        parts.append(F.col(column) == F.lit(value))
    return rows.where(reduce(lambda a, b: a & b, parts, F.lit(True)))


def named_candidates(rows: DataFrame, asked: DataFrame, source: str = "entity") -> DataFrame:
    """Rows asked for by their id (asked: id) as candidates: id, value, source."""
    return rows.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("value")).withColumn("source", F.lit(source))


def owned_candidates(rows: DataFrame, owners: DataFrame, owner: str = "belongs_to", source: str = "entity") -> DataFrame:
    """Rows of asked owners (owners: id) as candidates, each under its owner's id."""
    asked = owners.select(F.col("id").alias(owner)).distinct()
    return rows.join(asked, owner, "left_semi").select(F.col(owner).alias("id"), F.col("id").alias("value")).withColumn("source", F.lit(source))


def part_candidates(rows: DataFrame, field: str, part: str, source: str = "entity") -> DataFrame:
    """A part of each entry of a list of structs (``files``, ``path``) as candidates; entries without it give none."""
    values = rows.select("id", F.explode(field).alias("e")).select("id", F.col(f"e.{part}").alias("value"))
    return values.where("value is not null").withColumn("source", F.lit(source))


def apart_candidates(rows: DataFrame, parts: DataFrame, part: str, source: str = "entity") -> DataFrame:
    """:func:`part_candidates` where the entries (parts: id, part) are a table of their own: none are gathered into a row."""
    values = parts.where(F.col(part).isNotNull()).select("id", F.col(part).alias("value"))
    return rows.select("id").join(values, "id").select("id", "value").withColumn("source", F.lit(source))


def field_candidates(rows: DataFrame, field: str, source: str) -> DataFrame:
    """Values of a field (a list gives one row each, nulls none) as candidates (id, value, source)."""
    kind = rows.schema[field].dataType
    values = F.explode(F.col(field)) if kind.typeName() == "array" else F.col(field)
    return rows.select("id", values.alias("value")).where("value is not null").withColumn("source", F.lit(source))


def qualia_candidates(entities: DataFrame, role: str) -> DataFrame:
    return entities.select("id", F.explode(F.try_element_at("qualia", F.lit(role))).alias("value")).withColumn("source", F.lit("qualia"))


def first_candidate(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("fe").agg(F.min_by("value", "ord").alias("value"))


def argmax(candidates: DataFrame) -> DataFrame:
    """The candidate of each element whose source has the highest priority; the first on a tie."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    order = F.struct(-F.coalesce(F.try_element_at(rank, F.col("source")), F.lit(0)), F.col("ord"))
    best = candidates.groupBy("fe").agg(F.min_by(F.struct("source", "value"), order).alias("b"))
    return best.select("fe", "b.source", "b.value")


def gaps(bindings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Elements that are not filled, as hard, pending or peripheral gaps.

    ``bindings``: fe, core, required, status; ``candidates``: fe, one row each.
    """
    counts = candidates.groupBy("fe").agg(F.count(F.lit(1)).alias("n"))
    rows = bindings.where("status <> 'filled'").join(counts, "fe", "left")
    gap = F.when(~F.col("core"), "peripheral").when(F.col("required") & F.col("n").isNull(), "hard").otherwise("pending")
    return rows.select("fe", gap.alias("gap"), F.coalesce("n", F.lit(0)).alias("candidates"))


def saturated(bindings: DataFrame) -> DataFrame:
    """Per frame whether no required element is missing, and which are."""
    missing = F.col("required") & (F.col("status") == "missing")
    return bindings.groupBy("frame").agg(
        F.bool_and(~missing).alias("saturated"), F.array_sort(F.collect_list(F.when(missing, F.col("fe")))).alias("missing")
    )


def questions(found: DataFrame) -> DataFrame:
    return found.where("gap = 'hard'").select("fe", F.format_string("Which value has %s?", F.col("fe").cast("string")).alias("question"))


def with_answers(bindings: DataFrame, answers: DataFrame) -> DataFrame:
    """Apply answers (fe, answer) by key; null answers change nothing."""
    rows = bindings.join(answers.where("answer is not null"), "fe", "left")
    status = F.when(F.col("answer").isNotNull(), "filled").otherwise(F.col("status"))
    return rows.withColumn("value", F.coalesce("answer", "value")).withColumn("status", status).drop("answer")


def steps(bindings: DataFrame) -> DataFrame:
    """Filled required elements in order of frame and name, numbered inside each frame."""
    place = F.row_number().over(Window.partitionBy("frame").orderBy("fe"))
    return bindings.where("required and status = 'filled'").select("frame", "fe", "value", place.alias("step"))


def unmatched(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys on one side only."""
    one = left.join(right, key, "left_anti").select(key).distinct().withColumn("side", F.lit("left"))
    return one.unionByName(right.join(left, key, "left_anti").select(key).distinct().withColumn("side", F.lit("right")))


def checked_unique(rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows, failing while they are read if a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bad = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string"))))
    return rows.withColumn("_bad", bad).where(F.col("_bad").isNull()).drop("_bad")


def reference_candidates(bindings: DataFrame, rules: DataFrame, frames: DataFrame) -> DataFrame:
    """Candidates taken from another active frame: (frame, fe, value).

    ``bindings``: frame, fe, value; ``rules``: key ``frame.fe.frame_refs...``, ref_frame, ref_fe;
    ``frames``: frame, name.  The key is parsed once, so rules meet bindings by equality; the other
    frame's name is compared without regard to case.
    """
    refs = parsed_rules(rules, "frame_refs").select("frame", "fe", F.lower("ref_frame").alias("_name"), F.col("ref_fe").alias("_fe"))
    there = frames.select(F.lower("name").alias("_name"), F.col("frame").alias("_frame"))
    values = bindings.where("value is not null").select(F.col("frame").alias("_frame"), F.col("fe").alias("_fe"), "value")
    own = bindings.select("frame", "fe").join(refs, ["frame", "fe"])
    return own.join(there, "_name").join(values, ["_frame", "_fe"]).select("frame", "fe", "value")


def assumptions(elements: DataFrame) -> DataFrame:
    """``[frame.fe] text`` of every default assumption; those of an override stand in for the element's own.

    ``elements``: frame, fe, assumptions (array), override (array or null).
    """
    rows = elements.select("frame", "fe", F.posexplode(F.coalesce("override", "assumptions")).alias("place", "text"))
    return rows.select("frame", "fe", "place", F.concat(F.lit("["), "frame", F.lit("."), "fe", F.lit("] "), "text").alias("assumption"))


def escalation(bindings: DataFrame, found: DataFrame) -> DataFrame:
    """One JSON record a frame with its bindings and its gaps, in order of element."""
    own = bindings.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("fe", "value", "status"))).alias("bindings"))
    open_ = found.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("fe", "gap"))).alias("gaps"))
    return own.join(open_, "frame", "left").select("frame", F.to_json(F.struct("frame", "bindings", F.coalesce("gaps", F.array()).alias("gaps"))).alias("record"))


def derived_qualia(rules: DataFrame, context: DataFrame, elements: DataFrame, things: DataFrame) -> DataFrame:
    """Candidates (frame, fe, value) out of the qualia of entities that a rule's path names.

    ``rules``: frame, fe, kind, ref, role.  By kind, ``ref`` is a ``placeholder`` (``context``: name,
    id), an entity ``type``, or another ``element`` of the frame, whose value is an entity's id
    (``elements``: frame, fe, value).  ``things``: id, type, qualia map<string, array<string>>.
    """
    asked = rules.select("frame", "fe", "kind", "ref", "role")
    placed = asked.where("kind = 'placeholder'").join(context.select(F.col("name").alias("ref"), "id"), "ref")
    typed = asked.where("kind = 'type'").join(things.select(F.col("type").alias("ref"), "id"), "ref")
    beside = elements.where("value is not null").select("frame", F.col("fe").alias("ref"), F.col("value").alias("id"))
    other = asked.where("kind = 'element'").join(beside, ["frame", "ref"])
    named = [rows.select("frame", "fe", "role", "id") for rows in (placed, typed, other)]
    found = reduce(DataFrame.unionByName, named).join(things.select("id", "qualia"), "id")
    return found.select("frame", "fe", F.explode(F.try_element_at("qualia", F.col("role"))).alias("value"))


def activated(actions: DataFrame, roles: DataFrame, frames: DataFrame) -> DataFrame:
    """(request, frame, definition) of the frames that requested actions stand for: action to frame name to frame.

    ``actions``: request, action; ``roles``: action, name; ``frames``: frame, name, definition.
    """
    return actions.join(roles, "action").join(frames, "name").select("request", "frame", "definition")


def parsed_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Rules of one kind, their key ``frame.fe.kind...`` parsed once into frame and fe: prefixes become equalities."""
    parts = F.split("key", r"\.")
    mine = rules.where(F.startswith(F.get(parts, F.lit(2)), F.lit(kind)))
    return mine.select(F.get(parts, F.lit(0)).alias("frame"), F.get(parts, F.lit(1)).alias("fe"), *[c for c in rules.columns if c not in ("key", "frame", "fe")])
