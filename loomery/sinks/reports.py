"""Reports as Markdown texts: one a document of an annotated corpus, one a frame of a lexicon.

The texts are columns, put together of partial lists a document or frame; ``loomery.sources.cards`` writes
them, one file each.  Lists that a report cuts are ranked first, so that a frame with very many units
gathers no more than it shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much of a definition and how many units and relations a lexicon report shows.
DEFINITION, ELEMENT, UNITS, RELATIONS = 500, 300, 20, 15
VALUES = ("high", "medium", "low", "skip")
CONFIDENCES = ("high", "medium", "low", "none")
MARKS = {"high": "[+++]", "medium": "[++]", "low": "[+]", "none": "[-]"}


def _cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, cells)), F.lit(" |"))


def _head(*names: str) -> str:
    return "| " + " | ".join(names) + " |\n|" + "---|" * len(names)


def _lines(rows: DataFrame, by: str, order: list[str], line: Column, name: str, *others: Column) -> DataFrame:
    """(by, name): the lines of each group in order, joined; and what else is asked for."""
    listed = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["_line"]), "\n").alias(name), *others)


def _section(title: str, body: Column, head: str = "") -> Column:
    """A section, left out where its body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n" + (f"{head}\n" if head else "")), body))


def _text(title: Column, *sections: Column) -> Column:
    return F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), title), *sections), F.lit("\n"))


def annotation_reports(fragments: DataFrame, annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, report) for each document with fragments.

    ``fragments``: doc_id, fragment_id, value; ``annotations``: doc_id, fragment_id, place, word, frame,
    confidence; ``relations``: doc_id, source, target, kind, detail.
    """
    value = [F.count_if(F.col("value") == v).alias(f"_{v}") for v in VALUES]
    left = F.when(F.col("doc_id").isNotNull() & F.col("value").isin("low", "skip"), F.col("fragment_id"))
    skipped = F.array_join(F.sort_array(F.collect_list(left)), "\n").alias("_skipped")
    rows = fragments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_fragments"), skipped, *value)
    sure = [F.count_if(F.coalesce("confidence", F.lit("none")) == c).alias(f"_{c}_words") for c in CONFIDENCES]
    worth = F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.coalesce("confidence", F.lit("none"))), F.lit(len(CONFIDENCES)))
    frames = annotations.where("frame is not null").groupBy("doc_id", "frame").agg(
        F.array_join(F.sort_array(F.collect_set("word")), ", ").alias("words"), F.array_join(F.sort_array(F.collect_set("fragment_id")), ", ").alias("where"),
        F.min(worth).alias("best"),
    )
    mark = F.element_at(F.array(*[F.lit(f"{MARKS[c]} {c}") for c in CONFIDENCES]), F.col("best").cast("int"))
    index = _lines(frames, "doc_id", ["frame"], _line(F.col("frame"), F.col("words"), F.col("where"), mark), "_index")
    tied = _lines(relations, "doc_id", ["source", "target", "kind"], _line(*map(F.col, ("source", "target", "kind", "detail"))), "_tied")
    own = F.concat_ws(": ", "word", F.coalesce("frame", F.lit("-")))
    each = annotations.groupBy("doc_id", "fragment_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", own.alias("o")))), lambda x: x["o"]), "; ").alias("words"), *sure
    )
    line = F.concat(F.lit("- "), F.col("fragment_id"), F.lit(" "), F.col("words"))
    each = _lines(each, "doc_id", ["fragment_id"], line, "_each", *[F.sum(f"_{c}_words").alias(f"_{c}_words") for c in CONFIDENCES])
    for part in (index, tied, each):
        rows = rows.join(part, "doc_id", "left")
    figure = lambda label, column: F.concat(F.lit(f"| {label} | "), F.coalesce(column, F.lit(0)).cast("string"), F.lit(" |"))
    figures = [figure("fragments", "_fragments"), *(figure(f"{v} value", f"_{v}") for v in VALUES), *(figure(f"{c} confidence", f"_{c}_words") for c in CONFIDENCES)]
    report = _text(
        F.concat(F.lit("Annotation of "), F.col("doc_id").cast("string")),
        _section("Figures", F.concat_ws("\n", *figures), _head("What", "Number")),
        _section("Frames", F.col("_index"), _head("Frame", "Words", "Fragments", "Confidence")),
        _section("Relations", F.col("_tied"), _head("Source", "Target", "Kind", "Detail")),
        _section("Fragments", F.col("_each")), _section("Left out", F.replace("_skipped", F.lit("\n"), F.lit(", "))),
    )
    return rows.select("doc_id", report.alias("report"))


def _first(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group; Spark keeps a task's first ones before rows move."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def lexicon_reports(lexicon: dict[str, DataFrame]) -> DataFrame:
    """(frame, report) of a lexicon's tables (:data:`loomery.sources.files.LEXICON`): at most twenty units and fifteen relations each."""
    frames = lexicon["frames"].groupBy("frame").agg(F.min("definition").alias("definition"))
    about = F.concat(F.lit("- **"), F.col("fe"), F.lit("**: "), F.left(F.coalesce("definition", F.lit("")), F.lit(ELEMENT)))
    parts = []
    for kind in ("Core", "Peripheral", "Extra-Thematic"):
        own = lexicon["elements"].where(F.col("core") == kind).select("frame", "fe", "definition").distinct()
        parts.append((f"{kind} elements", f"_{kind[:4]}", _lines(own, "frame", ["fe"], about, f"_{kind[:4]}")))
    units = lexicon["units"].select("frame", F.concat_ws(".", "lemma", "pos").alias("unit")).distinct()
    units = _first(units, "frame", ["unit"], UNITS).groupBy("frame")
    listed = units.agg(F.array_join(F.transform(F.sort_array(F.collect_list("unit")), lambda u: F.concat(F.lit("`"), u, F.lit("`"))), ", ").alias("_unit"))
    parts.append((f"Units (first {UNITS})", "_unit", listed))
    both = lexicon["relations"].select(F.explode(F.array_distinct(F.array("sub", "super"))).alias("frame"), "type", "sub", "super", "ord")
    shown = F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.col("sub"), F.lit(" → "), F.col("super"))
    parts.append(("Relations", "_rela", _lines(_first(both, "frame", ["ord", "type", "sub", "super"], RELATIONS), "frame", ["ord", "type", "sub", "super"], shown, "_rela")))
    rows = frames
    for _, _, part in parts:
        rows = rows.join(part, "frame", "left")
    opening = F.left(F.trim(F.coalesce("definition", F.lit(""))), F.lit(DEFINITION))
    sections = [_section(title, F.coalesce(F.col(column), F.lit("(none)")) if title.startswith(("Core", "Per")) else F.col(column)) for title, column, _ in parts]
    return rows.select("frame", _text(F.col("frame"), F.when(opening != "", opening), *sections).alias("report"))


def unknown_frames(lexicon: dict[str, DataFrame]) -> DataFrame:
    """(part, frame, n): units, elements and relations of a lexicon that name a frame it does not have."""
    named = lexicon["relations"].select(F.explode(F.array("sub", "super")).alias("frame"))
    rows = [lexicon[p].select(F.lit(p).alias("part"), "frame") for p in ("units", "elements")] + [named.select(F.lit("relations").alias("part"), "frame")]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).where("frame is not null")
    return every.join(lexicon["frames"].select("frame").distinct(), "frame", "left_anti").groupBy("part", "frame").agg(F.count(F.lit(1)).alias("n"))
