"""Sinks: JSON and parquet tables, Markdown tables and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def write_cards(cards: DataFrame, path: str, mode: str = "append") -> None:
    """Cards (stage, layer, artifact_id, content), one directory a stage and layer."""
    cards.write.mode(mode).partitionBy("stage", "layer").parquet(path)


def escaped(value: Column) -> Column:
    return F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


def table_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as a Markdown table line, pipes escaped."""
    cells = [escaped(F.col(f"`{c}`")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_table(rows: DataFrame, title: str, note: str = "", limit: int = 200) -> str:
    """A report table of at most ``limit`` rows; give it rows in a total order."""
    head = [f"## {title}", *([f"> {note}", ""] if note else [""])]
    head += ["| " + " | ".join(rows.columns) + " |", "|" + " :--- |" * len(rows.columns)]
    return "\n".join(head + [r["value"] for r in table_rows(rows).limit(limit).collect()])


def front_matter(fields: list[str], body: Column) -> Column:
    """A card: JSON-quoted fields in order between rules, then the body."""
    quoted = [F.concat(F.lit(f"{f}: "), F.to_json(F.array(F.col(f).cast("string")))) for f in fields]
    lines = [F.regexp_replace(q, r": \[(.*)\]$", ": $1") for q in quoted]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)
