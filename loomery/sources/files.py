"""Sources: text trees, term lists, JSON bundles and card vaults, through Spark's own readers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.numbering import numbered


def text_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".txt", ".0", ""), skip: tuple[str, ...] = ("in.txt",)) -> DataFrame:
    """(doc_id, source, text) of every file below ``root`` with one of the extensions, in path order.

    Bytes that are no UTF-8 become replacement characters.  The numbering ranks paths only,
    not texts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    kept = files.withColumn("name", name).where(extension.isin(*extensions) & ~F.col("name").isin(*skip))
    ranked = numbered(kept.select("path"), "n", "path")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.join(ranked, "path").select(F.format_string("d%03d", "n").alias("doc_id"), F.col("path").alias("source"), text.alias("text"))


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): one a line, blank lines left out; of ``word|...`` and ``term|...`` lines the next part."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    parts = F.split("line", r"\|")
    term = F.when(F.col("line").rlike(r"^(word|term)\|"), parts[1]).otherwise(parts[0])
    return lines.select(F.trim(term).alias("term")).where("term <> ''").distinct()


def json_directory(spark: SparkSession, path: str) -> DataFrame:
    """(file, document): the JSON files of one directory as text."""
    rows = spark.read.text(f"{path}/*.json", wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("file"), F.col("value").alias("document"))


def registry(documents: DataFrame, field: str, schema: str) -> DataFrame:
    """The entries of a list field over all documents, one row each."""
    listed = F.from_json("document", f"{field} array<{schema}>")
    return documents.select(F.explode(listed[field]).alias("e")).select("e.*")


def vault(spark: SparkSession, root: str) -> DataFrame:
    """(stage, layer, artifact_id, content) of Markdown cards under ``stage/layer``."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.input_file_name()
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)\.md$", i)
    return rows.select(part(1).alias("stage"), part(2).alias("layer"), part(3).alias("artifact_id"), F.col("value").alias("content"))


def load_config(path: str, known: dict, environment: str = "LOOMERY_") -> dict:
    """A JSON configuration over defaults, with overrides from the environment; unknown keys raise."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown configuration keys: {sorted(unknown)}")
    out = {**known, **given}
    for key, default in known.items():
        if (value := os.environ.get(environment + key.upper())) is not None:
            out[key] = value if isinstance(default, str) else json.loads(value)
    return out


def stopwords(spark: SparkSession, path: str | None = None, built_in: tuple[str, ...] = (), environment: str = "LOOMERY_STOPWORDS") -> DataFrame:
    """(term): the built-in words and those of a list, whose path may also come from the environment."""
    rows = spark.createDataFrame([(w,) for w in built_in], "term string")
    if path := path or os.environ.get(environment):
        rows = rows.unionByName(term_list(spark, path))
    return rows.distinct()


def workspace(spark: SparkSession, root: str, extensions: tuple[str, ...], ignored: tuple[str, ...] = (), limit: int = 200) -> DataFrame:
    """(path, length) of at most ``limit`` files, the first by path, outside ignored directories; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    inside = F.substring_index("path", root.rstrip("/"), -1)
    kept = files.where(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*extensions))
    if ignored:
        kept = kept.where(~F.arrays_overlap(F.split(inside, "/"), F.array(*map(F.lit, ignored))))
    return kept.orderBy("path").limit(limit)


def bundle(spark: SparkSession, root: str, schemas: dict[str, str], required: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The list fields of all JSON files below ``root``, one table a field; a required one without a row raises."""
    documents = json_directory(spark, root)
    out = {field: registry(documents, field, schema) for field, schema in schemas.items()}
    if empty := [field for field in required if out[field].isEmpty()]:
        raise ValueError(f"nothing in the bundle for {empty}")
    return out


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str = "id") -> DataFrame:
    """(key): references to nothing; a warning, not an error."""
    refs = rows.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return refs.join(known.select(F.col(known_key).alias(key)), key, "left_anti")


# The tables of a lexicon and their columns.
LEXICON = {
    "frames": "frame string, definition string",
    "units": "lemma string, pos string, frame string",
    "elements": "frame string, fe string, core string, definition string",
    "relations": "type string, sub string, super string, ord int",
}


def lexicon(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """A lexicon's tables, each a folder or file of JSON lines below ``root``; other columns are left out."""
    return {name: spark.read.schema(schema).json(f"{root}/{name}.json") for name, schema in LEXICON.items()}
