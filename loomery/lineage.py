"""Cutting lineage through a folder that every executor can read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a folder of our own only in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "loomery-checkpoints")


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` behind a reliable checkpoint, so that a lost executor costs one step at most."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once to a table of their own in the shared folder and read back, for tables as large as their input.

    Columns are compressed, where a checkpoint is not, branches read only the columns and rows they ask for, and
    Spark knows the table's size when it plans a join.
    """
    path = f"{shared_folder(rows.sparkSession)}/loomery-stored-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
