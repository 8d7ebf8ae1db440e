"""Dense numbers in an order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.lineage import cut


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with a long column ``name``: 1, 2, ... in the order given.

    Rows are sorted into ranges; a row's number is its place in its range and the sizes of the
    ranges before, of which there is one row a range.
    """
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*rows.columns, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
