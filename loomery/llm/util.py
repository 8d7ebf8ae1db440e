"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomery.lineage import cut  # noqa: F401
from loomery.plans.common import table as read  # noqa: F401

#: Rows a worker takes at a time, whatever the session's Arrow batch size.
ROWS = 1024


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once a task and returns the batch function.

    Batches are cut to ``ROWS`` rows, so that what a worker holds stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield each(batch.slice(at, ROWS))

    return df.mapInArrow(run, schema)
