"""Streams of cells into an array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.array import Array


def write_stream(cells: DataFrame, array: Array, checkpoint: str, value: str = "value", **trigger) -> StreamingQuery:
    """Writes every micro-batch of cells (a column for each dimension, and a value) into the array.

    A batch overlays what is stored. One that is run again after a failure writes the same cells, so each takes effect
    once; of cells that repeat between batches the later batch stays.
    """
    handle, spec = array.handle, array.spec

    def write(batch: DataFrame, _: int) -> None:
        Array(handle, spec).write_cells(batch, value)

    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
