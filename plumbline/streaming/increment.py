"""Layers 1 to 3 on the rows that a stream brings, batch by batch.

The checked rules look at one row at a time, so a batch is checked as a table
of its own; key rules need whole tables and are left to a full run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.model import Spec
from plumbline.run import check_conformance

ROW_LAYERS = (1, 2, 3)


def check_stream(stream: DataFrame, spec: Spec, table: str, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, *, available_now: bool = False, **options) -> StreamingQuery:
    """Check each micro-batch of a table; sink gets its results, its issues and the batch's number.

    A batch that is run again after a failure gets the same number, so a sink
    that replaces a batch's rows writes each once.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        stored = batch.persist()  # row identity must be that of one evaluation
        try:
            run = check_conformance(batch.sparkSession, spec, {table: stored}, layers=ROW_LAYERS, run_scope=f"batch {number}", **options)
            sink(run.results, run.issues, number)
            run.bound.work.release()
        finally:
            stored.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
