"""Reads that arrive as a stream, classified by a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..options import QueryOptions
from ..plans.api import query
from ..sources.database import Index


def classify_stream(db: Index, reads: DataFrame, sink: Callable[[DataFrame, int], None], options: QueryOptions | None = None) -> DataStreamWriter:
    """A writer that classifies each micro-batch of a stream of reads (query_id, header, seq1, seq2, file) and hands it to the sink.

    All that a read needs is in its batch: a read is one row. The index stays as it was when the query began.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        sink(query(db, batch, options, store_reads=False).classified, epoch)

    return reads.writeStream.foreachBatch(step)
