"""The search over a stream of reads.

A read's result depends on that read alone, so each micro-batch is searched as a
whole (a stream-static join) and no state is kept between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.params import SearchParams
from ..operators.search import search


def search_stream(reads: DataFrame, refs: DataFrame, output: str, checkpoint: str, params: SearchParams = SearchParams(), seeds: DataFrame | None = None, words: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Start a query that writes each batch's report below ``output``; a batch that
    is run again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        _, report = search(batch, refs, params, seeds, words)
        report.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
