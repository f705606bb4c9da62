"""The stateless annotators as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def annotate_stream(docs: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Annotate each micro-batch of a streaming ``docs`` and append the hits to a Parquet table.

    Overlaps are resolved by document, and a document arrives in one micro-batch, so
    the result equals that of a batch run over the same documents. A batch that is run
    again after a failure rewrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
