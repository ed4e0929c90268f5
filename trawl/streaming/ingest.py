"""A stream of documents into an index: each micro-batch is one step of the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trawl.sources import store


def index_stream(stream: DataFrame, path: str, checkpoint: str, replace: bool = True, op: str | None = None, once: bool = False, merge_after: int = store.MERGE_AFTER) -> StreamingQuery:
    """Start a query that adds the stream's documents to the index at path, which must be there.

    With op, a column that says delete or anything else, rows of the first kind remove their key. A batch that comes again
    after a failure is recognised by its number. Once merge_after documents have come or gone the index is compacted.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        key = store.index_info(spark, path)["key"]
        added, deleted = batch, None
        if op is not None:
            deleted = batch.where(batch[op] == "delete").select(batch[key].cast("long").alias("doc_key"))
            added = batch.where(~batch[op].eqNullSafe("delete")).drop(op)
        if batch.isEmpty():
            return
        store.change(spark, path, added, deleted, replace=replace, epoch=epoch)
        if store.should_merge(spark, path, merge_after):
            store.compact(spark, path)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
