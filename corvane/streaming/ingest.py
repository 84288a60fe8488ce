"""Feeding a stored collection from a stream: a commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import CheckpointPolicy, Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, policy: CheckpointPolicy = CheckpointPolicy(), **trigger) -> StreamingQuery:
    """Inserts the rows (id, embedding, metadata) of a stream.

    A micro-batch that is delivered again, after a failure between its commit and the
    stream's own checkpoint, finds its ids taken: rows already there are left out.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        collection.refresh()
        fresh = batch.dropDuplicates(["id"]).join(collection.versions().select("id"), "id", "left_anti")
        collection.insert_many(fresh)
        if collection.should_checkpoint(policy):
            collection.checkpoint()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
