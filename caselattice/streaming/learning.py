"""Taught vectors as a stream: each micro-batch is added to the store's running sums."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def learn_stream(taught: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """taught: a stream of (label, v). Every batch counts once: the commit of the new sums holds the stream's identity and the batch's number, so a
    batch that comes again after a crash is known; several streams may add to one store at the same time. A stream is known by the id in
    its checkpoint. Empty batches change nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        if batch.limit(1).count():
            store.learn(batch, marks={stream: number})

    return taught.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
