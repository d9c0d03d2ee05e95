"""Streams of rows into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeline.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Add each micro-batch of ``ext_id, embedding, metadata``. Rows without an id or with a wrong dimension are left out, of an id in a batch one row counts, and
    ids already stored are skipped, so a batch that runs again after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        d = batch.select("ext_id", "embedding", "metadata").where(F.col("ext_id").isNotNull() & (F.size("embedding") == collection.dimension)).dropDuplicates(["ext_id"])
        live = collection._live()
        if live is not None:
            d = d.join(live.select("ext_id"), "ext_id", "left_anti")
        d = d.persist()
        if not d.isEmpty():
            collection.add(d)
        d.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
