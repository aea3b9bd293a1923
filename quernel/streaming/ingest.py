"""Documents from a stream into a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import StorageProvider

#: Micro-batches that are kept as deltas before they are merged into the index.
COMPACT_EVERY = 20


def ingest(stream: DataFrame, provider: StorageProvider, name: str, checkpoint: str, update: bool = True, compact_every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Adds the documents of each micro-batch to the stored index ``name``.

    A batch costs what its own documents cost: it is appended as a delta, and only every
    ``compact_every`` deltas is the index written anew. With ``update`` a document replaces the
    fields of an earlier one; else the earlier one stays. Both make a batch that runs again after
    a failure harmless.
    """

    def batch(docs: DataFrame, _: int) -> None:
        if not docs.isEmpty() and provider.append(name, docs, update) >= compact_every:
            provider.compact(name)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
