"""Streams into a store: late, repeated and reordered events give what one batch of all of them would give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.graphstore import GraphStore


def deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first of every event that comes again within ``delay`` of its time; the state of older ones is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def merge_batch(store: GraphStore, table: str, name: str, order: Column, compact: int = 8) -> Callable[[DataFrame, int], None]:
    """One version for every micro-batch, which names its epoch: one that was committed already is not stored again.

    ``order`` is a long that orders the values of a key, such as the event's time: it does not depend on when or with what an event
    came. A batch touches its own buckets only; those with ``compact`` segments are folded.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        tx = store.begin()
        if tx.base.marks.get(name, -1) >= epoch:
            return
        tx.append(table, batch, order)
        tx.compact(table, compact)
        tx.next.marks[name] = epoch
        tx.commit()

    return run


def stream_into(stream: DataFrame, store: GraphStore, table: str, name: str, order: Column, checkpoint: str, compact: int = 8) -> StreamingQuery:
    """Start a stream into a table; ``name`` tells streams into one store apart."""
    return stream.writeStream.foreachBatch(merge_batch(store, table, name, order, compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
