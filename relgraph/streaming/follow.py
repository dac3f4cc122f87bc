"""A follower of the change log: Structured Streaming hands over new revisions, the index applies them in order.

The cursor is stored with the index, in the same step as its rows, so the stream's own checkpoint only tells
when to look: a revision that comes again is skipped, and none is applied before the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

#: Revisions that one pass of `catchup` reads at a time.
BATCH = 100


def catchup(index) -> int:
    """Apply what the index hasn't seen; the number of revisions."""
    total = 0
    while True:
        after = index.cursor()
        rows = index.store.changes(after, BATCH).select("revision").distinct().orderBy("revision").collect()
        if not rows:
            return total
        for r in rows:
            index.apply_revision(r["revision"])
            total += 1


def follow(index, checkpoint: str, available_now: bool = False, interval: str = "5 seconds") -> StreamingQuery:
    """Keep the index up to date until the query is stopped; with `available_now`, end when all is applied."""

    def batch(changes: DataFrame, _: int) -> None:
        if not changes.isEmpty():
            catchup(index)

    writer = index.store.change_stream().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
