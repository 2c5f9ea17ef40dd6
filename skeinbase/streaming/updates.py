"""The store kept up with a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.versions import Changes, Snapshot, Store


def follow(changes: DataFrame, apply: Callable[[DataFrame], None], rank: Callable[[], None], checkpoint: str, every: str = "4 seconds") -> StreamingQuery:
    """Applies each batch of the stream ``changes`` (file, deleted, at), then ranks anew, once a batch and not
    once a change. Of several changes of a file the latest counts. A batch that fails is not taken as
    done: its offsets stay, and it comes again."""

    def batch(df: DataFrame, _: int) -> None:
        latest = df.groupBy("file").agg(F.max_by("deleted", "at").alias("deleted"), F.max("at").alias("at"))
        if latest.isEmpty():
            return
        latest = latest.persist()
        try:
            apply(latest)
            rank()
        finally:
            latest.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def follow_into(store: Store, name: str, changes: DataFrame, apply: Callable[[Snapshot, DataFrame], Changes], checkpoint: str, every: str | None = "4 seconds") -> StreamingQuery:
    """Like :func:`follow`, but each batch is one version of ``store``: ``apply`` makes new tables of those of a version and the
    batch's changes. A batch that was committed just before the stream died is known by its number and not
    applied again; one that fails leaves the old version. Without ``every`` it ends when all that is there is done."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("file").agg(F.max_by("deleted", "at").alias("deleted"), F.max("at").alias("at")).persist()
        try:
            if not latest.isEmpty():
                store.batch(name, number, lambda base: apply(base, latest))
        finally:
            latest.unpersist()

    at = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**at).start()


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, old, new) of two heartbeats (key, value) that differ."""
    rows = before.select("key", F.col("value").alias("old")).join(after.select("key", F.col("value").alias("new")), "key", "full")
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))
