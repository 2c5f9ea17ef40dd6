"""The access log as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def receipt(log: DataFrame, length: str = "14 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of each kind in sliding windows over (ts, kind, surfaced); rows over ``late`` are left out."""
    counts = log.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "kind").agg(F.count("*").alias("n"), F.count_if("surfaced").alias("surfaced"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kind", "n", "surfaced")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A node's accesses with no ``gap`` between: (node_id, start, end, n)."""
    counts = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "node_id").agg(F.count("*").alias("n"))
    return counts.select("node_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def acks(log: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(node_id, id, acked): for each edit (kind 'edit') of a node whether an ack (kind 'ack') came in the
    minutes before. The last ack of a node is its state, and is dropped once it is too old."""
    ttl = pd.Timedelta(minutes=minutes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for r in rows.itertuples():
            if r.kind == "ack":
                last = r.ts
            elif r.kind == "edit":
                out.append((key[0], r.id, bool(last is not None and r.ts - ttl <= last <= r.ts)))
        if last is not None:
            state.update((int(last.value // 1000),))
            now = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(now + 1, int((last + ttl).value // 1_000_000)))
        yield pd.DataFrame(out, columns=["node_id", "id", "acked"])

    marked = log.withWatermark("ts", late).select("node_id", "id", "ts", "kind")
    return marked.groupBy("node_id").applyInPandasWithState(run, "node_id long, id long, acked boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def incremental(source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each new batch of rows to ``apply`` with its number; a batch that fails is handed over again, as
    the offset moves on only after it."""
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
