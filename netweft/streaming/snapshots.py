"""Snapshots of a network from a stream of interactions, window by window."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_edges(events: DataFrame, window: str = "6 days", watermark: str = "1 day", ts: str = "ts", src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, src, dst, w) of tumbling windows; a window is final once the watermark has passed it, and later rows are dropped."""
    timed = events.where(F.col(src) != F.col(dst)).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (
        timed.groupBy(F.window(ts, window).alias("w"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .select(F.col("w.start").alias("start"), "src", "dst", F.col("n").alias("w"))
    )


def write_snapshots(edges: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends final snapshots to parquet, each once."""
    return edges.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
