"""Change-log measures over an unbounded log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_churn(log: DataFrame, *, late: str = "1 day") -> DataFrame:
    """week, path, commits, authors (approximate) from a stream of (path, commit, author, ts); late rows beyond ``late`` are dropped by the watermark."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "path")
    return w.agg(F.count("commit").alias("commits"), F.approx_count_distinct("author").alias("authors")).select(F.col("w.start").alias("week"), "path", "commits", "authors")


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all weeks that are complete, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
