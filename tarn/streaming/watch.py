"""Watching for changes: events gather until a root has been quiet for a while, then its index is updated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, quiet: str = "2 seconds", *, root: str = "root", path: str = "file_path", ts: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    """``root, start, end, n_events, paths``: sessions of events less than ``quiet`` apart.  Works on streams
    (a watermark of ``late``, whose late events are dropped) and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    out = rows.groupBy(F.session_window(ts, quiet).alias("w"), F.col(root).alias("root")).agg(F.count(F.lit(1)).alias("n_events"), F.collect_set(path).alias("paths"))
    return out.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", F.array_sort("paths").alias("paths"))


def settled(events: DataFrame, *, path: str = "file_path", change: str = "change", order: list[str] = ("ts",)) -> DataFrame:
    """The last change of each path: what is left to be done when several events name one file."""
    return events.groupBy(path).agg(F.max_by(change, F.struct(*order)).alias(change))


def watch(spark: SparkSession, directory: str, schema: str, reindex: Callable[[DataFrame, int], None], *, checkpoint: str, quiet: str = "2 seconds", trigger: str = "2 seconds") -> StreamingQuery:
    """Run ``reindex`` with the debounced changes of each micro-batch of event files in ``directory``."""
    events = spark.readStream.schema(schema).json(directory)
    return debounced(events, quiet).writeStream.outputMode("append").foreachBatch(reindex).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
