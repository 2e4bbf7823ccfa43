"""Access counters over a stream of traces (an extension: the batch form is operators.search.access_profile)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_counts(trace: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, id, touch) in tumbling windows of a (streaming) trace (id, ts); rows later than `late` are dropped from state."""
    own = trace.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), "id").agg(F.count("*").alias("touch"))
    return own.select(F.col("w.start").alias("start"), "id", "touch")
