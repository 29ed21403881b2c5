"""Gap sessions of a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(messages: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes", late: str = "1 hour", min_size: int = 20) -> DataFrame:
    """Closed sessions of at least ``min_size`` messages; appended once the watermark has passed them."""
    found = messages.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= min_size).select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
