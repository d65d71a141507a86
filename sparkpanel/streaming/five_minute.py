"""The five-minute bars as a Structured Streaming aggregation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.intraday import bucket_bars, in_session, with_bucket


def stream_five_minute_bars(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Same bars from a stream of minute bars.

    The watermark bounds how late a bar may arrive.  The event-time window is part of
    the grouping key, so that closed buckets leave the state and append mode works; it
    coincides with the bucket because the session anchor is a multiple of five minutes.
    """
    keyed = with_bucket(in_session(bars.withWatermark("timestamp", delay)))
    window = F.window("timestamp", "5 minutes").alias("window")
    return bucket_bars(keyed, extra_keys=[window])
