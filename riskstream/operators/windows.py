"""Window aggregation, on static tables and on streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_windows(events: DataFrame, seconds: int, slide: int | None = None, keys: Sequence[str] = (), watermark: int | None = None, ts: str = "event_ts"):
    """Events grouped by keys and epoch-aligned windows; late data is dropped only under a watermark, on streams."""
    if watermark is not None:
        events = events.withWatermark(ts, f"{watermark} seconds")
    own = F.window(ts, f"{seconds} seconds", f"{slide} seconds") if slide and slide != seconds else F.window(ts, f"{seconds} seconds")
    return events.groupBy(*keys, own.alias("w"))


def totals(events: DataFrame, seconds: int, slide: int | None = None, keys: Sequence[str] = (), watermark: int | None = None, ts: str = "event_ts", amount: str = "amount", id_col: str = "transaction_id") -> DataFrame:
    """Count, sum and average of the amount in each window."""
    out = in_windows(events, seconds, slide, keys, watermark, ts).agg(F.count(id_col).alias("tx_count"), F.sum(amount).alias("amount_sum"), F.avg(amount).alias("amount_avg"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tx_count", "amount_sum", "amount_avg")
