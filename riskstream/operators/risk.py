"""Alerts of all detectors, combined into graded risk by customer and window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.config import DEFAULT, Settings
from riskstream.functions import band, names_joined
from riskstream.operators.windows import in_windows


def united(*alerts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, alerts)


def risk(alerts: DataFrame, s: Settings = DEFAULT, watermark: int | None = None) -> DataFrame:
    """Points, number and types of a customer's alerts in each window, and the level they make; event_time is the window's start."""
    out = in_windows(alerts, s.risk_window, None, ["customer_id"], watermark).agg(
        F.sum("risk_points").alias("total_points"), F.count("alert_id").alias("alert_count"), names_joined(F.col("alert_type")).alias("alert_types")
    )
    start = F.col("w.start")
    return out.select("customer_id", start.alias("window_start"), F.col("w.end").alias("window_end"), "alert_count", "alert_types", "total_points", band(F.col("total_points"), s.levels).alias("risk_level"), start.alias("event_time"))
