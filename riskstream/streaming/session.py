"""Session settings; used only where this library makes the session itself."""

from __future__ import annotations

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "riskstream", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive plans, no schema inference for streams, and state in RocksDB, which stateful processors need."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.schemaInference": "false", "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
