"""Sources, static and streaming, all with explicit schemas.

A keyed source gives (key binary, value binary): from a broker where its connector is
on the classpath, else from files dropped into a folder, one record for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskstream.operators.parse import flattened
from riskstream.schemas import EVENTS, LABELS


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object for each line; a kind's name stands for its schema."""
    return spark.read.schema(EVENTS[schema] if isinstance(schema, str) else schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels by event_id under the names of the unified envelope, and the type of event that each is for."""
    raw = spark.read.schema(LABELS).json(path)
    return renamed_labels(raw, "event_type")


def renamed_labels(raw: DataFrame, *more: str) -> DataFrame:
    return raw.select("event_id", *more, F.col("scenario").alias("fraud_scenario"), "alert_type", "risk_points", F.col("label").alias("fraud_label"))


def lines(spark: SparkSession, path: str, header: bool = False) -> int:
    """Lines of text, without the header of each file if there is one."""
    text = spark.read.text(path)
    return text.count() - (len(text.inputFiles()) if header else 0)


def keyed_folder(spark: SparkSession, path: str, files_per_trigger: int | None = None, key_field: str = "customer_id") -> DataFrame:
    """A stream of (key, value) from text files; the key is a field of the value's JSON, null where it is none."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _keyed(reader.load(path), key_field)


def keyed_batch(spark: SparkSession, path: str, key_field: str = "customer_id") -> DataFrame:
    return _keyed(spark.read.text(path), key_field)


def _keyed(text: DataFrame, key_field: str) -> DataFrame:
    return text.select(F.get_json_object("value", f"$.{key_field}").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def published(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(key, value) of a folder topic that sinks.publish fills, as a table or as a stream."""
    reader = (spark.readStream if stream else spark.read).schema("key binary, value binary")
    return reader.parquet(f"{path}/batch-*")


def broker(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A stream of (key, value, topic, partition, offset). Needs the Kafka connector; raises the planner's error without it."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    return spark.readStream.format("kafka").options(**options).load().select("key", "value", "topic", "partition", "offset")


def event_stream(records: DataFrame, topic: str, kind: str | None = None) -> DataFrame:
    """Parsed events of a keyed source; the kind is the topic's name unless given."""
    return flattened(records, kind or topic)


def sampled(records: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts by partition, and the first n records, of a static keyed source with partition and offset."""
    return records.groupBy("partition").count(), records.orderBy("partition", "offset").limit(n)
