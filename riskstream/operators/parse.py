"""Raw (key, value) records to typed events, and the records that are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.functions import event_time
from riskstream.schemas import EVENTS, IDS, NUMBERS


def parsed(kind: str, value: Column) -> Column:
    """A struct of the event's fields; its fields are null, or it is, where value is no such JSON."""
    return F.from_json(value.cast("string"), EVENTS[kind])


def flattened(records: DataFrame, kind: str) -> DataFrame:
    """Every record as an event with event_ts, sound or not."""
    return records.select(parsed(kind, F.col("value")).alias("e")).select("e.*").withColumn("event_ts", event_time(F.col("event_time")))


def sound(kind: str, of: str = "e") -> Column:
    """Whether a parsed struct has its id, customer, a readable time and the numbers that operators rely on."""
    needed = [IDS[kind], "customer_id", *NUMBERS[kind]]
    ok = event_time(F.col(f"{of}.event_time")).isNotNull()
    for name in needed:
        ok = ok & F.col(f"{of}.{name}").isNotNull()
    return F.coalesce(ok, F.lit(False))


def judged(records: DataFrame, kind: str) -> DataFrame:
    """Each record parsed once: key and value, its event e, and whether it is sound."""
    return records.select("key", "value", parsed(kind, F.col("value")).alias("e")).withColumn("sound", sound(kind))


def events_of(judged: DataFrame, *more: str) -> DataFrame:
    return judged.where("sound").select("e.*", *more).withColumn("event_ts", event_time(F.col("event_time")))


def split(records: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(events with event_ts, rejected records with key and value as they came), which together are all records."""
    own = judged(records, kind)
    return events_of(own), own.where("not sound").select("key", "value")
