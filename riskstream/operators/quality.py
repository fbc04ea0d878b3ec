"""Data-quality checks: one aggregate pass for each table, a row for each check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.functions import count_where


def checks(df: DataFrame, measures: dict[str, Column], expected: dict[str, int | str], more: DataFrame | None = None) -> DataFrame:
    """check, actual, expected, ok. measures are aggregates by name; expected has for each a number or the name of another measure; more is a row of measures that come from elsewhere."""
    one = df.agg(*(m.cast("long").alias(name) for name, m in measures.items()))
    if more is not None:
        one = one.unionByName(more, allowMissingColumns=True)
        one = one.agg(*(F.max(c).alias(c) for c in one.columns))
    rows = [
        F.struct(F.lit(name).alias("check"), F.col(name).alias("actual"), (F.col(want) if isinstance(want, str) else F.lit(want)).cast("long").alias("expected"))
        for name, want in expected.items()
    ]
    out = one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    return out.withColumn("ok", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def events_checks(events: DataFrame, labels: int | None = None, rows: int | None = None, scored: int | None = None, by_type: dict[str, int] | None = None, conserved: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Ids are unique, times are there, and labelled, scored and all rows are as many as they should be; with conserved, a name and a summary, as many are fraud as the summary's n_fraud adds up to."""
    labelled = F.col("fraud_scenario").isNotNull()
    measures = {"rows": F.count("*"), "distinct_event_ids": F.count_distinct("event_id"), "null_event_ts": count_where(F.col("event_ts").isNull()), "labelled": count_where(labelled), "scored": count_where(F.col("fraud_probability").isNotNull())}
    expected: dict[str, int | str] = {"distinct_event_ids": "rows", "null_event_ts": 0}
    expected |= {k: v for k, v in {"rows": rows, "labelled": labels, "scored": scored}.items() if v is not None}
    for kind, n in sorted((by_type or {}).items()):
        measures[f"labelled_{kind}"] = count_where(labelled & (F.col("event_type") == kind))
        expected[f"labelled_{kind}"] = n
    if conserved is None:
        return checks(events, measures, expected)
    name, summary = conserved
    measures["_fraud"] = count_where(F.col("fraud_label") == 1)
    return checks(events, measures, expected | {name: "_fraud"}, summary.agg(F.coalesce(F.sum("n_fraud"), F.lit(0)).cast("long").alias(name)))


def facts(events: DataFrame) -> DataFrame:
    """What a manifest tells of the unified events, in one pass: rows, distinct ids and customers, labelled, scored, unreadable times, and the mean probability of labelled rows."""
    labelled = F.col("fraud_scenario").isNotNull()
    return events.agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("distinct_event_ids"), F.count_distinct("customer_id").alias("customers"), count_where(labelled).alias("labelled"),
        count_where(F.col("fraud_probability").isNotNull()).alias("scored"), count_where(F.col("event_ts").isNull()).alias("null_event_ts"), F.round(F.avg(F.when(labelled, F.col("fraud_probability"))), 4).alias("avg_labelled_probability"),
    )


def counted(df: DataFrame, name: str, expected: int) -> DataFrame:
    return checks(df, {name: F.count("*")}, {name: expected})


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
