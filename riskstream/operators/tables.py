"""Deduplication, enrichment, conforming and upserts of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskstream.schemas import UNIFIED


#: Over how many parts rows without a key are spread.
_SPREAD = 256


def first_of(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """One row of each id: the first by order and then by all other columns, so that the choice does not depend on chance.

    Rows of one id are combined before the shuffle, so an id may have any share of them.
    """
    of = lambda c: F.col(f"`{c}`")
    rest = [of(c).cast("string") for c in sorted(df.columns) if c not in (id_col, *order)]
    place = F.struct(*(of(c) for c in order), *rest) if order or rest else F.lit(0)
    return df.groupBy(of(id_col).alias("_id")).agg(F.min_by(F.struct(*(of(c) for c in df.columns)), place).alias("_row")).select("_row.*")


def deduplicated_stream(events: DataFrame, id_col: str, seconds: int, ts: str = "event_ts") -> DataFrame:
    """The first arrival of each id within the delay."""
    return events.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark([id_col])


def enriched(events: DataFrame, dimension: DataFrame, on: str, columns: dict[str, str]) -> DataFrame:
    """events with columns of a dimension under new names; events that match nothing stay. A small dimension is broadcast by the planner's own size rule.

    Events without a key match nothing and would all meet in one partition of a shuffle: they are spread by what else they hold.
    """
    spread = F.when(F.col(on).isNull(), F.pmod(F.xxhash64(*events.columns), F.lit(_SPREAD))).otherwise(F.lit(0))
    own = dimension.select(on, *(F.col(old).alias(new) for old, new in columns.items()), F.lit(0).cast("long").alias("_spread"))
    return events.withColumn("_spread", spread).join(own, [on, "_spread"], "left").drop("_spread")


def conformed(df: DataFrame, to: StructType = UNIFIED, instead: dict[str, str] | None = None) -> DataFrame:
    """The columns of a schema, cast to it; missing ones from another column if instead names one that is there, else null."""
    instead = {"location": "city"} if instead is None else instead

    def one(field):
        name = field.name if field.name in df.columns else instead.get(field.name, "")
        return (F.col(name) if name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)

    return df.select([one(f) for f in to])


def merged(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target with the rows of source put in: equal keys are replaced, new ones added. One shuffle of each side by the key."""
    return target.join(source.select(key), key, "left_anti").unionByName(source.select(target.columns))
