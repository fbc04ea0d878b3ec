"""Column expressions. All are built-in functions, so they stay in generated code and can be pushed down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskstream.config import DEFAULT
from riskstream.schemas import TIME_FORMAT

DETECTOR_RADIUS_KM = 6371.0
FEATURE_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = DETECTOR_RADIUS_KM) -> Column:
    """Great-circle distance; null where a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # rounding may carry antipodes past 1; least() would turn null into 1
    return 2 * radius * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def speed_kmh(distance_km: Column, gap_seconds: Column, zero_gap: str = "inf") -> Column:
    """Implied speed. Without time between them it is infinite, or null with zero_gap='ignore'; null where an input is."""
    none = F.lit(float("inf")) if zero_gap == "inf" else F.lit(None).cast("double")
    return F.when(gap_seconds > 0, distance_km / (gap_seconds / 3600.0)).when(distance_km.isNotNull() & (gap_seconds <= 0), none)


def band(points: Column, levels: Sequence[tuple[str, int]] = DEFAULT.levels) -> Column:
    """The highest level whose least points are reached; the lowest for null."""
    out = F.lit(levels[0][0])
    for name, least in levels[1:]:
        out = F.when(points >= least, F.lit(name)).otherwise(out)
    return out


def names_joined(names: Column) -> Column:
    """Aggregate: the distinct names in order, joined by '+'."""
    return F.array_join(F.array_sort(F.collect_set(names)), "+")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio, 0 where there is no whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def event_time(text: Column) -> Column:
    """The time of a wire string; null, not an error, where it is none."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def count_where(p: Column) -> Column:
    """Aggregate: rows for which p is true; 0 for none."""
    return F.count_if(F.coalesce(p, F.lit(False)))


def sum_where(p: Column, value: Column) -> Column:
    return F.sum(F.when(p, value).otherwise(F.lit(0)))


def avg_where(p: Column, value: Column) -> Column:
    return F.avg(F.when(p, value))
