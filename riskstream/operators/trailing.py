"""Windows of time before a row, the row itself excluded."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trailing:
    """Rows of the same keys up to some seconds before, both ends included, in the order of time and then of ties.

    Frames by range take rows of equal time as one; those before this row by the tie order
    are added from a second frame among rows of its time; without ties none of them is.
    """

    keys: tuple[str, ...]
    us: Column
    ties: tuple[str, ...]

    def _over(self, value: Column, seconds: int) -> Column:
        earlier = Window.partitionBy(*self.keys).orderBy(self.us).rangeBetween(-seconds * 1_000_000, -1)
        if not self.ties:
            return F.coalesce(F.sum(value).over(earlier), F.lit(0))
        same = Window.partitionBy(*self.keys, self.us).orderBy(*self.ties).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0)) + F.coalesce(F.sum(value).over(same), F.lit(0))

    def sum(self, value: Column, seconds: int) -> Column:
        return self._over(value, seconds)

    def count(self, seconds: int, where: Column | None = None) -> Column:
        return self._over(F.lit(1) if where is None else F.coalesce(where, F.lit(False)).cast("int"), seconds)


def trailing(keys: Sequence[str], us: Column, ties: Sequence[str]) -> Trailing:
    return Trailing(tuple(keys), us, tuple(ties))
