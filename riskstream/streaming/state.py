"""Stateful operators for streams whose batch twins are window expressions.

With a watermark, rows wait until it has passed them and are then handed on in the order of time and ties, so that rows out of
order, but not later than the watermark, give what the batch twin gives.  Without one, rows of a micro-batch go in that
order as they come, and a row that arrives behind the latest one seen does not become the latest.  Histories
keep only what a later row could look at.  What "new device" and "new merchant" mean needs all that a customer ever
used, unless what was not used for some time counts as new again: then that state is dropped as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskstream import ml
from riskstream.config import DEFAULT, Settings
from riskstream.functions import DETECTOR_RADIUS_KM, band, micros
from riskstream.operators.features import FEATURES, of_itself
from riskstream.operators.windows import in_windows

#: Buckets of customers, at least, and rows of a bucket, about, where the number of rows is known.
BUCKETS, BUCKET_ROWS = 96, 25_000


def buckets_for(rows: int) -> int:
    return max(BUCKETS, rows // BUCKET_ROWS)


def distance_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float = DETECTOR_RADIUS_KM) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(",")]


_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


class Kept:
    """Rows of a bucket in its state, as chunks of a table: what is added is written, not what is there."""

    #: Chunks that are read together before they become one.
    MOST = 8

    def __init__(self, handle: StatefulProcessorHandle, name: str, ddl: str):
        self.chunks, self.schema = handle.getListState(name, "chunk binary"), pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(",")])
        self.count = 0

    def read(self) -> pd.DataFrame:
        parts = [pa.ipc.open_stream(pa.py_buffer(bytes(c[0]))).read_all() for c in self.chunks.get()] if self.chunks.exists() else []
        self.count = len(parts)
        return (pa.concat_tables(parts) if parts else self.schema.empty_table()).to_pandas()

    def _bytes(self, rows: pd.DataFrame) -> tuple:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(pa.Table.from_pandas(rows[self.schema.names], self.schema, preserve_index=False))
        return (out.getvalue().to_pybytes(),)

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.chunks.appendValue(self._bytes(rows))

    def put(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.chunks.put([self._bytes(rows)])
        else:
            self.chunks.clear()

    def keep(self, old: pd.DataFrame, new: pd.DataFrame, held: np.ndarray) -> None:
        """Of old, just read, and new rows those that `held` holds for; what is dropped may stay until it is half."""
        if self.count >= self.MOST or 2 * held[: len(old)].sum() < len(old):
            self.put(pd.concat([old, new], ignore_index=True)[held])
        else:
            self.add(new[held[len(old) :]])


def _after(old: pd.DataFrame, new: pd.DataFrame, by: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Old and new rows by customer and time, old ones first and then by `by`; customers as numbers, times, and the place of each new row."""
    both = pd.concat([old.assign(_new=0), new.assign(_new=1)], ignore_index=True) if len(old) else new.assign(_new=1)
    both = both.sort_values(["customer_id", "us", "_new", *by], kind="stable", ignore_index=True)
    code = pd.factorize(both["customer_id"], use_na_sentinel=False)[0]  # of sorted customers, so in their order
    return both, code, both["us"].to_numpy(np.int64), np.flatnonzero(both["_new"].to_numpy() == 1)


def _since(code: np.ndarray, us: np.ndarray, at: np.ndarray, seconds: int) -> np.ndarray:
    """For the rows at some places, the first place of their customer that is no more than so many seconds before."""
    least = us[at] - seconds * 1_000_000
    ranks, rank = np.unique(np.concatenate([us, least]), return_inverse=True)
    return np.searchsorted(code * len(ranks) + rank[: len(us)], code[at] * len(ranks) + rank[len(us) :], "left")


def _numbers(texts: pd.Series) -> np.ndarray:
    return np.array([np.nan if x is None or x != x else float(x) for x in texts], np.float64)


class InOrder(StatefulProcessor):
    """The rows of a bucket of customers, each customer's in the order of time and ties; subclasses say what they read (IN), give (OUT), keep (`open`) and do (`step`).

    Calls to the state cost the same for one row as for many, and what timers let out is handed on bucket by bucket: so work follows
    from the number of rows, and memory from those of a bucket. Numbers that are only passed on are texts, so that
    what is missing stays apart from what is not a number.
    """

    IN = OUT = ""
    #: What decides between rows of one time.
    TIES = ["transaction_id"]
    #: Whether rows wait for the watermark.
    ordered = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.ordered:
            self.waiting, self.due = Kept(handle, "waiting", self.IN), handle.getValueState("due", "ms long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, rows: pd.DataFrame, watermark: int | None) -> pd.DataFrame:
        """What rows give after all rows before; watermark in microseconds."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True)[_names(self.IN)]
        own["us"] = own["us"].astype(np.int64)
        if not self.ordered:
            yield self.step(own, None)[_names(self.OUT)]
            return
        self.waiting.add(own)
        self._wake(int(own["us"].min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists() or self.due.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier one took its place
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self.waiting.read()
        ready = (rows["us"] <= watermark).to_numpy()
        self.waiting.put(rows[~ready])
        self.due.clear()
        if not ready.all():
            self._wake(int(rows["us"][~ready].min()))
        if ready.any():
            yield self.step(rows[ready], watermark)[_names(self.OUT)]

    def _wake(self, us: int) -> None:
        ms = -(-us // 1000)
        if not self.due.exists() or ms < self.due.get()[0]:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def close(self) -> None:
        pass


class Travel(InOrder):
    """Compares a transaction with the latest before it, by event time."""

    IN = "customer_id string, us long, transaction_id string, lat string, lon string"
    OUT = """transaction_id string, customer_id string, prev_lat double, prev_lon double, cur_lat double, cur_lon double, distance_km double,
    time_gap_seconds double, speed_kmh double, us long, alert_type string, risk_points int"""

    def __init__(self, s: Settings = DEFAULT, zero_gap: str = "inf"):
        self.s, self.zero_gap = s, zero_gap

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.latest = Kept(handle, "latest", "customer_id string, us long, lat string, lon string")

    def step(self, rows: pd.DataFrame, watermark: int | None) -> pd.DataFrame:
        # a customer's latest stands before its new rows, whatever their times
        both = pd.concat([self.latest.read().assign(_new=0), rows.assign(_new=1)], ignore_index=True).sort_values(["customer_id", "_new", "us", *self.TIES], kind="stable", ignore_index=True)
        code, us = pd.factorize(both["customer_id"], use_na_sentinel=False)[0], both["us"].astype(np.int64)
        top = us.groupby(code).cummax().to_numpy()
        place = np.arange(len(both))
        latest = np.maximum.accumulate(np.where(us.to_numpy() == top, place, -1))
        self.latest.put(both.iloc[latest[np.append(code[1:] != code[:-1], True)]])
        at = np.flatnonzero((both["_new"].to_numpy() == 1) & (code == np.roll(code, 1)) & (place > 0))
        before = latest[at - 1]
        lat, lon = _numbers(both["lat"]), _numbers(both["lon"])
        gap = (us.to_numpy()[at] - us.to_numpy()[before]) / 1e6
        far = distance_km(lat[before], lon[before], lat[at], lon[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            speed = np.where(gap > 0, far / (gap / 3600), np.where(np.isnan(far) | (self.zero_gap != "inf"), np.nan, np.inf))
        found = both.iloc[at].assign(
            prev_lat=lat[before], prev_lon=lon[before], cur_lat=lat[at], cur_lon=lon[at], distance_km=far, time_gap_seconds=gap, speed_kmh=speed, alert_type=self.s.travel.alert_type, risk_points=self.s.travel.points
        )
        return found[speed > self.s.speed_over]


class HighValue(InOrder):
    """Compares an amount with the averages of a week and a month before; the history is of (time, amount). Without `peers` no row of the same time counts."""

    IN = "customer_id string, us long, transaction_id string, amount string"
    OUT = """transaction_id string, customer_id string, amount double, avg_7d double, avg_30d double, baseline double, ratio double, us long,
    alert_type string, risk_points int"""

    def __init__(self, s: Settings = DEFAULT, peers: bool = True):
        self.s, self.peers = s, peers

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.history = Kept(handle, "history", "customer_id string, us long, amount double")

    def step(self, rows: pd.DataFrame, watermark: int | None) -> pd.DataFrame:
        s, old, rows = self.s, self.history.read(), rows.assign(amount=_numbers(rows["amount"]))
        both, code, us, at = _after(old, rows, self.TIES)
        amount = both["amount"].to_numpy(np.float64)
        sound = np.isfinite(amount)
        sums = np.append(0, np.cumsum(np.where(sound, amount, 0), dtype=np.longdouble))
        odd = np.append(0, np.cumsum(~sound))
        end = at if self.peers else _since(code, us, at, 0)

        def mean(seconds: int) -> tuple[np.ndarray, np.ndarray]:
            first = _since(code, us, at, seconds)
            n, total = end - first, (sums[end] - sums[first]).astype(np.float64)
            for i in np.flatnonzero(odd[end] > odd[first]):
                part = amount[first[i] : end[i]]
                part = part[~np.isnan(part)]
                total[i] = fsum(part) if np.isfinite(part).all() else part.sum()
            return np.where(n > 0, total / np.maximum(n, 1), 0.0), n

        (short, _), (long_, n) = mean(s.high_value_short), mean(s.high_value_long)
        base, value = np.maximum(long_, short), amount[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = both.iloc[at].assign(avg_7d=short, avg_30d=long_, baseline=base, ratio=value / base, alert_type=s.high_value.alert_type, risk_points=s.high_value.points)
        out = found[(n >= s.high_value_history) & (base > 0) & (value > s.high_value_times * base)]
        every = pd.concat([old, rows], ignore_index=True)[["customer_id", "us", "amount"]]
        held = (every["us"] >= every.groupby("customer_id", dropna=False)["us"].transform("max") - s.high_value_long * 1_000_000).to_numpy()
        self.history.keep(old, every.iloc[len(old) :], held)
        return out


class OnlineFeatures(InOrder):
    """The window features of customers' events, from the events before: short histories, and when devices and merchants were used last.

    With `ttl`, a device or merchant not used for more than so many seconds is new again, and forgotten once the watermark says so.
    """

    IN = """customer_id string, us long, event_id string, event_type string, amount string, status string, lat string, lon string, device_id string, merchant_id string,
    payment_method string"""
    OUT = """event_id string, customer_id string, event_type string, us long, amount string, status string, lat string, lon string, device_id string,
    merchant_id string, payment_method string, tx_count_120s long, failed_pay_count_60s long, event_count_300s long,
    seconds_since_prev_event double, is_new_device int, is_new_merchant int"""
    TIES = ["_rank", "event_id"]

    def __init__(self, tx: int = 120, fail: int = 60, event: int = 300, ttl: int | None = None):
        self.tx, self.fail, self.event, self.ttl = tx, fail, event, ttl

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent = Kept(handle, "recent", "customer_id string, us long, tx boolean, failed boolean")
        self.used = {name: Kept(handle, name, f"customer_id string, {name} string, us long") for name in ("device_id", "merchant_id")}

    def _new(self, name: str, rows: pd.DataFrame, watermark: int | None) -> np.ndarray:
        """Of rows in order, whether each one's device or merchant is new to its customer."""
        old, named = self.used[name].read(), rows[rows[name].notna()]
        both = pd.concat([old, named[["customer_id", name, "us"]]], ignore_index=True)
        group = both.groupby(["customer_id", name], sort=False, dropna=False).ngroup().to_numpy()
        top = both["us"].groupby(group).cummax()
        before = top.groupby(group).shift().to_numpy(np.float64)
        new = np.isnan(before) if self.ttl is None else ~(both["us"].to_numpy() - before <= self.ttl * 1_000_000)
        if self.ttl is None:
            self.used[name].keep(old, both.iloc[len(old) :], new)
        else:
            last = both.assign(us=top)[~pd.Series(group).duplicated(keep="last").to_numpy()]
            self.used[name].put(last if watermark is None else last[last["us"] >= watermark - self.ttl * 1_000_000])
        out = np.full(len(rows), np.nan)
        out[rows[name].notna().to_numpy()] = new[len(old) :]
        return out

    def step(self, rows: pd.DataFrame, watermark: int | None) -> pd.DataFrame:
        rows = rows.assign(tx=rows["event_type"] == "transactions", failed=rows["status"] == "FAILED", _rank=(rows["event_type"] == "payments").astype(int))
        both, code, us, at = _after(self.recent.read(), rows, self.TIES)
        sums = {name: np.append(0, np.cumsum(both[name].to_numpy(bool))) for name in ("tx", "failed")}
        first = {seconds: _since(code, us, at, seconds) for seconds in (self.tx, self.fail, self.event)}
        near = at - first[self.event]
        found = both.iloc[at].reset_index(drop=True)
        found = found.assign(
            tx_count_120s=sums["tx"][at] - sums["tx"][first[self.tx]], failed_pay_count_60s=sums["failed"][at] - sums["failed"][first[self.fail]], event_count_300s=near,
            seconds_since_prev_event=np.where(near > 0, (us[at] - us[np.maximum(at - 1, 0)]) / 1e6, np.nan),
        )
        found["is_new_device"] = self._new("device_id", found, watermark)
        found["is_new_merchant"] = pd.Series(self._new("merchant_id", found, watermark)).fillna(1)
        least = both.groupby("customer_id", dropna=False)["us"].transform("max") - max(self.tx, self.fail, self.event) * 1_000_000
        self.recent.put(both[both["us"] >= least])
        return found


def _stateful(events: DataFrame, processor: InOrder, watermark: int | None, buckets: int) -> DataFrame:
    # columns are chosen here since the planner cannot see into a processor
    us = micros(F.col("event_ts"))
    kinds = dict(f.split() for f in processor.IN.split(","))
    own = events.select("event_ts", F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int").alias("bucket"), us.alias("us"), *(F.col(c).cast(kind).alias(c) for c, kind in kinds.items() if c != "us"))
    processor.ordered = watermark is not None
    if watermark is None:
        own = own.drop("event_ts")
    else:
        own = own.withWatermark("event_ts", f"{watermark} seconds")
    mode = ("None", "update") if watermark is None else ("EventTime", "append")
    out = own.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode=mode[1], timeMode=mode[0])
    texts = {c: F.col(c).cast(events.schema[c].dataType) for c in ("amount", "lat", "lon") if f"{c} string" in processor.OUT}
    return out.withColumns(texts | {"event_ts": F.timestamp_micros("us")}).drop("us")


def travel_stream(transactions: DataFrame, s: Settings = DEFAULT, zero_gap: str = "inf", watermark: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    return _stateful(transactions, Travel(s, zero_gap), watermark, buckets)


def high_value_stream(transactions: DataFrame, s: Settings = DEFAULT, watermark: int | None = None, buckets: int = BUCKETS, peers: bool = True) -> DataFrame:
    return _stateful(transactions, HighValue(s, peers), watermark, buckets)


def feature_stream(events: DataFrame, watermark: int | None = None, ttl: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    return _stateful(events, OnlineFeatures(ttl=ttl), watermark, buckets)


def risk_stream(alerts: DataFrame, s: Settings = DEFAULT, watermark: int | None = None) -> DataFrame:
    """Risk of a customer and window, given anew whenever one of its alerts changes; alerts(alert_id, customer_id, event_ts, alert_type, risk_points, version).

    The state of a window is the versions of its alerts: of each alert the latest counts, and one without points takes it back.
    The last row of a customer and window is its state; one whose alerts were all taken back has a count of 0.
    With a watermark a window's alerts are let go once it has passed the window's end.
    """
    versions = F.array_sort(F.collect_set(F.struct("alert_id", "version", "alert_type", "risk_points")))
    own = in_windows(alerts, s.risk_window, None, ["customer_id"], watermark).agg(versions.alias("all"))
    ends = lambda x, i: (i + 1 == F.size("all")) | (x["alert_id"] != F.get("all", i + 1)["alert_id"])
    held = F.filter(F.filter("all", ends), lambda x: x["risk_points"].isNotNull())
    own = own.select("customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), held.alias("held"))
    total = F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["risk_points"])
    own = own.select("customer_id", "window_start", "window_end", F.size("held").cast("long").alias("alert_count"), F.array_join(F.array_sort(F.array_distinct(F.col("held.alert_type"))), "+").alias("alert_types"), total.alias("total_points"))
    return own.withColumns({"risk_level": band(F.col("total_points"), s.levels), "event_time": F.col("window_start")})


def with_own_features(online: DataFrame, customers: DataFrame) -> DataFrame:
    """Online features with those that need only the event and its customer."""
    known = customers.select("customer_id", "avg_transaction", "home_lat", "home_lon")
    return online.join(known, "customer_id", "left").withColumns(of_itself()).select("event_id", "customer_id", "event_type", "event_ts", "amount", *FEATURES)


def scored_stream(model, events: DataFrame, customers: DataFrame, threshold: float = 0.5, watermark: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every event once, with all model features from the events before it, and its probability.

    State, and so the features after a restart, are in the query's checkpoint; customers are joined as a static table.
    """
    return ml.score(model, with_own_features(feature_stream(events, watermark, buckets=buckets), customers), threshold)


def event_union(transactions: DataFrame, payments: DataFrame) -> DataFrame:
    """Transactions and payments as one stream of events; payments have no place and no device."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    shared = ["customer_id", "event_ts", "amount", "status", "merchant_id", "payment_method"]
    one = transactions.select(F.col("transaction_id").alias("event_id"), F.lit("transactions").alias("event_type"), *shared, "lat", "lon", "device_id")
    two = payments.select(F.col("payment_id").alias("event_id"), F.lit("payments").alias("event_type"), *shared, number.alias("lat"), number.alias("lon"), text.alias("device_id"))
    return one.unionByName(two)
