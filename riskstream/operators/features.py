"""The fourteen model features of each transaction and payment, from window expressions over strictly earlier events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskstream.functions import FEATURE_RADIUS_KM, haversine_km, micros
from riskstream.operators import ordered
from riskstream.operators.trailing import trailing

# Names and order of the features.
FEATURES = (
    "is_payment", "is_failed", "amount_log", "amount_vs_customer_avg", "hour", "dow", "dist_km_from_home", "tx_count_120s", "failed_pay_count_60s",
    "event_count_300s", "seconds_since_prev_event", "is_new_device", "is_new_merchant", "payment_method_is_card",
)
TX_SECONDS, FAIL_SECONDS, EVENT_SECONDS = 120, 60, 300


def of_itself() -> dict[str, Column]:
    """The features that need only the event and its customer(avg_transaction, home_lat, home_lon): the same on streams."""
    flag = lambda p: F.coalesce(p, F.lit(False)).cast("int")
    return {
        "is_payment": flag(F.col("event_type") == "payments"), "is_failed": flag(F.col("status") == "FAILED"), "amount_log": F.log1p("amount"),
        "amount_vs_customer_avg": F.when(F.col("avg_transaction") != 0, F.col("amount") / F.col("avg_transaction")), "hour": F.hour("event_ts"), "dow": F.weekday("event_ts"),
        "dist_km_from_home": haversine_km(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon"), FEATURE_RADIUS_KM), "payment_method_is_card": flag(F.col("payment_method") == "CARD"),
    }


def features(events: DataFrame, customers: DataFrame, fraud: DataFrame | None = None, ttl: int | None = None, hot: int = ordered.HOT) -> DataFrame:
    """event_id, customer_id, event_type, event_ts, label and FEATURES of events(event_id, event_type, customer_id, event_ts,
    amount, status, lat, lon, device_id, merchant_id, payment_method).

    Events of one time go by type, transactions first, and then id. Failed events of both types count as failures.
    label is 1 for ids in fraud(event_id); 0 without it. With ttl, a device or merchant that was not used for more than so
    many seconds is new again. Customers with more than `hot` rows are spread over tasks.
    """
    known = customers.select("customer_id", "avg_transaction", "home_lat", "home_lon")
    payment = F.col("event_type") == "payments"
    own = events.withColumns({"us": micros(F.col("event_ts")), "rank": F.when(payment, 1).otherwise(0)})
    own = ordered.by_heat(own, "customer_id", lambda df: _by_windows(df, ttl), lambda df: _by_scans(df, ttl), hot, known)
    if fraud is not None:
        own = own.join(fraud.select("event_id", F.lit(1).alias("label")).distinct(), "event_id", "left").fillna(0, ["label"])
    else:
        own = own.withColumn("label", F.lit(0))
    gap = (F.col("us") - F.col("before_us")) / 1e6
    sequential = {
        **{name: F.col(name) for name in _frames()}, "seconds_since_prev_event": F.when(gap <= EVENT_SECONDS, gap), "is_new_device": F.when(F.col("device_id").isNotNull(), F.col("new_device").cast("int")),
        "is_new_merchant": F.when(F.col("merchant_id").isNotNull(), F.col("new_merchant").cast("int")).otherwise(1),
    }
    columns = of_itself() | sequential
    return own.select("event_id", "customer_id", "event_type", "event_ts", "label", *(columns[f].alias(f) for f in FEATURES))


_TIES = ["rank", "event_id"]
_USED = {"device_id": "new_device", "merchant_id": "new_merchant"}


def _frames() -> dict[str, tuple[Column, int]]:
    """What is counted, over how many seconds."""
    one = lambda p: F.coalesce(p, F.lit(False)).cast("int")
    return {"tx_count_120s": (one(F.col("event_type") == "transactions"), TX_SECONDS), "failed_pay_count_60s": (one(F.col("status") == "FAILED"), FAIL_SECONDS), "event_count_300s": (F.lit(1), EVENT_SECONDS)}


def _again(before: Column, ttl: int) -> Column:
    return before.isNull() | (F.col("us") - before > ttl * 1_000_000)


def _by_windows(own: DataFrame, ttl: int | None) -> DataFrame:
    back = trailing(["customer_id"], F.col("us"), _TIES)
    own = own.withColumns({name: back.sum(value, seconds) for name, (value, seconds) in _frames().items()} | {"before_us": F.lag("us").over(Window.partitionBy("customer_id").orderBy("us", *_TIES))})
    for column, name in _USED.items():
        order = Window.partitionBy("customer_id", column).orderBy("us", *_TIES)
        own = own.withColumn(name, F.row_number().over(order) == 1 if ttl is None else _again(F.lag("us").over(order), ttl))
    return own


def _by_scans(own: DataFrame, ttl: int | None) -> DataFrame:
    """The same with a customer's rows in many segments; what came first of a device or merchant is a combined minimum, found again by its id."""
    own = ordered.trailing(own, ["customer_id"], "us", _TIES, _frames(), {"before_us": F.col("us")})
    for column, name in _USED.items():
        if ttl is not None:
            own = ordered.scan(own, ["customer_id", column], ["us", *_TIES], latest={"_used": F.col("us")}).withColumn(name, _again(F.col("_used"), ttl)).drop("_used")
            continue
        first = own.where(F.col(column).isNotNull()).groupBy("customer_id", column).agg(F.min(F.struct("us", *_TIES)).alias("_f"))
        first = first.select(F.col("_f.event_id").alias("_id"), F.col("_f.us").alias("_us"), F.col("_f.rank").alias("_rank"), F.col("customer_id").alias("_customer"), F.lit(True).alias("_first"))
        # by the event, so that a device or merchant used very often is no key of a join
        same = (F.col("event_id") == F.col("_id")) & (F.col("us") == F.col("_us")) & (F.col("rank") == F.col("_rank")) & F.col("customer_id").eqNullSafe(F.col("_customer"))
        own = own.join(first, same, "left").withColumn(name, F.coalesce("_first", F.lit(False))).drop("_id", "_us", "_rank", "_customer", "_first")
    return own
