"""Detectors over event tables. The window and join detectors are the same on streams; the
sequential ones have streaming twins in riskstream.streaming.state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskstream.config import DEFAULT, Rule, Settings
from riskstream.functions import haversine_km, micros, speed_kmh
from riskstream.operators import ordered
from riskstream.operators.trailing import trailing
from riskstream.operators.windows import in_windows


def _marked(alerts: DataFrame, rule: Rule) -> DataFrame:
    return alerts.withColumn("alert_type", F.lit(rule.alert_type)).withColumn("risk_points", F.lit(rule.points))


def _bursts(events: DataFrame, id_col: str, name: str, seconds: int, over: int, rule: Rule, watermark: int | None) -> DataFrame:
    out = in_windows(events, seconds, None, ["customer_id"], watermark).agg(F.count(id_col).alias(name), F.sum("amount").alias("amount_sum"))
    out = out.where(F.col(name) > over)
    return _marked(out.select("customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), name, "amount_sum"), rule)


def velocity(transactions: DataFrame, s: Settings = DEFAULT, watermark: int | None = None) -> DataFrame:
    """More than `velocity_over` transactions of a customer in one window. Give a watermark on streams."""
    return _bursts(transactions, "transaction_id", "tx_count", s.velocity_window, s.velocity_over, s.velocity, watermark)


def velocity_trailing(transactions: DataFrame, s: Settings = DEFAULT, hot: int = ordered.HOT, peers: bool = True) -> DataFrame:
    """Each transaction that is more than the allowed number within the seconds before it: bursts across window edges too. Static tables only.

    Of transactions of one time those with smaller ids count as before, or none without `peers`. Customers with more than `hot` rows are spread over tasks.
    """
    own = transactions.select("transaction_id", "customer_id", "event_ts", micros(F.col("event_ts")).alias("us"))
    few = lambda df: df.withColumn("tx_count", trailing(["customer_id"], F.col("us"), ["transaction_id"] if peers else []).count(s.velocity_window))
    many = lambda df: ordered.trailing(df, ["customer_id"], "us", ["transaction_id"], {"tx_count": (F.lit(1), s.velocity_window)}, peers=peers)
    out = ordered.by_heat(own, "customer_id", few, many, hot).withColumn("tx_count", F.col("tx_count") + 1).where(F.col("tx_count") > s.velocity_over)
    return _marked(out.select("transaction_id", "customer_id", "event_ts", "tx_count"), s.velocity)


def card_testing(payments: DataFrame, s: Settings = DEFAULT, watermark: int | None = None) -> DataFrame:
    """More than `failures_over` failed payments of a customer in one window."""
    return _bursts(payments.where(F.col("status") == "FAILED"), "payment_id", "failure_count", s.failures_window, s.failures_over, s.failures, watermark)


def impossible_travel(transactions: DataFrame, s: Settings = DEFAULT, zero_gap: str = "inf", hot: int = ordered.HOT) -> DataFrame:
    """Transactions that the customer's previous one, by time and id, is too far from. Customers with more than `hot` rows are spread over tasks."""
    order = Window.partitionBy("customer_id").orderBy("event_ts", "transaction_id")
    place = F.struct("lat", "lon", micros(F.col("event_ts")).alias("us"))
    few = lambda df: df.withColumn("before", F.lag(place).over(order))
    many = lambda df: ordered.scan(df, ["customer_id"], ["event_ts", "transaction_id"], latest={"before": place})
    out = ordered.by_heat(transactions.select("transaction_id", "customer_id", "event_ts", "lat", "lon"), "customer_id", few, many, hot).where(F.col("before").isNotNull())
    out = out.select(
        "transaction_id", "customer_id", F.col("before.lat").alias("prev_lat"), F.col("before.lon").alias("prev_lon"), F.col("lat").alias("cur_lat"), F.col("lon").alias("cur_lon"),
        ((micros(F.col("event_ts")) - F.col("before.us")) / 1e6).alias("time_gap_seconds"), "event_ts",
    )
    out = out.withColumn("distance_km", haversine_km(*map(F.col, ("prev_lat", "prev_lon", "cur_lat", "cur_lon"))))
    out = out.withColumn("speed_kmh", speed_kmh(F.col("distance_km"), F.col("time_gap_seconds"), zero_gap))
    return _marked(out.where(F.col("speed_kmh") > s.speed_over), s.travel)


#: Amounts as decimals, so that sums of any number of them are exact.
_MONEY = "decimal(38,18)"


def high_value(transactions: DataFrame, s: Settings = DEFAULT, hot: int = ordered.HOT, peers: bool = True) -> DataFrame:
    """Amounts many times the larger of the customer's averages over a week and a month before, both without the row itself.

    Of transactions of one time those with smaller ids count as before, or none without `peers`. Customers with more than `hot` rows are spread over tasks.
    """
    amount = F.col("amount")
    short, long_ = s.high_value_short, s.high_value_long

    def few(df: DataFrame) -> DataFrame:
        frame = trailing(["customer_id"], F.col("us"), ["transaction_id"] if peers else [])
        return df.withColumns({"short_sum": frame.sum(amount, short), "short_n": frame.count(short), "long_sum": frame.sum(amount, long_), "history": frame.count(long_)})

    def many(df: DataFrame) -> DataFrame:
        money, one = amount.cast(_MONEY), F.lit(1)
        out = ordered.trailing(df, ["customer_id"], "us", ["transaction_id"], {"short_sum": (money, short), "short_n": (one, short), "long_sum": (money, long_), "history": (one, long_)}, peers=peers)
        return out.withColumns({c: F.col(c).cast("double") for c in ("short_sum", "long_sum")})

    own = transactions.select("transaction_id", "customer_id", "amount", "event_ts", micros(F.col("event_ts")).alias("us"))
    out = ordered.by_heat(own, "customer_id", few, many, hot)
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(F.lit(0.0))
    out = out.withColumns({"avg_7d": mean("short_sum", "short_n"), "avg_30d": mean("long_sum", "history")}).withColumn("baseline", F.greatest("avg_7d", "avg_30d"))
    out = out.where((F.col("history") >= s.high_value_history) & (F.col("baseline") > 0) & (amount > s.high_value_times * F.col("baseline")))
    return _marked(out.select("transaction_id", "customer_id", "amount", "avg_7d", "avg_30d", "baseline", (amount / F.col("baseline")).alias("ratio"), "event_ts"), s.high_value)


def login_transactions(logins: DataFrame, transactions: DataFrame, s: Settings = DEFAULT, watermark: int | None = None) -> DataFrame:
    """Every pair of a successful login and a transaction of the same customer within the gap after it, both ends included.

    Static tables are joined by customer and by time slots as long as the gap as well, so that one customer's rows do
    not all meet each other; each transaction looks into its own slot and the one before.
    """
    gap = s.login_gap
    left = logins.where(F.col("success"))
    streams = left.isStreaming or transactions.isStreaming
    if watermark is not None or streams:
        delay = f"{gap if watermark is None else watermark} seconds"
        left, transactions = left.withWatermark("event_ts", delay), transactions.withWatermark("event_ts", delay)
    left = left.select("login_id", F.col("customer_id").alias("login_customer"), F.col("event_ts").alias("login_ts"))
    right = transactions.select("transaction_id", "customer_id", F.col("event_ts").alias("tx_ts"))
    within = (F.col("customer_id") == F.col("login_customer")) & (F.col("tx_ts") >= F.col("login_ts")) & (F.col("tx_ts") <= F.col("login_ts") + F.expr(f"interval {gap} seconds"))
    if not streams:
        slot = lambda ts: F.floor(micros(F.col(ts)) / (gap * 1_000_000 or 1))
        left = left.withColumn("login_slot", slot("login_ts"))
        right = right.withColumn("slot", F.explode(F.array(slot("tx_ts") - 1, slot("tx_ts"))))
        within = within & (F.col("slot") == F.col("login_slot"))
    seconds = (micros(F.col("tx_ts")) - micros(F.col("login_ts"))) / 1e6
    out = right.join(left, within).select("transaction_id", "customer_id", "login_id", "login_ts", "tx_ts", seconds.alias("gap_seconds"))
    return _marked(out, s.login)


def envelope(alerts: DataFrame, key: str, ts: str, transaction: str | None = None) -> DataFrame:
    """Alerts of any detector in one shape; alert_id is a digest of type, customer and key."""
    time = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return alerts.select(
        F.sha2(F.concat_ws("|", "alert_type", F.col("customer_id").cast("string"), F.col(key).cast("string")), 256).alias("alert_id"),
        F.col("customer_id").cast("string").alias("customer_id"), time.alias("event_time"), "alert_type", "risk_points",
        (F.col(transaction).cast("string") if transaction else F.lit(None).cast("string")).alias("transaction_id"), F.lit(None).cast("string").alias("detail"), F.col(ts).cast("timestamp").alias("event_ts"),
    )
