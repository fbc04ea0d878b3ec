"""The test tables in the roles of the feeds.

Customers are the users of `events`; purchases are transactions, errors failed payments,
clicks payments that went through, signups logins, views location pings.  The number k
in props stands for merchant, device and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(raw: DataFrame) -> DataFrame:
    """event_id, customer_id, event_ts, kind, amount, k, lat, lon of rows of the events table."""
    k = F.from_json("props", "k int")["k"]
    own = raw.select("event_id", F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_type").alias("kind"), F.col("value").alias("amount"), k.alias("k"))
    return own.withColumns({"lat": F.col("k") * 1.8 - 90.0, "lon": F.col("k") * 3.6 - 180.0})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # times of the tables have no zone; the session's zone decides what instants they are, and UTC is what windows are aligned to
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return shaped(table(spark, sf_dir, "events"))


def transactions(own: DataFrame) -> DataFrame:
    return own.where("kind = 'purchase'").withColumnRenamed("event_id", "transaction_id")


def payments(own: DataFrame) -> DataFrame:
    own = own.where("kind in ('error', 'click')").withColumnRenamed("event_id", "payment_id")
    return own.withColumn("status", F.when(F.col("kind") == "error", "FAILED").otherwise("SUCCESS"))


def logins(own: DataFrame) -> DataFrame:
    return own.where("kind = 'signup'").withColumnRenamed("event_id", "login_id").withColumn("success", F.col("k") < 90)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at every scale
    own = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return own.select(
        key.alias("customer_id"), (F.pmod(key, F.lit(60)) + 18).cast("int").alias("age"), F.col("n_name").alias("country"), F.col("r_name").alias("currency"), F.col("c_acctbal").alias("avg_transaction"),
        F.col("c_mktsegment").alias("home_city"), (F.pmod(key, F.lit(180)) - 90).cast("double").alias("home_lat"), (F.pmod(key, F.lit(360)) - 180).cast("double").alias("home_lon"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("merchant_id"), F.col("p_name").alias("merchant_name"), F.col("p_brand").alias("category"), F.col("p_type").alias("country"), F.col("p_size").cast("string").alias("city"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, fraud_scenario, alert_type, risk_points, fraud_label of events that the rule amount > 150 and k < 50 calls fraud."""
    kind = F.when(F.col("kind") == "purchase", "high_value").when(F.col("kind") == "error", "card_testing").otherwise("other")
    own = events(spark, sf_dir).where("amount > 150 and k < 50")
    return own.select("event_id", kind.alias("fraud_scenario"), F.upper(kind).alias("alert_type"), (F.col("k") % 3 * 5 + 20).cast("int").alias("risk_points"), F.lit(1).alias("fraud_label"))
