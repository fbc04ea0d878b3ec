"""Wire and table schemas. Nothing is inferred: a number read as text would compare as text."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType, TimestampType

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


_TYPES = {"string": StringType, "int": IntegerType, "double": DoubleType, "boolean": BooleanType, "timestamp": TimestampType}


def schema(fields: str) -> StructType:
    """From 'name type, ...'. The parser of DDL needs a session, which importing a module must not."""
    out = StructType()
    for field in fields.split(","):
        name, kind = field.split()
        out.add(name, _TYPES[kind]())
    return out


# Field names and types of the event feeds.
EVENTS: dict[str, StructType] = {
    "transactions": schema(
        """transaction_id string, customer_id string, event_time string, amount double, currency string, merchant_id string,
        payment_method string, location string, lat double, lon double, device_id string, status string"""
    ),
    "logins": schema("login_id string, customer_id string, event_time string, device_id string, ip_address string, success boolean, failure_reason string"),
    "payments": schema(
        """payment_id string, customer_id string, event_time string, transaction_id string, amount double, currency string,
        merchant_id string, payment_method string, status string, failure_reason string"""
    ),
    "customer_locations": schema("location_id string, customer_id string, event_time string, city string, lat double, lon double, device_id string"),
    "alerts": schema("alert_id string, customer_id string, event_time string, alert_type string, risk_points int, transaction_id string, detail string"),
}
IDS = {"transactions": "transaction_id", "logins": "login_id", "payments": "payment_id", "customer_locations": "location_id", "alerts": "alert_id"}
#: Besides the id, the customer and the time: what an operator needs to be a number.
NUMBERS = {"transactions": ("amount", "lat", "lon"), "payments": ("amount",), "customer_locations": ("lat", "lon"), "alerts": ("risk_points",), "logins": ()}

CUSTOMERS = schema("customer_id string, age int, country string, currency string, avg_transaction double, home_city string, home_lat double, home_lon double")
MERCHANTS = schema("merchant_id string, merchant_name string, category string, country string, city string, lat double, lon double")
LABELS = schema("event_id string, event_type string, customer_id string, scenario string, alert_type string, risk_points int, label int")

#: The envelope that events of every type are brought into.
UNIFIED = schema(
    """event_id string, event_type string, customer_id string, event_ts timestamp, amount double, currency string, merchant_id string,
    payment_method string, device_id string, status string, lat double, lon double, location string, merchant_name string, category string,
    _ingestion_ts timestamp, fraud_label int, fraud_scenario string, alert_type string, risk_points int, fraud_probability double"""
)
