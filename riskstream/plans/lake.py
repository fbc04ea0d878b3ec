"""The lake: bronze (as read), silver (unified, labelled, enriched, scored), gold (presentation).

Each layer overwrites its tables, so building again gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.functions import event_time
from riskstream.operators import gold, quality
from riskstream.operators.tables import conformed, enriched, first_of
from riskstream.schemas import CUSTOMERS, EVENTS, IDS, MERCHANTS
from riskstream.sources import readers
from riskstream.sources.sinks import TableStore, single_csv

FEEDS = ("transactions", "logins", "payments", "customer_locations")
CUSTOMER_COLUMNS = {"age": "customer_age", "country": "customer_country", "currency": "customer_currency", "avg_transaction": "avg_transaction", "home_city": "home_city", "home_lat": "home_lat", "home_lon": "home_lon"}
MERCHANT_COLUMNS = {"merchant_name": "merchant_name", "category": "category", "city": "merchant_city", "country": "merchant_country"}


def bronze(store: TableStore, raw: str) -> None:
    """Every feed and dimension of the raw folder as it is, with the time it was read."""
    spark = store.spark
    for kind in FEEDS:
        store.write(f"bronze/{kind}", readers.json_lines(spark, f"{raw}/{kind}.jsonl", EVENTS[kind]).withColumn("_ingestion_ts", F.current_timestamp()))
    for name, schema in (("customers", CUSTOMERS), ("merchants", MERCHANTS)):
        store.write(f"bronze/{name}", readers.csv_table(spark, f"{raw}/{name}.csv", schema).withColumn("_ingestion_ts", F.current_timestamp()))


def enriched_feed(df: DataFrame, kind: str, labels: DataFrame, customers: DataFrame, merchants: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One feed: an event once, its time read, labels, dimensions and, if score is given, a probability."""
    out = first_of(df, IDS[kind], ["event_time"]).withColumnRenamed(IDS[kind], "event_id")
    out = out.withColumns({"event_type": F.lit(kind), "event_ts": event_time(F.col("event_time"))}).join(labels, "event_id", "left").fillna(0, ["fraud_label"])
    if "merchant_id" in out.columns:
        out = enriched(out, merchants, "merchant_id", MERCHANT_COLUMNS)
    out = enriched(out, customers, "customer_id", CUSTOMER_COLUMNS)
    return score(out) if score else out


def unified(feeds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [conformed(f) for f in feeds])


def silver(store: TableStore, labels: DataFrame, scores: DataFrame | None = None) -> None:
    """scores(event_id, fraud_probability) are joined to what they name; other events have none."""
    customers, merchants = store.read("bronze/customers"), store.read("bronze/merchants")
    score = (lambda df: df.join(scores, "event_id", "left")) if scores is not None else None
    for kind in FEEDS:
        store.write(f"silver/{kind}", enriched_feed(store.read(f"bronze/{kind}"), kind, labels, customers, merchants, score))
    # the envelope is cut by type, which readers filter on
    store.write("silver/events", unified([store.read(f"silver/{kind}") for kind in FEEDS]), ["event_type"])


def build_gold(store: TableStore) -> None:
    events = store.read("silver/events")
    store.write("gold/customer_risk_summary", gold.customer_summary(events, store.read("bronze/customers")))
    store.write("gold/merchant_fraud_summary", gold.merchant_summary(events, store.read("bronze/merchants")))
    store.write("gold/fraud_events", gold.fraud_events(events))


def check(store: TableStore, raw: str, labels: DataFrame) -> DataFrame:
    """Bronze against raw lines, silver against itself and the labels, gold against silver."""
    spark = store.spark
    parts = [quality.counted(store.read(f"bronze/{kind}"), f"bronze_{kind}", readers.lines(spark, f"{raw}/{kind}.jsonl")) for kind in FEEDS]
    parts += [quality.counted(store.read(f"bronze/{name}"), f"bronze_{name}", readers.lines(spark, f"{raw}/{name}.csv", header=True)) for name in ("customers", "merchants")]
    events = store.read("silver/events")
    # by what the labels say of themselves, one row for each feed
    said = {r["event_type"]: r["count"] for r in labels.groupBy("event_type").count().collect()} if "event_type" in labels.columns else {}
    by_type = {kind: said.get(kind, 0) for kind in FEEDS} if said else None
    parts.append(quality.events_checks(events, labels=labels.count(), by_type=by_type, conserved=("fraud_conserved", store.read("gold/customer_risk_summary"))))
    parts.append(quality.counted(store.read("gold/fraud_events"), "gold_fraud_events", events.where("fraud_label = 1").count()))
    return quality.report(*parts)


def dashboard(store: TableStore, folder: str) -> dict[str, int]:
    """Presentation tables as one CSV each, and a manifest of their rows."""
    fraud, customers = store.read("gold/fraud_events"), store.read("gold/customer_risk_summary")
    tables = {name: make(fraud) for name, make in gold.DASHBOARD.items()} | {"top_risky_customers": gold.top_risky(customers)}
    rows = {name: single_csv(store.spark, df, folder, name) for name, df in tables.items()}
    TableStore(store.spark, folder).write_json("manifest.json", {"source": f"{store.root}/gold", "tables": rows})
    return rows


def rebuild(store: TableStore, raw: str, labels_path: str, scores: DataFrame | None = None) -> dict:
    """All layers, checked; the manifest says what there is and whether every check holds."""
    labels = readers.labels(store.spark, labels_path)
    bronze(store, raw)
    silver(store, labels.drop("event_type"), scores)
    build_gold(store)
    found = check(store, raw, labels).toPandas()
    manifest = {"ok": bool(found["ok"].all()), "checks": dict(zip(found["check"], map(bool, found["ok"]))), "rows": {name: store.count(name) for name in ("silver/events", "gold/customer_risk_summary", "gold/merchant_fraud_summary", "gold/fraud_events")}}
    store.write_json("manifest.json", manifest)
    return manifest
