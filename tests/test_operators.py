"""Boundary cases of the operators, on hand-written rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from riskstream import functions as fn
from riskstream.config import DEFAULT, Settings
from riskstream.operators import detectors, gold, metrics, quality, risk, tables
from riskstream.operators.features import features
from riskstream.operators.ordered import running
from riskstream.operators.parse import split

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def tx(spark, rows):
    return spark.createDataFrame([(str(i), c, at(s), float(a), float(lat), float(lon)) for i, (c, s, a, lat, lon) in enumerate(rows)], "transaction_id string, customer_id string, event_ts timestamp, amount double, lat double, lon double")


def test_velocity_at_and_over(spark):
    rows = [("a", i, 1, 0, 0) for i in range(5)] + [("b", i, 1, 0, 0) for i in range(6)] + [("c", 117 + i, 1, 0, 0) for i in range(6)]
    got = detectors.velocity(tx(spark, rows)).collect()
    assert [(r.customer_id, r.tx_count, r.risk_points) for r in got] == [("b", 6, 25)]
    trailing = detectors.velocity_trailing(tx(spark, rows)).collect()
    assert {(r.customer_id, r.tx_count) for r in trailing} == {("b", 6), ("c", 6)}  # the burst over a window's edge too


def test_card_testing(spark):
    rows = [(f"{c}{i}", c, at(i), 1.0, "FAILED") for c, n in (("a", 10), ("b", 11)) for i in range(n)] + [(f"s{i}", "a", at(i), 1.0, "SUCCESS") for i in range(20)]
    df = spark.createDataFrame(rows, "payment_id string, customer_id string, event_ts timestamp, amount double, status string")
    assert [(r.customer_id, r.failure_count) for r in detectors.card_testing(df).collect()] == [("b", 11)]


def test_login_join_edges(spark):
    logins = spark.createDataFrame([("l1", "a", at(0), True), ("l2", "a", at(1000), False), ("l3", "b", at(0), True), ("l4", "b", at(100), True)], "login_id string, customer_id string, event_ts timestamp, success boolean")
    rows = [("a", 0, 1, 0, 0), ("a", 300, 1, 0, 0), ("a", 301, 1, 0, 0), ("a", -1, 1, 0, 0), ("a", 1001, 1, 0, 0), ("b", 200, 1, 0, 0)]
    got = {(r.login_id, r.gap_seconds) for r in detectors.login_transactions(logins, tx(spark, rows)).collect()}
    assert got == {("l1", 0.0), ("l1", 300.0), ("l3", 200.0), ("l4", 100.0)}


def test_travel(spark):
    rows = [("a", 0, 1, 12.97, 77.59), ("a", 600, 1, 51.5, -0.12), ("b", 0, 1, 10, 10), ("b", 600, 1, 10, 10), ("c", 0, 1, 10, 10), ("c", 0, 1, 10, 10)]
    got = {r.customer_id: r.speed_kmh for r in detectors.impossible_travel(tx(spark, rows)).collect()}
    assert set(got) == {"a", "c"} and math.isinf(got["c"]) and got["a"] > 40_000
    assert {r.customer_id for r in detectors.impossible_travel(tx(spark, rows), zero_gap="ignore").collect()} == {"a"}


def test_high_value(spark):
    day = 86400
    rows = [("a", 0, 100, 0, 0), ("a", day, 100, 0, 0), ("a", 2 * day, 500, 0, 0), ("b", 0, 100, 0, 0), ("b", day, 100, 0, 0), ("b", 2 * day, 500.01, 0, 0), ("c", 0, 1, 0, 0), ("c", 1, 900, 0, 0)]
    rows += [("d", 0, 10_000, 0, 0), ("d", 20 * day, 100, 0, 0), ("d", 20 * day + 1, 700, 0, 0)]
    got = detectors.high_value(tx(spark, rows)).collect()
    assert [(r.customer_id, r.amount, round(r.ratio, 4)) for r in got] == [("b", 500.01, 5.0001)]


def test_high_value_ties_go_by_id(spark):
    rows = [("a", 0, 10, 0, 0), ("a", 5, 10, 0, 0), ("a", 5, 100, 0, 0)]
    assert [r.amount for r in detectors.high_value(tx(spark, rows)).collect()] == [100.0]


def test_bands_and_types(spark):
    rows = [(i, p) for i, p in enumerate([25, 26, 50, 51, 75, 76])]
    got = [r.b for r in spark.createDataFrame(rows, "i int, p int").orderBy("i").select(fn.band(F.col("p")).alias("b")).collect()]
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    alerts = spark.createDataFrame([("1", "a", at(0), "B", 30), ("2", "a", at(1), "A", 25), ("3", "a", at(2), "B", 30)], "alert_id string, customer_id string, event_ts timestamp, alert_type string, risk_points int")
    r = risk.risk(alerts).collect()[0]
    assert (r.alert_types, r.alert_count, r.total_points, r.risk_level, r.event_time) == ("A+B", 3, 85, "CRITICAL", r.window_start)


def test_dead_letters_keep_raw_records(spark):
    good = '{"transaction_id":"1","customer_id":"c","event_time":"2026-01-01T00:00:00","amount":1.0,"lat":0.0,"lon":0.0}'
    bad = ["garbage", "{}", "", None, good.replace("2026-01-01T00:00:00", "soon"), good.replace('"amount":1.0,', "")]
    df = spark.createDataFrame([(b"k", None if v is None else bytearray(v.encode())) for v in [good, *bad]], "key binary, value binary")
    ok, rejected = split(df, "transactions")
    assert [r.transaction_id for r in ok.collect()] == ["1"]
    assert sorted(str(None if r.value is None else bytes(r.value).decode()) for r in rejected.collect()) == sorted(str(v) for v in bad)
    assert all(bytes(r.key) == b"k" for r in rejected.collect())


def test_first_of_and_merge(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "z"), (2, 1, "q")], "id int, ts int, v string")
    assert sorted(map(tuple, tables.first_of(df, "id", ["ts"]).collect())) == [(1, 5, "a"), (2, 1, "q")]
    source = spark.createDataFrame([(2, 9, "new"), (3, 3, "add")], "id int, ts int, v string")
    assert sorted(map(tuple, tables.merged(tables.first_of(df, "id", ["ts"]), source, "id").collect())) == [(1, 5, "a"), (2, 9, "new"), (3, 3, "add")]


def events_frame(spark, rows):
    return spark.createDataFrame(rows, "event_id string, event_type string, customer_id string, event_ts timestamp, amount double, status string, lat double, lon double, device_id string, merchant_id string, payment_method string")


def test_first_of_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, None, "b", 0), (1, 2, "a", 0), (None, 4, "x", 1), (None, 4, "x", 1), (2, 3, "q", 2), (2, 3, "p", 3)], "id int, ts int, `a b` string, _row int")
    found = tables.first_of(df, "id", ["ts"])
    assert found.schema == df.schema
    assert sorted(map(tuple, found.collect()), key=str) == [(1, None, "b", 0), (2, 3, "q", 2), (None, 4, "x", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")  # plans are printed from the top


def test_features_at_window_edges(spark):
    row = lambda i, kind, s, status="OK", lat=0.0, device="d", merchant="m": (i, kind, "a", at(s), 10.0, status, lat, None if lat is None else 0.0, device, merchant, "CARD")
    rows = [row("1", "transactions", 0, "FAILED"), row("2", "payments", 60, lat=None, device=None), row("3", "transactions", 120), row("4", "transactions", 300, merchant=None), row("5", "transactions", 601), row("6", "payments", 601, merchant="n")]
    customers = spark.createDataFrame([("a", 0.0, 0.0, 0.0)], "customer_id string, avg_transaction double, home_lat double, home_lon double")
    got = {r.event_id: r for r in features(events_frame(spark, rows), customers, spark.createDataFrame([("3",)], "event_id string")).collect()}
    assert (got["2"].failed_pay_count_60s, got["3"].failed_pay_count_60s) == (1, 0)
    assert (got["3"].tx_count_120s, got["4"].event_count_300s, got["4"].seconds_since_prev_event) == (1, 3, 180.0)
    assert (got["5"].seconds_since_prev_event, got["5"].event_count_300s) == (None, 0)
    assert (got["6"].seconds_since_prev_event, got["6"].tx_count_120s, got["6"].is_new_merchant, got["6"].is_new_device) == (0.0, 1, 1, 0)
    assert (got["2"].is_new_device, got["2"].dist_km_from_home, got["4"].is_new_merchant) == (None, None, 1)
    assert got["1"].amount_vs_customer_avg is None and [got[i].label for i in "123"] == [0, 0, 1]


def test_metrics_against_definitions(spark):
    import random

    r = random.Random(4)
    rows = [(round(r.random(), 2), int(r.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df).first()[0] - auc) < 1e-12
    ap = sum(sum(s == t for s in pos) * sum(s >= t for s in pos) / sum(s >= t for s, _ in rows) for t in set(pos)) / len(pos)
    assert abs(metrics.average_precision(df).first()[0] - ap) < 1e-12
    c = metrics.confusion(df).first()
    assert c.tp + c.fn == len(pos) and c.fp + c.tn == len(neg)
    assert metrics.roc_auc(df.where("label = 1")).first()[0] is None
    assert metrics.confusion(df.limit(0)).first().f1 == 0.0


def test_running_sums(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"), F.lit(1).alias("one"), (F.col("id") % 2).alias("k"))
    got = running(df, F.floor(F.col("v") / 9), ["v"], ["one"]).collect()
    assert all(r.before_one == r.v for r in got)


def test_quality(spark):
    df = spark.createDataFrame([("1", at(0), "x", 0.5, "t"), ("1", None, None, None, "t")], "event_id string, event_ts timestamp, fraud_scenario string, fraud_probability double, event_type string")
    got = {r.check: r.ok for r in quality.events_checks(df, labels=1, by_type={"t": 1}).collect()}
    assert got == {"distinct_event_ids": False, "null_event_ts": False, "labelled": True, "labelled_t": True}


def test_customers_without_events_stay(spark):
    events = tables.conformed(events_frame(spark, [("1", "transactions", "a", at(0), 10.0, "OK", 0.0, 0.0, "d", "m", "CARD")]))
    customers = spark.createDataFrame([("a", 1, "x", "c", 1.0, "h"), ("b", 1, "x", "c", 1.0, "h")], "customer_id string, age int, country string, currency string, avg_transaction double, home_city string")
    got = {r.customer_id: r for r in gold.customer_summary(events, customers).collect()}
    assert (got["b"].n_events, got["b"].tx_amount_avg, got["b"].risk_level, got["b"].max_risk_points) == (0, None, "LOW", None)
    assert got["a"].n_transactions == 1


def test_rows_without_key_are_spread(spark):
    events = spark.range(1000).selectExpr("id", "if(id % 2 = 0, null, cast(id % 4 as string)) as m")
    shops = spark.createDataFrame([("1", "one"), (None, "none")], "m string, name string")
    got = tables.enriched(events, shops.hint("merge"), "m", {"name": "shop"})
    assert {(r.m, r.shop): r["count"] for r in got.groupBy("m", "shop").count().collect()} == {(None, None): 500, ("1", "one"): 250, ("3", None): 250}
    assert sorted(got.columns) == ["id", "m", "shop"]


def test_merchants_and_empty_alerts(spark):
    events = tables.conformed(events_frame(spark, [("1", "transactions", "a", at(0), 10.0, "OK", 0.0, 0.0, "d", "m", "CARD"), ("2", "payments", "b", at(0), 5.0, "OK", 0.0, 0.0, "d", None, "CARD")])).fillna(1, ["fraud_label"])
    shops = spark.createDataFrame([("m", "M", "c", "x", "t"), ("n", "N", "c", "x", "t")], "merchant_id string, merchant_name string, category string, country string, city string")
    got = {r.merchant_id: (r.n_events, r.total_amount, r.n_customers, r.fraud_rate) for r in gold.merchant_summary(events, shops).collect()}
    assert got == {"m": (1, 10.0, 1, got["m"][3]), "n": (0, 0.0, 0, 0.0)}
    none = gold.fraud_events(events.where("false"))
    assert gold.kpis(none).collect()[0].fraud_alerts == 0 and gold.alerts_by_type(none).count() == 0


def test_settings_are_immutable():
    assert Settings() == DEFAULT
    assert DEFAULT.velocity.points + DEFAULT.travel.points == 55
