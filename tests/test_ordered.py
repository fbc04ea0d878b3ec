"""Scans over segments against plain loops, with keys of any size and rows spread over tasks."""

import collections
import datetime as dt
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from riskstream import ml
from riskstream.config import DEFAULT
from riskstream.operators import detectors, metrics, ordered
from riskstream.operators.features import features

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # nine tenths are one customer's, some rows have none, times repeat
    return [(i, "hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.randrange(4000), round(r.uniform(0, 900), 3) if r.random() < 0.95 else None) for i in range(1500)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, us long, amount double").cache()


@pytest.mark.parametrize("keys, fan", [(["key"], 1024), ([], 1024), ([], 2)])
def test_scan_equals_loop(table, rows, keys, fan):
    got = {r.id: (r.n, r.last, r.total) for r in ordered.scan(table, keys, ["us", "id"], {"n": F.lit(1), "total": F.floor("amount")}, {"last": F.col("amount")}, segment=100, fan=fan).collect()}
    seen, expected = collections.defaultdict(lambda: [0, None, 0]), {}
    for i, key, us, amount in sorted(rows, key=lambda x: (x[2], x[0])):
        own = seen[key if keys else 0]
        expected[i] = tuple(own)
        own[0] += 1
        if amount is not None:
            own[1], own[2] = amount, own[2] + int(amount)
    assert got == expected


def test_scan_of_nothing(table):
    assert ordered.scan(table.limit(0), ["key"], ["us"], {"n": F.lit(1)}).count() == 0 and ordered.scan(table.limit(0), [], ["us"], {"n": F.lit(1)}).count() == 0


def test_trailing_equals_loop(spark, table, rows):
    own = table.withColumn("us", F.col("us") * 1_000_000)
    frames = {"near": (F.lit(1), 60), "far": (F.when(F.col("amount") > 400, 1).otherwise(0), 700), "sum": (F.col("amount").cast("decimal(38,18)"), 700)}
    got = {r.id: (r.near, r.far, float(r["sum"]), r.before) for r in ordered.trailing(own, ["key"], "us", ["id"], frames, {"before": F.col("us")}, segment=200).collect()}
    by_key = collections.defaultdict(list)
    for i, key, us, amount in sorted(rows, key=lambda x: (x[2], x[0])):
        earlier = by_key[key]
        far = [a or 0 for u, a in earlier if u >= us - 700]
        n, f, total, before = got[i]
        assert (n, f, before) == (sum(u >= us - 60 for u, _ in earlier), sum(a > 400 for a in far), earlier[-1][0] * 1_000_000 if earlier else None)
        assert abs(total - sum(far)) < 1e-9
        earlier.append((us, amount))
    # equal rows count each
    twice = ordered.trailing(own.where("id < 50").unionByName(own.where("id < 50")), ["key"], "us", ["id"], {"n": (F.lit(1), 10_000)})
    assert twice.count() == 100 and twice.agg(F.sum("n")).first()[0] == sum(n * (n - 1) // 2 for n in collections.Counter(x[1] for x in rows[:50] for _ in range(2)).values())


def test_a_hot_customer_is_spread(table):
    sizes = [r["count"] for r in ordered.dealt(table, [F.col("key"), F.col("us"), F.col("id")], segment=150).groupBy("_seg").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * statistics.median(sizes)


def events(spark, rows):
    r = random.Random(5)
    made = [
        (str(i), "payments" if i % 3 == 0 else "transactions", key, T0 + dt.timedelta(seconds=us), amount, "FAILED" if i % 4 == 0 else "OK", float(us % 50), 1.0, r.choice([None, "d1", "d2", f"d{i % 40}"]), r.choice([None, "m1", f"m{i % 30}"]), "CARD")
        for i, key, us, amount in rows
    ]
    return spark.createDataFrame(made, "event_id string, event_type string, customer_id string, event_ts timestamp, amount double, status string, lat double, lon double, device_id string, merchant_id string, payment_method string")


def same(one, two):
    key = lambda df: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in df.select(sorted(df.columns)).collect())
    left = key(one)
    assert left == key(two) and left


@pytest.mark.parametrize("ttl", [None, 300])
def test_features_of_hot_customers(spark, rows, ttl):
    own = events(spark, rows)
    customers = spark.createDataFrame([("hot", 10.0, 0.0, 0.0)], "customer_id string, avg_transaction double, home_lat double, home_lon double")
    same(features(own, customers, own.where("amount > 800"), ttl=ttl), features(own, customers, own.where("amount > 800"), ttl=ttl, hot=200))


def test_detectors_of_hot_customers(spark, rows):
    own = events(spark, rows).withColumnRenamed("event_id", "transaction_id").where("amount is not null")
    s = replace(DEFAULT, high_value_times=1.5)
    for detector in (detectors.velocity_trailing, detectors.impossible_travel, detectors.high_value):
        same(detector(own, s), detector(own, s, hot=200))
        same(detector(own, s), detector(own, s, hot=0))


def test_ranks_of_many_scores(spark):
    df = spark.range(60_000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)).alias("score")).withColumn("label", (F.pmod(F.xxhash64("score"), F.lit(1000)) < 1000 * F.col("score")).cast("int"))
    rows = sorted((r.score, r.label) for r in df.collect())
    pos = sum(y for _, y in rows)
    auc = sum(i + 1 for i, (_, y) in enumerate(rows) if y) - pos * (pos + 1) / 2
    assert abs(metrics.roc_auc(df, segment=2000).first()[0] - auc / (pos * (len(rows) - pos))) < 1e-9
    hit, total = 0, 0.0
    for n, (_, y) in enumerate(reversed(rows), 1):
        hit += y
        total += y * hit / n
    assert abs(metrics.average_precision(df, segment=2000).first()[0] - total / pos) < 1e-9
    sizes = [r["count"] for r in ordered.dealt(df, [F.col("score")], segment=2000).groupBy("_seg").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 2 * statistics.median(sizes)
    parts = {(r.label, r.is_test): r["count"] for r in ml.split(df, "id").groupBy("label", "is_test").count().collect()}
    assert parts[1, True] == round(0.2 * pos) and parts[0, True] == round(0.2 * (len(rows) - pos))


@pytest.mark.parametrize("hot", [ordered.HOT, 0])
def test_peers_do_not_count_where_sql_leaves_them_out(spark, hot):
    made = [(i, "a", T0 + dt.timedelta(seconds=s), float(amount)) for i, (s, amount) in enumerate([(0, 1), (1, 2), (5, 3), (5, 4), (5, 5), (6, 100)])]
    own = spark.createDataFrame(made, "transaction_id long, customer_id string, event_ts timestamp, amount double")
    s = replace(DEFAULT, velocity_over=0, high_value_times=0.1)
    found = {r.transaction_id: r.tx_count for r in detectors.velocity_trailing(own, s, hot, peers=False).collect()}
    assert found == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 6}
    assert {r.transaction_id: r.tx_count for r in detectors.velocity_trailing(own, s, hot).collect()} == {i: i + 1 for i in range(6)}
    assert {r.transaction_id: r.avg_7d for r in detectors.high_value(own, s, hot, peers=False).collect()} == {2: 1.5, 3: 1.5, 4: 1.5, 5: 3.0}


def test_rows_of_a_hot_customer_meet_what_is_known_without_a_shuffle_by_customer(spark, rows):
    own = events(spark, rows)
    customers = spark.createDataFrame([("hot", 10.0, 0.0, 0.0), ("a", 5.0, 1.0, 1.0)], "customer_id string, avg_transaction double, home_lat double, home_lon double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = features(own, customers, hot=200)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # one join of few customers' rows by shuffle; that of the hot ones is a broadcast
        known = [line for line in plan.splitlines() if "Join" in line and "customer_id#" in line and "LeftOuter" in line]
        assert sum("BroadcastHashJoin" in line for line in known) >= 1 and sum("SortMergeJoin [customer_id#" in line and "], [customer_id#" in line and "," not in line.split("[")[1].split("]")[0] for line in known) <= 1, known
        same(df, features(own, customers))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
