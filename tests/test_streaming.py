"""Streams against their batch twins, late and repeated records, and restarts."""

import datetime as dt
import json
import os

import pytest

from pyspark.sql import functions as F

from riskstream import ml
from riskstream.operators import detectors, windows
from riskstream.operators.features import features
from riskstream.operators import parse
from riskstream.operators.parse import split
from riskstream.operators.tables import deduplicated_stream
from riskstream.sources import readers, replay, sinks
from riskstream.streaming import runner, state

T0 = dt.datetime(2026, 1, 1)


def record(i, s, customer="a", amount=1.0, lat=0.0, **more):
    time = (T0 + dt.timedelta(seconds=s)).isoformat()
    return json.dumps({"transaction_id": f"{i:03}", "customer_id": customer, "event_time": time, "amount": amount, "lat": lat, "lon": 0.0, "status": "OK", "device_id": f"d{i % 2}", "merchant_id": f"m{i % 3}", "payment_method": "CARD"} | more)


def drop(folder, n, lines):
    folder.mkdir(exist_ok=True)
    file = folder / f"{n:03}.jsonl"
    file.write_text("\n".join(lines) + "\n")
    os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken in the order of their times


def stream(spark, folder):
    return readers.event_stream(readers.keyed_folder(spark, str(folder), 1), "transactions")


def run(spark, df, name, tmp, mode="append"):
    runner.drain(sinks.memory(df, name, mode, str(tmp / name)))
    return spark.table(name)


def batch(spark, folder):
    return readers.event_stream(readers.keyed_batch(spark, str(folder)), "transactions")


def test_velocity_stream_equals_batch(spark, tmp_path):
    lines = [record(i, 10 * i, "ab"[i % 5 == 0]) for i in range(40)]
    for n in range(4):
        drop(tmp_path / "in", n, lines[10 * n : 10 * n + 10])
    expected = {(r.customer_id, r.window_start, r.tx_count) for r in detectors.velocity(batch(spark, tmp_path / "in")).collect()}
    drop(tmp_path / "in", 9, [record(99, 100_000, "z")])  # closes the windows
    got = {(r.customer_id, r.window_start, r.tx_count) for r in run(spark, detectors.velocity(stream(spark, tmp_path / "in"), watermark=120), "velocity", tmp_path).collect()}
    assert got == expected and expected


def test_window_update_mode(spark, tmp_path):
    for n in range(2):
        drop(tmp_path / "in", n, [record(n, 10 * n)])
    got = run(spark, windows.totals(stream(spark, tmp_path / "in"), 120), "updates", tmp_path, "update")
    assert sorted(r.tx_count for r in got.collect()) == [1, 2]


@pytest.mark.parametrize("name", ["travel", "high_value"])
def test_sequential_detectors_equal_batch(spark, tmp_path, name):
    lines = [record(i, 600 * i, "abc"[i % 3], amount=10.0 if i % 7 else 900.0, lat=float(i % 4 * 20)) for i in range(45)]
    for n in range(3):
        drop(tmp_path / "in", n, lines[15 * n : 15 * n + 15])
    one, two = (state.travel_stream, detectors.impossible_travel) if name == "travel" else (state.high_value_stream, detectors.high_value)
    column = "speed_kmh" if name == "travel" else "ratio"
    got = {(r.transaction_id, round(r[column], 6)) for r in run(spark, one(stream(spark, tmp_path / "in")), f"s_{name}", tmp_path, "update").collect()}
    assert got == {(r.transaction_id, round(r[column], 6)) for r in two(batch(spark, tmp_path / "in")).collect()} and got


def test_online_features_equal_batch_across_a_restart(spark, tmp_path):
    lines = [record(i, 40 * i, "ab"[i % 2], status="FAILED" if i % 4 == 0 else "OK") for i in range(24)]
    shape = lambda df: state.event_union(df, df.where("false").withColumnRenamed("transaction_id", "payment_id"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for n in range(2):
        drop(tmp_path / "in", n, lines[12 * n : 12 * n + 12])
        runner.drain(sinks.each_batch(state.feature_stream(shape(stream(spark, tmp_path / "in"))), sinks.batch_folders(out), check, "update"))
    columns = ["tx_count_120s", "failed_pay_count_60s", "event_count_300s", "seconds_since_prev_event", "is_new_device", "is_new_merchant"]
    got = {r.event_id: [r[c] for c in columns] for r in spark.read.parquet(out).collect()}
    customers = spark.createDataFrame([], "customer_id string, avg_transaction double, home_lat double, home_lon double")
    expected = {r.event_id: [r[c] for c in columns] for r in features(shape(batch(spark, tmp_path / "in")), customers).collect()}
    assert got == expected and len(got) == 24


def test_devices_are_new_again_after_a_while(spark, tmp_path):
    lines = [record(i, s, merchant_id=None) for i, s in enumerate((0, 10, 100, 450, 460, 1200, 1210))]
    for n in range(3):
        drop(tmp_path / "in", n, lines[3 * n : 3 * n + 3])
    shape = lambda df: state.event_union(df, df.where("false").withColumnRenamed("transaction_id", "payment_id"))
    customers = spark.createDataFrame([], "customer_id string, avg_transaction double, home_lat double, home_lon double")
    expected = {r.event_id: r.is_new_device for r in features(shape(batch(spark, tmp_path / "in")), customers, ttl=350).collect()}
    assert [expected[f"{i:03}"] for i in range(7)] == [1, 1, 0, 1, 1, 1, 1] and [r[1] for r in sorted(expected.items())].count(0) == 1
    drop(tmp_path / "in", 9, [record(99, 10_000, "z")])
    got = {r.event_id: r.is_new_device for r in run(spark, state.feature_stream(shape(stream(spark, tmp_path / "in")), watermark=30, ttl=350), "ttl", tmp_path).collect()}
    assert got == expected


def test_online_scores_equal_batch(spark, tmp_path):
    lines = [record(i, 40 * i, "ab"[i % 2], amount=500.0 if i % 6 == 0 else 5.0) for i in range(60)]
    for n in range(3):
        drop(tmp_path / "in", n, lines[20 * n : 20 * n + 20])
    shape = lambda df: state.event_union(df, df.where("false").withColumnRenamed("transaction_id", "payment_id"))
    customers = spark.createDataFrame([("a", 10.0, 0.0, 0.0)], "customer_id string, avg_transaction double, home_lat double, home_lon double")
    own = shape(batch(spark, tmp_path / "in"))
    table = features(own, customers, own.where("amount > 100"))
    model = ml.train(table, ml.Params(trees=3, depth=3, rate=0.3))
    got = {r.event_id: r.fraud_probability for r in run(spark, state.scored_stream(model, shape(stream(spark, tmp_path / "in")), customers), "scored", tmp_path, "update").collect()}
    assert got == {r.event_id: r.fraud_probability for r in ml.score(model, table).collect()} and len(got) == 60


def test_dead_letters_duplicates_late_rows_and_restart(spark, tmp_path):
    source, out, dead = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "dead")

    def once():
        raw = readers.keyed_folder(spark, str(source), 1)
        good, bad = split(raw, "transactions")
        good = deduplicated_stream(good, "transaction_id", 30)
        q = runner.drain(sinks.each_batch(good, sinks.batch_folders(out), str(tmp_path / "c1")), sinks.dead_letters(bad, dead, str(tmp_path / "c2")))
        return [p["batch_id"] for p in map(runner.normalized, q[0].recentProgress)]

    drop(source, 0, [record(1, 0), record(1, 0), "garbage"])
    drop(source, 1, [record(2, 100)])
    drop(source, 2, [record(3, 200)])
    first = once()
    drop(source, 3, [record(3, 200), record(4, 5), record(5, 201)])  # a repeat, a late row, a new one
    second = once()
    ids = sorted(r.transaction_id for r in spark.read.parquet(out).collect())
    assert ids == ["001", "002", "003", "005"]
    assert [bytes(r.value).decode() for r in spark.read.parquet(dead).collect()] == ["garbage"]
    assert min(second) > max(first)


def test_login_join_stream(spark, tmp_path):
    drop(tmp_path / "tx", 0, [record(1, 100), record(2, 301)])
    login = {"login_id": "l", "customer_id": "a", "event_time": T0.isoformat(), "success": True}
    drop(tmp_path / "login", 0, [json.dumps(login)])
    logins = readers.event_stream(readers.keyed_folder(spark, str(tmp_path / "login")), "logins")
    got = run(spark, detectors.login_transactions(logins, stream(spark, tmp_path / "tx")), "pairs", tmp_path).collect()
    assert [(r.transaction_id, r.gap_seconds) for r in got] == [("001", 100.0)]


def test_progress_and_lag():
    p = {"batchId": 3, "numInputRows": 5, "sources": [{"startOffset": None, "endOffset": '{"t":{"0":4}}', "latestOffset": {"t": {"0": 9}}}], "eventTime": {"watermark": "w"}}
    n = runner.normalized(p)
    assert (n["batch_id"], n["num_input_rows"], n["watermark"], n["source_end_offset"]) == (3, 5, "w", {"t": {"0": 4}})
    assert runner.lag(p) == 5
    assert runner.lag({"sources": [{"endOffset": "x"}]}) is None


def test_publish_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "topic")
    records = spark.createDataFrame([(b"k1", bytearray(record(1, 0).encode())), (None, bytearray(b"garbage"))], "key binary, value binary")
    assert sinks.publish(records, folder) == 2 and sinks.publish(records.limit(1), folder) == 1
    got = readers.published(spark, folder)
    assert sorted(str(r.key and bytes(r.key)) for r in got.collect()) == ["None", "b'k1'", "b'k1'"]
    assert readers.event_stream(got, "topic", "transactions").where("event_ts is null").count() == 1
    assert run(spark, readers.event_stream(readers.published(spark, folder, stream=True), "transactions"), "published", tmp_path).count() == 3
    (tmp_path / "blocked").write_text("a file where the topic should be")
    with pytest.raises(sinks.DeliveryError):
        sinks.publish(records, str(tmp_path / "blocked"))


def test_lag_by_partition():
    got = runner.partition_lag({"t": {"0": 9, "10": 3, "2": 4}}, {"t": {"0": 4, "2": 4}})
    assert [(r["partition"], r["end"], r["committed"], r["lag"]) for r in got] == [(0, 9, 4, 5), (2, 4, 4, 0), (10, 3, None, None)]
    assert [r["lag"] for r in runner.partition_lag({"t": {"0": 9}}, None)] == [None]


def test_console_sink(spark, tmp_path):
    drop(tmp_path / "in", 0, [record(1, 0)])
    runner.drain(sinks.console(stream(spark, tmp_path / "in")).option("checkpointLocation", str(tmp_path / "console")))


def test_broker_is_planned_or_refused(spark):
    """Without the connector on the classpath Spark says so, for the source and for the sink."""
    from pyspark.errors import PySparkException

    for make in (lambda: readers.broker(spark, "host:1", "t"), lambda: sinks.to_broker(spark.readStream.format("rate").load().selectExpr("cast(value as string) as value"), "host:1", "t").option("checkpointLocation", "/tmp/none").start()):
        with pytest.raises((PySparkException, Exception), match="(?i)kafka"):
            make()


def test_sampled(spark):
    df = spark.createDataFrame([(p, o) for p in (1, 0) for o in (5, 3, 4)], "partition int, offset long")
    counts, first = readers.sampled(df, 4)
    assert [tuple(r) for r in first.collect()] == [(0, 3), (0, 4), (0, 5), (1, 3)] and {r["count"] for r in counts.collect()} == {3}


def test_live_run_and_listener(spark, tmp_path):
    drop(tmp_path / "in", 0, [record(i, i) for i in range(3)])
    seen = []
    listener = runner.BatchListener(lambda query, progress: seen.append(progress["num_input_rows"]))
    spark.streams.addListener(listener)
    try:
        told = runner.run_for(sinks.memory(stream(spark, tmp_path / "in"), "live", "append", str(tmp_path / "live")), 8, "1 second")
    finally:
        spark.streams.removeListener(listener)
    assert told["rows"] == 3 and told["error"] is None and told["batches"] >= 1
    assert sum(seen) == 3


def test_append_mode_under_a_watermark_drops_late_rows(spark, tmp_path):
    drop(tmp_path / "in", 0, [record(1, 10), record(2, 20)])
    drop(tmp_path / "in", 1, [record(3, 400)])
    drop(tmp_path / "in", 2, [record(4, 700)])  # the watermark of the batch before is what counts
    drop(tmp_path / "in", 3, [record(5, 15), record(6, 1000)])
    drop(tmp_path / "in", 4, [record(7, 5000)])
    got = run(spark, windows.totals(stream(spark, tmp_path / "in"), 120, watermark=60), "late", tmp_path).collect()
    assert {(r.window_start.minute, r.tx_count) for r in got} >= {(0, 2), (6, 1), (10, 1)}
    assert sum(r.tx_count for r in got if r.window_start.minute == 0) == 2


def test_rows_out_of_order_wait_for_the_watermark(spark, tmp_path):
    lines = [record(i, 600 * i, "ab"[i % 2], lat=float(i % 4 * 20)) for i in range(30)]
    late = [8, 9, 17]
    for n in range(3):
        drop(tmp_path / "in", n, [lines[i] for i in range(10 * n, 10 * n + 10) if i not in late] + [lines[i] for i in late if i // 10 == n - 1])
    expected = {(r.transaction_id, r.time_gap_seconds) for r in detectors.impossible_travel(batch(spark, tmp_path / "in")).collect()}
    drop(tmp_path / "in", 9, [record(99, 10_000_000, "z")])
    got = {(r.transaction_id, r.time_gap_seconds) for r in run(spark, state.travel_stream(stream(spark, tmp_path / "in"), watermark=9000), "waiting", tmp_path).collect()}
    assert got == expected and len(got) > 10
    # without waiting, late rows are compared with what came before them, not with what happened before them
    at_once = {(r.transaction_id, r.time_gap_seconds) for r in run(spark, state.travel_stream(stream(spark, tmp_path / "in")), "at_once", tmp_path, "update").collect()}
    assert at_once != expected


def test_alert_versions_replace_and_take_back(spark, tmp_path):
    def alert(i, kind, points, version, s=0):
        return json.dumps({"alert_id": i, "customer_id": "a", "event_ts": (T0 + dt.timedelta(seconds=s)).isoformat(), "alert_type": kind, "risk_points": points, "version": version})

    drop(tmp_path / "in", 0, [alert("x", "V", 20, 0), alert("y", "T", 30, 0)])
    drop(tmp_path / "in", 1, [alert("x", "V", 25, 1), alert("z", "V", 5, 1, 400)])
    drop(tmp_path / "in", 2, [alert("y", "T", None, 2), alert("x", "V", 20, 0)])  # taken back; an old version that comes late
    alerts = spark.readStream.schema("alert_id string, customer_id string, event_ts timestamp, alert_type string, risk_points int, version long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    runner.drain(sinks.each_batch(state.risk_stream(alerts), sinks.batch_folders(out), str(tmp_path / "check"), "update"))
    got = {(r.batch, r.window_start.minute): (r.alert_count, r.alert_types, r.total_points, r.risk_level) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 0): (2, "T+V", 50, "MEDIUM"), (1, 0): (2, "T+V", 55, "HIGH"), (1, 5): (1, "V", 5, "LOW"), (2, 0): (1, "V", 25, "LOW")}


def test_both_parts_of_a_batch_or_none(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for n in range(2):
        drop(tmp_path / "in", n, [record(n, 0), f"garbage {n}"])
    write, fail = sinks.sound_folders(out), [True]

    def crashing(batch, n):
        write(batch, n)
        if n == 1 and fail:
            # as if the job had ended between its two parts: one is there, the mark of success is not
            fail.clear()
            for name in ("_SUCCESS", "._SUCCESS.crc", "sound=false"):
                sinks.remove(spark, f"{out}/batch=1/{name}")
            raise RuntimeError("lost")

    df = parse.judged(readers.keyed_folder(spark, str(tmp_path / "in"), 1), "transactions")
    writer = lambda: sinks.each_batch(df, crashing, check)
    with pytest.raises(Exception, match="lost"):
        runner.drain(writer())
    read = lambda: [sorted((r.batch, r.transaction_id if k == 0 else bytes(r.value).decode()) for r in part.collect()) for k, part in enumerate(sinks.sound_and_dead(spark, out, df.schema))]
    assert read() == [[(0, "000")], [(0, "garbage 0")]]
    runner.drain(writer())
    assert read() == [[(0, "000"), (1, "001")], [(0, "garbage 0"), (1, "garbage 1")]]
    assert [part.count() for part in sinks.sound_and_dead(spark, str(tmp_path / "none"), df.schema)] == [0, 0]


def test_replay_deals_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i)) for i in range(60)], "id long, ts timestamp")
    own = replay.dealt(rows, "ts", F.col("id") == 3)
    path = f"file://{tmp_path}/played"
    replay.play(own, path, (0, 3))
    seen = []
    collect = lambda batch, n: seen.append(sorted(r.id for r in batch.collect()))
    once = lambda: runner.drain(sinks.each_batch(replay.replayed(spark, path, rows.schema), collect, str(tmp_path / "check")))
    once()
    replay.play(own, path, (4, 9))
    once()
    assert seen == [[0, 1, 2, 4, 5, 6, 7, 8, 9], list(range(10, 20)), [3, *range(20, 30)], list(range(30, 40)), list(range(40, 50)), list(range(50, 60))]
    assert replay.dealt(rows.limit(0), "ts").count() == 0


def test_files_of_a_batch_follow_their_order(spark, tmp_path):
    path, seen = f"file://{tmp_path}/ordered", []
    rows = spark.range(400).select(F.pmod(F.col("id") * 7919, F.lit(400)).alias("at")).repartition(4)
    write = sinks.batch_folders(path, order=["at"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, part in enumerate(("at < 200", "at >= 200")):
            write(rows.where(part), n)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.readStream.schema("at long").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    runner.drain(sinks.each_batch(files, lambda batch, n: seen.append(sorted(r["at"] for r in batch.collect())), str(tmp_path / "check")))
    assert len(seen) > 4 and sum(seen, []) == list(range(400))


def test_state_is_held_by_buckets_of_customers(spark, tmp_path):
    lines = [record(i, 10 * i, f"c{i % 200}", lat=float(i // 200 * 20)) for i in range(600)]
    drop(tmp_path / "in", 0, lines[:400])
    drop(tmp_path / "in", 1, lines[400:])
    expected = {(r.transaction_id, r.time_gap_seconds) for r in detectors.impossible_travel(batch(spark, tmp_path / "in")).collect()}
    drop(tmp_path / "in", 9, [record(999, 10_000_000, "z")])
    own, out = state.travel_stream(stream(spark, tmp_path / "in"), watermark=60, buckets=4), str(tmp_path / "out")
    q = runner.drain(sinks.each_batch(own, sinks.batch_folders(out), str(tmp_path / "check")))
    assert {(r.transaction_id, r.time_gap_seconds) for r in spark.read.parquet(out).collect()} == expected and expected
    # a few rows of state for each bucket, however many customers there are
    assert max(op["numRowsTotal"] for p in q[0].recentProgress for op in json.loads(p.json)["stateOperators"]) < 100


@pytest.mark.parametrize("peers", [True, False])
def test_high_value_stream_with_peers_or_without(spark, tmp_path, peers):
    lines = [record(i, s, amount=float(a)) for i, (s, a) in enumerate([(0, 10), (5, 10), (5, 100), (5, 2), (60, 90), (90, 700)])]
    drop(tmp_path / "in", 0, lines)
    expected = {(r.transaction_id, r.avg_7d) for r in detectors.high_value(batch(spark, tmp_path / "in"), peers=peers).collect()}
    got = run(spark, state.high_value_stream(stream(spark, tmp_path / "in"), peers=peers), f"peers_{peers}", tmp_path, "update").collect()
    assert {(r.transaction_id, r.avg_7d) for r in got} == expected and expected
