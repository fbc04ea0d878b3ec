"""The lake on a small raw folder, twice; versions, model and dashboard."""

import json

import pytest

from riskstream import ml
from riskstream.operators.features import FEATURES
from riskstream.plans import lake
from riskstream.sources import readers
from riskstream.sources.sinks import TableStore, single_csv


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    time = "2026-01-01T10:00:0"
    rows = {
        "transactions": [{"transaction_id": f"T{i}", "customer_id": "C1", "event_time": f"{time}{i}", "amount": 5.0 * i, "currency": "EUR", "merchant_id": "M1", "payment_method": "CARD", "location": "X", "lat": 1.0, "lon": 2.0, "device_id": "D", "status": "OK"} for i in (1, 2, 2)],
        "logins": [{"login_id": "L1", "customer_id": "C1", "event_time": f"{time}1", "device_id": "D", "success": True}],
        "payments": [{"payment_id": "P1", "customer_id": "C2", "event_time": f"{time}3", "amount": 7.0, "currency": "EUR", "merchant_id": "M9", "payment_method": "UPI", "status": "FAILED"}],
        "customer_locations": [{"location_id": "O1", "customer_id": "C1", "event_time": f"{time}4", "city": "Here", "lat": 1.0, "lon": 2.0, "device_id": "D"}],
    }
    for name, lines in rows.items():
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in lines))
    (folder / "customers.csv").write_text("customer_id,age,country,currency,avg_transaction,home_city,home_lat,home_lon\nC1,30,DE,EUR,10.0,X,1.0,2.0\nC2,31,DE,EUR,10.0,X,1.0,2.0\nC3,32,DE,EUR,10.0,X,1.0,2.0\n")
    (folder / "merchants.csv").write_text("merchant_id,merchant_name,category,country,city,lat,lon\nM1,Shop,food,DE,X,1.0,2.0\n")
    (folder / "labels.jsonl").write_text(json.dumps({"event_id": "T2", "event_type": "transactions", "customer_id": "C1", "scenario": "s", "alert_type": "A", "risk_points": 30, "label": 1}) + "\n")
    return str(folder)


def test_rebuild_twice(spark, raw, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/lake")
    scores = spark.createDataFrame([("T1", 0.1), ("T2", 0.9), ("P1", 0.2)], "event_id string, fraud_probability double")
    for _ in range(2):
        manifest = lake.rebuild(store, raw, f"{raw}/labels.jsonl", scores)
        assert manifest["ok"] and {"labelled_transactions", "labelled_logins"} <= set(manifest["checks"]), manifest
        assert manifest["rows"] == {"silver/events": 5, "gold/customer_risk_summary": 3, "gold/merchant_fraud_summary": 1, "gold/fraud_events": 1}
    assert store.history("silver/events") == [0, 1]
    seen = {r.event_id: r for r in store.read("silver/events").collect()}
    assert (seen["O1"].location, seen["P1"].merchant_name, seen["T2"].fraud_label, seen["L1"].fraud_probability) == ("Here", None, 1, None)
    rows = lake.dashboard(store, f"file://{tmp_path}/dash")
    assert rows == {"kpis": 1, "alert_details": 1, "alerts_by_hour": 1, "alerts_by_type": 1, "top_risky_customers": 1}
    assert (tmp_path / "dash" / "kpis.csv").read_text().startswith("fraud_alerts,")
    assert readers.lines(spark, f"{raw}/customers.csv", header=True) == 3


def test_versions_and_upsert(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t")
    assert store.current("x") is None
    with pytest.raises(ValueError):
        store.read("x")
    store.write("x", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    store.upsert("x", spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), "id")
    assert sorted(map(tuple, store.read("x").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, store.read("x", 0).collect())) == [(1, "a"), (2, "b")]
    store.restore("x", 0)
    assert store.count("x") == 2
    store.append("x", spark.createDataFrame([(9, "z")], "id int, v string"))
    assert store.count("x") == 3 and store.history("x") == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        store.restore("x", 7)


def test_append_and_merge_write_what_changes(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(i, "a", f"k{i % 2}") for i in range(8)], "id int, v string, kind string").repartitionByRange(4, "id")
    store.write("x", rows, ["kind"])
    files = lambda: set(store._version("x")[0])
    first = files()
    store.append("x", spark.createDataFrame([("k0", 100, "new")], "kind string, id int, v string"))
    assert first < files() and len(files() - first) == 1  # old files stay as they are
    second = files()
    store.upsert("x", spark.createDataFrame([(1, "B", "k1"), (200, "c", "k9")], "id int, v string, kind string"), "id")
    held = {f for f in second if f not in files()}
    assert len(held) == 1 and next(iter(held)) in first  # one file held the key
    assert {r.id: (r.v, r.kind) for r in store.read("x").collect()} == {i: ("a", f"k{i % 2}") for i in range(8)} | {1: ("B", "k1"), 100: ("new", "k0"), 200: ("c", "k9")}
    assert store.count("x") == 10 and store.read("x", 0).count() == 8 and store.read("x").columns == ["id", "v", "kind"]
    store.write("x", rows.limit(0))
    assert store.count("x") == 0 and store.read("x").columns == ["id", "v", "kind"]


def test_two_writers(spark, tmp_path):
    """The second writer of a version finds it taken and goes on from it; no row is lost."""
    store = TableStore(spark, f"file://{tmp_path}/t")
    row = lambda i: spark.createDataFrame([(i,)], "id int")
    store.write("x", row(0))
    once, commit = [], store._commit

    def late(name, version, files, schema):
        if not once:
            once.append(TableStore(spark, store.root).append("x", row(1)))
        return commit(name, version, files, schema)

    store._commit = late
    assert store.append("x", row(2)) == 2
    assert sorted(r.id for r in store.read("x").collect()) == [0, 1, 2]


def test_csv_in_order(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "concat('a,', id) as text").repartition(7).orderBy("id")
    assert single_csv(spark, df, f"file://{tmp_path}", "out") == 5000
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[0] == "id,text" and lines[1:] == [f'{i},"a,{i}"' for i in range(5000)]
    assert single_csv(spark, df.limit(0), f"file://{tmp_path}", "out") == 0 and (tmp_path / "out.csv").read_text() == "id,text\n"


def test_split_train_score_gate(spark, tmp_path):
    rows = [(f"e{i}", int(i % 5 == 0), *[float((i * 7 + j) % 11) if j != 2 else float(i % 5 == 0) * 3 + (i % 3) * 0.1 for j in range(len(FEATURES))]) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id string, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    own = ml.split(df)
    sizes = {(r.label, r.is_test): r["count"] for r in own.groupBy("label", "is_test").count().collect()}
    assert sizes == {(0, True): 64, (0, False): 256, (1, True): 16, (1, False): 64}
    model = ml.train(own.where("not is_test"), ml.Params(trees=30, rate=0.3))
    found = ml.evaluate(ml.score(model, own.where("is_test")))
    assert ml.passes(found) and not ml.passes(found | {"f1": 0.8})
    store = TableStore(spark, f"file://{tmp_path}/m")
    ml.save(model, store, "fraud", own.where("is_test"), found)
    again = ml.score(ml.load(store, "fraud"), store.read("fraud/test"))
    assert abs(ml.evaluate(again)["roc_auc"] - found["roc_auc"]) < 1e-12
