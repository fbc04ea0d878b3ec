"""Boosted trees against a plain loop over rows, and their figures beside Spark's own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.ml import trees
from riskstream.operators import metrics

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    out = []
    for i in range(2000):
        a, b, c = r.gauss(0, 1), r.randrange(4), r.random()
        # whether c is missing tells something
        hidden = r.random() < (0.7 if a > 0.5 else 0.1)
        out.append((i, a, float(b), None if hidden else c, None if r.random() < 0.2 else 1.0, int(r.random() < 1 / (1 + np.exp(2 - 3 * hidden - a - (b == 2))))))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int").cache()


def plain(x, y, key, edges, p):
    """The same trees, one node at a time, from the rows themselves."""
    bins = trees.Trees(NAMES, edges).bins([x[:, i] for i in range(x.shape[1])])
    margin, out = np.zeros(len(y)), []
    positive = (y == 0).sum() / (y == 1).sum()
    for number in range(p.trees):
        w = np.where(y == 1, positive, 1.0)
        q = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (q - y) * 2**24) / 2**24, np.rint(w * q * (1 - q) * 2**24) / 2**24
        seen = trees.sampled(key, number, p)
        columns = trees.chosen(len(NAMES), number, p)
        nodes = {}

        def cut(node, own, level):
            total = (g[own].sum(), h[own].sum())
            nodes[node] = ("leaf", -p.rate * total[0] / (total[1] + p.ridge))
            best = (1e-9,)
            for f in columns if level < p.depth else ():
                for b in range(254):
                    if not (bins[own, f] == b).any():
                        continue  # the same cut as the one before
                    for missing in (True, False):
                        left = np.where(bins[own, f] == 255, missing, bins[own, f] <= b)
                        sides = [(g[own[s]].sum(), h[own[s]].sum()) for s in (left, ~left)]
                        if min(s[1] for s in sides) >= p.least:
                            gain = sum(a * a / (c + p.ridge) for a, c in sides) - total[0] ** 2 / (total[1] + p.ridge)
                            if gain > best[0] + 1e-12:
                                best = (gain, f, b, missing, own[left], own[~left])
            if len(best) > 1:
                nodes[node] = ("cut", *best[1:4])
                cut(2 * node + 1, best[4], level + 1)
                cut(2 * node + 2, best[5], level + 1)

        cut(0, np.flatnonzero(seen), 0)
        for i in range(len(y)):
            node = 0
            while nodes[node][0] == "cut":
                _, f, b, missing = nodes[node]
                node = 2 * node + (1 if (missing if bins[i, f] == 255 else bins[i, f] <= b) else 2)
            margin[i] += nodes[node][1]
        out.append(nodes)
    return 1 / (1 + np.exp(-margin))


def test_equal_to_plain_version(table, rows, monkeypatch):
    p = trees.Params(trees=5, depth=3, rate=0.3)
    monkeypatch.setattr(trees, "KEEP", 2)
    model = trees.train(table, NAMES, p)
    x = np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows])
    key = np.array([r.k for r in table.orderBy("id").select(F.xxhash64(*NAMES, "label").alias("k")).collect()])
    expected = plain(x, np.array([r[5] for r in rows]), key, model.edges, p)
    got = np.array([r.fraud_probability for r in trees.score(model, table).orderBy("id").collect()])
    assert np.abs(got - expected).max() < 1e-9
    again = trees.train(table.repartition(7), NAMES, p)
    assert [t.value.tolist() for t in again.trees] == [t.value.tolist() for t in model.trees] or [e.tolist() for e in again.edges] != [e.tolist() for e in model.edges]
    # values are routed where they are missing: both sides occur
    cut = [t.left[t.feature == NAMES.index("c")].tolist() for t in model.trees]
    assert any(cut)


def test_figures(table, tmp_path):
    model = trees.train(table.where("id % 4 > 0"), NAMES, trees.Params(trees=25, depth=3, rate=0.2))
    scored = trees.score(model, table.where("id % 4 = 0")).withColumnRenamed("fraud_probability", "score")
    assert metrics.roc_auc(scored).first()[0] > 0.75
    trees.save(table, model, f"file://{tmp_path}/model.json")
    again = trees.score(trees.load(table, f"file://{tmp_path}/model.json"), table.where("id % 4 = 0"))
    assert sorted((r.id, r.fraud_probability) for r in again.collect()) == sorted((r.id, r.score) for r in scored.collect())


def test_odd_tables(spark, table):
    one = trees.train(table.where("label = 1"), NAMES)
    assert not one.trees and {r.fraud_prediction for r in trees.score(one, table).collect()} == {1}
    assert {r.fraud_prediction for r in trees.score(trees.train(table.limit(0), NAMES), table).collect()} == {0}
    nothing = spark.createDataFrame([(None, float("nan"), None, 1.0, i % 2) for i in range(40)] + [(None, None, None, None, None)], "a double, b double, c double, d double, label int")
    model = trees.train(nothing, NAMES, trees.Params(trees=2, depth=2, rows=1.0))
    assert all(t.feature[0] == -1 for t in model.trees) and trees.score(model, nothing).count() == 41
    assert trees.score(model, nothing.limit(0)).count() == 0
