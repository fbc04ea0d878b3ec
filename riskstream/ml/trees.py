"""Boosted trees over histograms, with second-order gains and missing values routed by the trees themselves.

Features are cut into bins at quantiles once, and rows kept as their bins, a byte a feature, in the shared folder.  For each
level of a tree one pass adds up the first and second derivatives of the logistic loss by node, feature and bin:
in numpy within a task, over tasks by Spark.  Sums are whole numbers of 2**-24, so they do not depend on how rows are
dealt.  The driver holds a histogram of each open node, never rows, and picks the best cut; rows whose value is missing go to
the side for which the gain is larger, and that side is kept with the cut.  Each `KEEP` trees the rows are written
again with their margin, so a pass looks at no more trees than that.

Rows are sampled for each tree by a hash of their content, columns by the seed.  Defined cases: null and NaN are missing; a
feature without values, or with one value only, is never cut; nodes without gain are leaves; without rows of both classes
there are no trees and every probability is the share of positives; labels other than 0 and 1 and null ones take no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.sources.shared import drop, written

BINS = 255  # of values; one more is for what is missing
#: Trees between two writings of the margins: every pass over the rows goes through those since the last.
KEEP = 2
_UNIT = float(1 << 24)


@dataclass(frozen=True)
class Params:
    # The settings that published figures come from.
    trees: int = 400
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    seed: int = 42
    #: Added to second derivatives, and the least sum of them on either side of a cut.
    ridge: float = 1.0
    least: float = 1.0
    #: Weight of positives; None evens the classes out.
    positive: float | None = None


@dataclass
class Tree:
    """Nodes of a full binary tree from the top: the feature that cuts a node (-1: none), its last bin on the left, whether what is missing goes left, and the leaf's value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where rows end."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[at]
            b = bins[row, np.maximum(f, 0)]
            left = np.where(b == BINS, self.left[at], b <= self.cut[at])
            at = np.where(f >= 0, 2 * at + np.where(left, 1, 2), at)
        return at


@dataclass
class Trees:
    """A model: names and bin edges of features, trees, and the margin of no tree."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """How many edges lie below each value; BINS for what is missing."""
        out = np.empty((len(columns[0]) if columns else 0, len(self.features)), np.uint8)
        for i, (x, edges) in enumerate(zip(columns, self.edges)):
            out[:, i] = np.where(np.isnan(x), BINS, np.searchsorted(edges, x, "left"))
        return out

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += tree.value[tree.nodes(bins)]
        return out

    def to_json(self) -> str:
        trees = [{k: v.tolist() for k, v in asdict(t).items()} for t in self.trees]
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "base": self.base, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        kinds = {"feature": np.int64, "cut": np.int64, "left": bool, "value": np.float64}
        return cls(d["features"], [np.array(e, np.float64) for e in d["edges"]], [Tree(**{k: np.array(t[k], kind) for k, kind in kinds.items()}) for t in d["trees"]], d["base"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def derivatives(margin: np.ndarray, label: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second ones of the weighted loss, in whole units."""
    p, w = sigmoid(margin), np.where(label == 1, positive, 1.0)
    return np.rint(w * (p - label) * _UNIT).astype(np.int64), np.rint(w * p * (1 - p) * _UNIT).astype(np.int64)


def sampled(key: np.ndarray, tree: int, p: Params) -> np.ndarray:
    """Which rows a tree sees: by a mix of the row's key and the tree's number."""
    with np.errstate(over="ignore"):
        h = (key.astype(np.uint64) + np.uint64((p.seed * 1_000_003 + tree + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < p.rows


def chosen(count: int, tree: int, p: Params) -> np.ndarray:
    """Which columns a tree sees."""
    n = max(1, round(count * p.columns))
    return np.sort(np.random.default_rng([p.seed, tree]).permutation(count)[:n])


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """Sums by node, feature and bin (missing last) of g and h, whole numbers."""
    out = np.zeros((2, nodes, bins.shape[1], BINS + 1), np.int64)
    for f in range(bins.shape[1]):
        place = node * (BINS + 1) + bins[:, f]
        for i, value in enumerate((g, h)):
            # sums of a slice are whole numbers below 2**53, so doubles hold them
            out[i, :, f] = np.bincount(place, value, nodes * (BINS + 1)).astype(np.int64).reshape(nodes, -1)
    return out


def best_cut(g: np.ndarray, h: np.ndarray, columns: np.ndarray, p: Params) -> tuple[float, int, int, bool, tuple[float, float], tuple[float, float]] | None:
    """(gain, feature, bin, missing left, (G, H) left, (G, H) right) of one node's sums by feature and bin; ties go to the first."""
    total_g, total_h = g[columns[0]].sum(), h[columns[0]].sum()
    score = lambda a, b: a * a / (b + p.ridge)
    best = None
    for f in columns:
        left_g, left_h = np.cumsum(g[f, :BINS])[:-1], np.cumsum(h[f, :BINS])[:-1]
        for missing_left in (True, False):
            a, b = (left_g + g[f, BINS], left_h + h[f, BINS]) if missing_left else (left_g, left_h)
            c, d = total_g - a, total_h - b
            gain = np.where((b >= p.least) & (d >= p.least), score(a, b) + score(c, d) - score(total_g, total_h), -np.inf)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (float(gain[i]), int(f), i, missing_left, (a[i], b[i]), (c[i], d[i]))
    return best


def grow(tree: Tree, level: int, sums: dict[int, np.ndarray], columns: np.ndarray, p: Params) -> None:
    """Cuts the open nodes of a level by their sums (g and h by feature and bin), and gives their children values."""
    for node, (g, h) in sorted(sums.items()):
        g, h = g / _UNIT, h / _UNIT
        if level == 0:
            tree.value[0] = -p.rate * g[columns[0]].sum() / (h[columns[0]].sum() + p.ridge)
        found = best_cut(g, h, columns, p)
        if found:
            _, tree.feature[node], tree.cut[node], tree.left[node], *sides = found
            for child, (a, b) in zip((2 * node + 1, 2 * node + 2), sides):
                tree.value[child] = -p.rate * a / (b + p.ridge)


def edges_of(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Distinct inner quantiles of each feature; the numbers of bins and features bound what the driver gets."""
    at = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    value = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    row = df.agg(*(F.percentile_approx(v, at, F.lit(10_000)).alias(f"q{i}") for i, v in enumerate(value.values()))).first()
    return [np.unique(np.array(q or [], np.float64)) for q in row]


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def train(df: DataFrame, features: Sequence[str], p: Params = Params(), label: str = "label") -> Trees:
    """Trees for label (0 or 1) from the features, numbers or flags, of df."""
    own = df.where(F.col(label).isin(0, 1)).select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("int").alias("_label"))
    n = own.agg(F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") == 0)).first()
    if not n[0] or not n[1]:
        share = n[0] / max(1, n[0] + n[1])
        return Trees(list(features), [np.zeros(0)] * len(features), base=500.0 if share == 1 else -500.0)
    positive = p.positive if p.positive is not None else n[1] / n[0]
    model = Trees(list(features), edges_of(own, features))
    spark, names = df.sparkSession, list(features)

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = model.bins(_columns(batch, names))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.zeros(len(rows)))], ["key", "label", "bins", "margin"])

    keyed = own.withColumn("_key", F.xxhash64(*names, "_label"))
    table, held = written(keyed.mapInArrow(binned, "key long, label int, bins binary, margin double"), "binned"), 0
    for number in range(p.trees):
        tree, columns, open_ = Tree.empty(p.depth), chosen(len(names), number, p), [0]
        for level in range(p.depth):
            sums = _sums(table, model, held, tree, number, open_, positive, p)
            grow(tree, level, sums, columns, p)
            open_ = [c for node in open_ if tree.feature[node] >= 0 for c in (2 * node + 1, 2 * node + 2)]
            if not open_:
                break
        model.trees.append(tree)
        if len(model.trees) - held == KEEP and number + 1 < p.trees:
            after = written(_moved(table, model, held), "binned")
            drop(spark, table)
            table, held = after, len(model.trees)
    drop(spark, table)
    return model


def _slices(batches: Iterable[pa.RecordBatch], count: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            batch = whole.slice(at, 8192)
            yield batch, np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, count), batch.column("margin").to_numpy()


def _moved(table: DataFrame, model: Trees, held: int) -> DataFrame:
    """The rows with the margins of trees since they were written."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bins, margin in _slices(batches, len(model.features)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin + model.margin(bins, held))], ["key", "label", "bins", "margin"])

    return table.mapInArrow(rows, table.schema)


def _sums(table: DataFrame, model: Trees, held: int, tree: Tree, number: int, open_: list[int], positive: float, p: Params) -> dict[int, np.ndarray]:
    """Of each open node the sums of g and h by feature and bin."""
    count = len(model.features)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[open_] = np.arange(len(open_))
        out = np.zeros((2, len(open_), count, BINS + 1), np.int64)
        for batch, bins, margin in _slices(batches, count):
            node = place[tree.nodes(bins)]
            seen = np.flatnonzero((node >= 0) & sampled(batch.column("key").to_numpy(), number, p))
            g, h = derivatives((margin + model.margin(bins, held))[seen], batch.column("label").to_numpy()[seen], positive)
            out += histogram(bins[seen], node[seen], g, h, len(open_))
        at = np.flatnonzero((out[0] != 0).ravel() | (out[1] != 0).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[0].ravel()[at]), pa.array(out[1].ravel()[at])], ["at", "g", "h"])

    # at most a row for each open node, feature and bin
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("double")
    found = table.mapInArrow(rows, "at long, g long, h long").groupBy("at").agg(total("g").alias("g"), total("h").alias("h")).toArrow()
    out = np.zeros((2, len(open_) * count * (BINS + 1)))
    for i, c in enumerate(("g", "h")):
        out[i, found.column("at").to_numpy()] = found.column(c).to_numpy()
    out = out.reshape(2, len(open_), count, BINS + 1)
    return {node: out[:, i] for i, node in enumerate(open_)}


def score(model: Trees, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with fraud_probability and fraud_prediction; works on static tables and on streams."""
    sent, names = df.sparkSession.sparkContext.broadcast(model), model.features
    keep = [c for c in df.columns if c not in ("fraud_probability", "fraud_prediction")]
    own = df.select(*keep, *(F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(names)))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "fraud_probability double, fraud_prediction int"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = sigmoid(m.base + m.margin(m.bins(_columns(batch, [f"_f{i}" for i in range(len(names))]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "fraud_probability", "fraud_prediction"])

    return own.mapInArrow(rows, schema)


def save(df: DataFrame, model: Trees, path: str) -> None:
    """The model as one JSON file, by the file system of its path."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(model.to_json().encode()))
    out.close()


def load(df: DataFrame, path: str) -> Trees:
    return Trees.from_json(df.sparkSession.read.option("wholetext", True).text(path).first()[0])
