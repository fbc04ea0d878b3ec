"""k-means on integer vectors with Elkan's bounds: the result of comparing every vector with every centroid, for fewer comparisons.

Components are scaled and floored to integers, so distances, sums and new centroids are exact, whatever the order
they are added in.  Each vector carries its cluster, an upper bound of the distance to its own centroid and a lower one to
each other.  When centroids move, bounds move with them; a centroid is looked at only if neither its lower bound nor
half of its distance to the vector's own centroid lies strictly above the upper bound, so a tie
is never cut off.  Bounds are rounded away from the truth: upper ones up, lower ones down, to the two leading
bytes of a float when they are stored.  What is looked at is settled by exact squared distances.

A round is one pass: rows are read with their bounds, assigned, and written again to the shared folder with
them, and each task adds up its clusters, a row for each cluster and component, which are added up by Spark.  Only
these sums (`k` times the components) go through the driver, which makes the next centroids of them.  Tables
of rounds before are removed.

Defined cases: vectors of another length, null ones and those with a null or non-finite component take no part, nor do
those with a component beyond 2**27 after scaling, whose squared distances no long could hold; repeated rows count each;
a row without an id is assigned, but never a first centroid; with fewer vectors than centroids there are as many
centroids as vectors with an id, and without any no rows; an empty cluster stays where it is; an
inertia that no long can hold is null; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import drop, written

CENTROIDS = 40
COMPONENTS = 64
ROUNDS = 5
SCALE = 256
SEED = 2
#: Largest magnitude of a component, so that a squared distance of so many components stays below 2**63.
MOST = 1 << 27
#: Squared distances are summed as their parts above and below so many bits.
HALF = 32
#: Vectors assigned at a time.
SLICE = 4096
_SURE = 1e-12  # far above what doubles lose in a few steps
_ROWS = "kind int, vec_id long, vector binary, cluster int, upper double, lower binary, distance long, at int, total long, n long"
_SCHEMA = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("distance", pa.int64()), ("at", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


def stored_lower(bounds: np.ndarray) -> np.ndarray:
    """The two leading bytes of each bound as a float: cut off, so never above it."""
    own = bounds.astype(np.float32)
    own = np.where(own > bounds, np.nextafter(own, np.float32(0)), own)
    return (own.view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def read_lower(stored: np.ndarray) -> np.ndarray:
    return (stored.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Centroids:
    """Centroids as integers, the bounds of half the distances between them, and of how far each has moved."""

    at: np.ndarray
    half: np.ndarray  # never above the truth
    moved: np.ndarray  # never below it

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        between = np.stack([squared(at, c) for c in at])
        moved = np.zeros(len(at)) if before is None else np.sqrt(squared(at, before).astype(np.float64)) * (1 + _SURE)
        return cls(at, np.sqrt(between.astype(np.float64)) / 2 * (1 - _SURE), moved)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper and lower bounds of vectors that had own, upper and lower before centroids moved, and how many distances were computed."""
    k, rows = len(c.at), np.arange(len(x))
    upper = (upper + c.moved[own]) * (1 + _SURE)
    lower = np.maximum((lower - c.moved) * (1 - _SURE), 0)
    own, computed = own.copy(), 0
    maybe = ~((lower > upper[:, None]) | (c.half[own] > upper[:, None]))
    maybe[rows, own] = False
    some = np.flatnonzero(maybe.any(1))
    if not len(some):
        return own, upper, lower, computed
    # the exact distance to the own centroid, and with it a second look at the bounds
    best = squared_to(x[some], c.at, own[some])
    computed += len(some)
    exact = np.sqrt(best.astype(np.float64))
    upper[some] = exact * (1 + _SURE)
    lower[some, own[some]] = exact * (1 - _SURE)
    place = np.full(len(x), -1)
    place[some] = np.arange(len(some))
    maybe &= ~((lower > upper[:, None]) | (c.half[own] > upper[:, None]))
    for j in range(k):
        # the own centroid may have become another on the way, from which j may be far enough
        look = np.flatnonzero(maybe[:, j])
        look = look[c.half[own[look], j] <= upper[look]]
        look = look[lower[look, j] <= upper[look]]
        if not len(look):
            continue
        d = squared(x[look], c.at[j])
        computed += len(look)
        exact = np.sqrt(d.astype(np.float64))
        lower[look, j] = exact * (1 - _SURE)
        held = best[place[look]]
        nearer = (d < held) | ((d == held) & (j < own[look]))
        to = look[nearer]
        best[place[to]] = d[nearer]
        own[to] = j
        upper[to] = exact[nearer] * (1 + _SURE)
    return own, upper, lower, computed


def squared_to(x: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> np.ndarray:
    gap = x - centroids[own]
    return np.einsum("ij,ij->i", gap, gap)


def _kept(scale: int, components: int):
    """Vectors that take part, as the bytes of integers."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), components), False))
                # nulls become NaN
                x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components))
                part = np.isfinite(x).all(1) & (np.abs(x) <= MOST).all(1)
                ids = batch.column(0).filter(pa.array(part))
                yield pa.RecordBatch.from_arrays([ids, _binary(x[part].astype("<i4"))], ["vec_id", "vector"])

    return rows


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _add(sums: np.ndarray, own: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to the sums of their clusters."""
    if len(own):
        order = np.argsort(own, kind="stable")
        some, first = np.unique(own[order], return_index=True)
        sums[some] += np.add.reduceat(rows[order], first)


def _batch(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _round(sent, components: int, last: bool):
    """Rows with new clusters and bounds (kind 0; the last time with distances instead), and at the end of a task its sums (kind 1)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Centroids = sent.value
        k = len(c.at)
        total, n = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        inertia = np.zeros((k, 2), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = _matrix(batch.column("vector"), "<i4", components).astype(np.int64)
                if "cluster" in batch.schema.names:
                    own, upper = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy()
                    lower = read_lower(_matrix(batch.column("lower"), "<u2", k))
                else:
                    # nothing is known yet, but for the distance to the first
                    own, lower = np.zeros(len(x), np.int64), np.zeros((len(x), k))
                    upper = np.full(len(x), np.inf)
                own, upper, lower, _ = assign(x, own, upper, lower, c)
                n += np.bincount(own, minlength=k)
                out = {"kind": pa.array(np.zeros(len(x), np.int32)), "vec_id": batch.column("vec_id"), "cluster": pa.array(own, pa.int32())}
                if last:
                    d = squared_to(x, c.at, own)
                    _add(inertia, own, np.stack([d >> HALF, d & ((1 << HALF) - 1)], 1))
                    out["distance"] = pa.array(d)
                else:
                    _add(total, own, x)
                    out |= {"vector": batch.column("vector"), "upper": pa.array(upper), "lower": _binary(stored_lower(lower))}
                yield _batch(len(x), **out)
        sums = inertia if last else total
        if n.any():
            cluster, place = np.divmod(np.arange(sums.size), sums.shape[1])
            yield _batch(sums.size, kind=pa.array(np.ones(sums.size, np.int32)), cluster=pa.array(cluster, pa.int32()), at=pa.array(place, pa.int32()), total=pa.array(sums.ravel()), n=pa.array(n[cluster]))

    return rows


def clusters(table: DataFrame, k: int = CENTROIDS, components: int = COMPONENTS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of table(vec_id, embedding) that takes part.

    First centroids are the vectors whose ids, hashed with the seed, come first.
    """
    spark = table.sparkSession
    kept = written(table.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_kept(scale, components), "vec_id long, vector binary"), "integers")
    first = kept.where(F.col("vec_id").isNotNull()).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "vector").limit(k).select("vector").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = np.frombuffer(b"".join(bytes(r.vector) for r in first), "<i4").reshape(-1, components).astype(np.int64)
    before, state = None, kept
    for turn in range(rounds + 1):
        last = turn == rounds
        sent = spark.sparkContext.broadcast(Centroids.of(at, before))
        after = written(state.mapInArrow(_round(sent, components, last), _ROWS), "clusters", by="kind")
        drop(spark, state)
        # exact beyond 64 bits, however many vectors there are; k times components rows, whatever the table
        sums = after.where("kind = 1").groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")), F.sum("n")).collect()
        state = after.where("kind = 0").select("vec_id", "cluster", "distance") if last else after.where("kind = 0").select("vec_id", "vector", "cluster", "upper", "lower")
        if not last:
            before, at = at, at.copy()
            for cluster, place, total, n in sums:
                if n:
                    at[cluster, place] = int(total) // n
    inertia = dict.fromkeys(range(len(at)), 0)
    for cluster, place, total, _ in sums:
        inertia[cluster] += int(total) << (HALF if place == 0 else 0)
    long_ = lambda n: n if n < 1 << 63 else None
    rows = [(i, long_(inertia[i]), long_(sum(inertia.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(at)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
