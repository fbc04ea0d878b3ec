"""Approximate nearest neighbours by cosine, from shifted space-filling curves.

Distinct vectors are projected to `DIMENSIONS` coordinates, `CURVES` times by
different random rotations.  Each projection is squashed to a box, shifted by a random
offset, put on a grid and ordered along a Hilbert curve: a curve keeps near points
near except where it turns away, and shifts and rotations move those places.  Spark
range-partitions each curve's keys, which gives every vector its rank there.  A query's candidates
are those within `window` ranks of it on some curve.  They meet by a grouping on blocks of
ranks, cut to the window, and each is scored on the first curve whose window holds it only (vectors carry their
ranks on the curves before), by the exact cosine in double precision; a query's best of each block
go on to be merged.

The window is fitted: for up to `SAMPLE` queries the true neighbours are found
by brute force, and it is the least at which `RECALL` of them lie in some
curve's window.  On clustered vectors that is a few ranks; on vectors without structure
it is a share of the table.  The way is the same at every size.
Centre and scale of projections come from `SAMPLE` times 32 vectors. Every vector is
indexed and every query searched.

Equal vectors are one entry, with the k + 1 smallest ids, which are all that an answer
can name, and queries with equal vectors are asked once; so a vector may make up any
share of the rows.  Lists of ids are cut to that length before they are shuffled.

Defined cases: null, zero or non-finite vectors, or those holding a null, take no part; doubles are first scaled by a
power of two, which changes no cosine, so that no square overflows or vanishes; a
vector of fewer components than the longest counts as padded with zeros; fewer than k others give all
of them; ties go to the smaller id; a null id takes no part; repeated rows
of one id are one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskstream.llm.common import written

CURVES = 24
DIMENSIONS = 8
BITS = 5
BLOCK = 2048
SAMPLE = 256
RECALL = 0.95
#: Queries of one block that one task takes; more are dealt to several.
ASKED = 20_000


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with integer coordinates below 2**bits (Skilling's transposition)."""
    x = grid.astype(np.uint32).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            on = (x[:, i] & np.uint32(q)) > 0
            swap = np.where(on, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, n - 1] & np.uint32(q)) > 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return key


class Curves:
    """Rotations and offsets, and the centre and scale of each projection in a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits = bits
        m = min(dimensions, d)
        self.rotation = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m] for _ in range(curves)]
        self.offset = rng.random((curves, m)) / 2
        self.centre = [(sample @ r).mean(0) for r in self.rotation]
        self.scale = [np.maximum((sample @ r).std(0), 1e-9) for r in self.rotation]

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for r, o, c, s in zip(self.rotation, self.offset, self.centre, self.scale):
            u = 1 / (1 + np.exp(np.clip(-1.7 * (unit @ r - c) / s, -30, 30)))
            out.append(hilbert(np.minimum((u / 2 + o) * (1 << self.bits), (1 << self.bits) - 1), self.bits))
        return out


def _vectors(cells: Iterable[bytes], kind: str, size: int) -> np.ndarray:
    """Vectors of size bytes as doubles; they travel as wide and long as they came."""
    cells = [c.ljust(size, b"\0") for c in cells]
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def _valid(kind: str):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, kind) + np.zeros(1, kind)  # no negative zero
                most = np.abs(x).max()
                if np.isfinite(most) and most > 0:
                    if kind == "f8":
                        x = np.ldexp(x, -np.frexp(most)[1])
                    ids.append(i)
                    cells.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.binary())], ["vec_id", "vector"])

    return rows


def _merged(most: int):
    """Equal vectors within a batch, with their smallest ids."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array([sorted(set(x))[:most] for x in ids.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    return rows


def _best(k: int, queries: np.ndarray, names: np.ndarray, x: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Rows asked, entry and score bits: the k best entries of each query, ties to the smaller. allowed: which pairs count."""
    out: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    order = np.argsort(entries, kind="stable")
    x, entries = x[order], entries[order]
    for at in range(0, len(queries), 512):
        score = cosine(queries[at : at + 512], x)
        if allowed is not None:
            score[~allowed[at : at + 512, order]] = -np.inf
        best = np.argsort(-score, 1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(score)), best.shape[1])
        one = np.stack([names[at + rows], entries[best.ravel()], score[rows, best.ravel()].view(np.int64)])
        out.append(one[:, score[rows, best.ravel()] > -np.inf])
    return np.concatenate(out, 1)


def _found(table: np.ndarray) -> pa.Table:
    return pa.table({"asked": pa.array(table[0]), "entry": pa.array(table[1]), "score": pa.array(np.ascontiguousarray(table[2]).view(np.float64))})


_FOUND = "asked long, entry long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "entry")))
    return ranked.where(F.col("place") <= k).drop("place")


def nearest(table: DataFrame, every: int, k: int, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of table(vec_id, embedding) whose vec_id is divisible by every."""
    spark = table.sparkSession
    kind = "f4" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    valid = table.select("vec_id", "embedding").mapInArrow(_valid(kind), "vec_id long, vector binary")
    size = valid.agg(F.max(F.octet_length("vector"))).first()[0]
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = valid.mapInArrow(_merged(k + 1), "vector binary, ids array<long>").groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    entries = lists.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))
    entries = written(entries.select(F.col("ids")[0].alias("entry"), "vector", "ids"), "vectors")
    queries = written(valid.where(F.col("vec_id") % every == 0).distinct().join(entries.select("vector", "entry"), "vector").select(F.col("vec_id").alias("query_id"), "entry"), "queries")
    asked = queries.groupBy("entry").agg(F.lit(True).alias("asked"))

    sample = entries.orderBy(F.xxhash64("entry")).limit(32 * SAMPLE).select("vector").toArrow().column(0).to_pylist()
    sent = spark.sparkContext.broadcast(Curves(_unit(_vectors(sample, kind, size)), curves, dimensions, bits))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keys = sent.value.keys(_unit(_vectors(batch.column(1).to_pylist(), kind, size)))
                n = batch.num_rows
                again = pa.array(np.tile(np.arange(n), len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(keys)), n), pa.int32()), pa.array(np.concatenate(keys)), batch.column(0).take(again)], ["curve", "key", "entry"])

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(0).to_numpy()
            at = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                at[own] = seen.get(c, 0) + np.arange(len(own))
                seen[c] = seen.get(c, 0) + len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(len(curve), part, np.int32)), pa.array(at)], ["curve", "entry", "part", "at"])

    # keys are sorted without the vectors, which would be shuffled once more for every curve
    keyed = entries.select("entry", "vector").mapInArrow(place, "curve int, key long, entry long")
    ordered = keyed.repartitionByRange("curve", "key", "entry").sortWithinPartitions("curve", "key", "entry")
    ordered = written(ordered.mapInArrow(numbered, "curve int, entry long, part int, at long"), "curves")
    # one row for each partition and the curves it touches
    counts = sorted(map(tuple, ordered.groupBy("curve", "part").count().collect()))
    before, starts = {}, []
    for curve, part, n in counts:
        starts.append((curve, part, before.get(curve, 0)))
        before[curve] = before.get(curve, 0) + n
    starts = spark.createDataFrame(starts, "curve int, part int, before long")
    ranked = ordered.join(F.broadcast(starts), ["curve", "part"]).select("curve", "entry", (F.col("before") + F.col("at")).alias("rank"))
    n = max(before.values())

    marked = entries.select("entry", "vector").join(asked, "entry", "left").select("entry", "vector", F.coalesce("asked", F.lit(False)).alias("asked"))
    window = _window(spark, marked, ranked, n, k, recall, kind, size)
    copies = max(1, -(-(2 * window + block) // (every * ASKED)))
    # a vector goes to its own block on each curve, and as a query to all blocks that its window touches, with its ranks so far
    of = F.floor(F.col("rank") / block)
    have = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda copy: F.struct(of.alias("block"), copy.alias("copy"), F.lit(False).alias("asked")))
    reach = F.sequence(F.greatest(F.floor((F.col("rank") - window) / block), F.lit(0)), F.least(F.floor((F.col("rank") + window) / block), F.lit((n - 1) // block)))
    own_copy = F.pmod(F.xxhash64("entry"), F.lit(copies)).cast("int")
    want = F.transform(reach, lambda b: F.struct(b.alias("block"), own_copy.alias("copy"), F.lit(True).alias("asked")))
    places = ranked.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("curve", "rank"))), lambda p: p["rank"]).alias("ranks"))
    dealt = marked.join(places, "entry").select("entry", "vector", F.col("asked").alias("query"), "ranks", F.posexplode("ranks").alias("curve", "rank"))
    dealt = dealt.select("entry", "vector", "query", "curve", "rank", F.expr("slice(ranks, 1, curve + 1)").alias("ranks"))
    both = dealt.select("entry", "vector", "curve", "ranks", F.explode(F.when(F.col("query"), F.concat(have, want)).otherwise(have)).alias("t")).select("entry", "vector", "curve", "ranks", "t.*")

    def meet(both: pa.Table) -> pa.Table:
        curve = both.column("curve")[0].as_py()
        ranks = both.column("ranks").combine_chunks().flatten().to_numpy().reshape(-1, curve + 1)
        ask, names = both.column("asked").to_numpy(), both.column("entry").to_numpy()
        order = np.argsort(ranks[:, curve], kind="stable")
        one, two = order[ask[order]], order[~ask[order]]
        vectors = both.column("vector").to_pylist()
        x = _vectors((vectors[i] for i in two), kind, size)
        at = ranks[two, curve]
        out = [np.zeros((3, 0), np.int64)]
        i = 0
        while i < len(one) and len(two):
            # queries that stand within a window of each other
            j = min(i + 512, i + int(np.searchsorted(ranks[one[i:], curve], ranks[one[i], curve] + window, "right")))
            some = one[i:j]
            lo, hi = np.searchsorted(at, ranks[some[0], curve] - window), np.searchsorted(at, ranks[some[-1], curve] + window, "right")
            allowed = np.abs(ranks[some, curve][:, None] - at[None, lo:hi]) <= window
            for c in range(curve):
                allowed &= np.abs(ranks[some, c][:, None] - ranks[two[lo:hi], c][None]) > window
            here = np.flatnonzero(allowed.any(0))
            if len(here):
                out.append(_best(k + 1, _vectors((vectors[q] for q in some), kind, size), names[some], x[lo:hi][here], names[two[lo:hi]][here], allowed[:, here]))
            i = j
        return _found(np.concatenate(out, 1))

    found = _top(both.groupBy("curve", "block", "copy").applyInArrow(meet, _FOUND), k + 1)
    named = found.join(entries.select("entry", "ids"), "entry").select("asked", "score", F.explode("ids").alias("vec_id"))
    answers = named.join(queries.select("query_id", F.col("entry").alias("asked")), "asked").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _window(spark, marked: DataFrame, ranked: DataFrame, n: int, k: int, recall: float, kind: str, size: int) -> int:
    """The least width that would have found `recall` of the true neighbours of a sample of queries."""
    chosen = marked.where("asked").orderBy(F.xxhash64("entry")).limit(SAMPLE).select("entry", "vector").toArrow()
    if not chosen.num_rows:
        return 1
    sent = spark.sparkContext.broadcast((chosen.column(0).to_numpy(), _vectors(chosen.column(1).to_pylist(), kind, size)))

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = sent.value
        for batch in batches:
            if batch.num_rows:
                yield from _found(_best(k + 1, x, names, _vectors(batch.column(1).to_pylist(), kind, size), batch.column(0).to_numpy())).to_batches()

    true = _top(marked.select("entry", "vector").mapInArrow(brute, _FOUND), k + 1).where("asked <> entry").toPandas()
    true = true.sort_values(["asked", "score", "entry"], ascending=[True, False, True]).groupby("asked").head(k)
    if not len(true):
        return 1
    ids = sorted(set(true["asked"]) | set(true["entry"]))
    some = spark.createDataFrame([(int(i),) for i in ids], "entry long")
    at = ranked.select("curve", "entry", "rank").join(F.broadcast(some), "entry").toPandas().pivot(index="entry", columns="curve", values="rank")
    need = (at.loc[true["asked"]].to_numpy() - at.loc[true["entry"]].to_numpy()).__abs__().min(1)
    return int(min(n, np.quantile(need, recall, method="higher") + 1))
