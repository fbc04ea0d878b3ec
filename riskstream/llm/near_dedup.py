"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct word shingles.  Equal sets are one entry from the
start, known by a fingerprint, so exact copies never meet one another.  A tree orders entries by
MinHash values of its own; the forest is the sorted orders of all trees, range-partitioned, where
neighbours with the longest common prefixes stand side by side.  Runs in which neighbours have the
first `DEPTH` values in common are regions; all entries that share them with no neighbour, almost all,
are gone after that one pass.  There are as many trees as it takes for two sets at
the limit to fall together in none with a probability of `MISS` or less, which is
(1 - s**6)**n: 25 trees for 0.85, 38 for 0.8; more alike sets are missed far more seldom.  Depth adapts: entries of a
region with more than `REGION` of them stand in the same orders once more, lengthened by `DEPTH`
values, and in as many more trees (76, 209, ... in all for 0.85; 162, 634, ... for 0.8) as keep the
same bound at that depth, until regions are small.  No two trees share a value, so
each depth by itself misses a pair at the limit with `MISS` or less (`LEVELS` times `MISS` for a pair that goes
through all).  What still stands together in `LEVELS` times `DEPTH` equal values is
chained to its first.
Regions with the same entries in several trees are looked at once.

Inside a region, neighbours in the tree's order come first and then whatever is not
connected yet: pairs whose signatures agree in `AGREE` of their values (4.5 standard
deviations below the expectation at the limit) connect, and a region emits a
spanning forest of at most its size, never all pairs.  The connected components of
that are clusters of which only the sets are fetched.  Within a cluster, sets are
compared exactly, by counts of common shingles, until every pair of different
components is known to have no link.  Clusters above `CLUSTER` shingles are compared region by region instead, so
that a set is fetched as often as it has regions and not once for every other part of its cluster; a region above that, or a
cluster around a region that stayed too large, is cut into blocks and compared block by block.  Exact links make the components of the result.

Shingles are known by 64-bit hashes and sets by 128 bits.  Defined cases: a document
without words or text has an empty set and is linked with nothing; with fewer words
than a shingle has, its whole sequence is one shingle; a null doc_id is linked with nothing, has no
component and is kept; repeated rows each give a row, and rows of one id with different texts are different sets under
one id; a text of any length is worked on whole; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import mix, pieces, sieved, spans_hash, words, written
from riskstream.llm.components import components
from riskstream.llm.language_model import pack, unpack

WORDS = 5
SIMILAR = 80  # per cent
DEPTH = 6
MISS = 1e-5
LEVELS = 4
REGION = 4096
CLUSTER = 1_000_000
_ROW = "_near_dedup_row"


def trees_for(similar: int, depth: int = DEPTH) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (similar / 100) ** depth))


def values_for(similar: int) -> int:
    """Length of signatures: a prime, so that every stride around them passes all values."""
    n = trees_for(similar) * DEPTH
    while any(n % i == 0 for i in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _orders(similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of each tree's values, trees x values: the first forest's are those of signatures, and the same orders go on at every depth."""
    trees, depth = trees_for(similar, DEPTH * LEVELS), DEPTH * LEVELS
    seeds = np.random.Generator(np.random.PCG64(29)).integers(1, 1 << 63, (2, trees, depth), np.uint64)
    mul, add = seeds[0] * np.uint64(2) + np.uint64(1), seeds[1]
    first = trees_for(similar)
    for out, own in zip((mul, add), _seeds(values_for(similar))):
        out[:first, :DEPTH] = own[: first * DEPTH].reshape(first, DEPTH)
    return mul, add


def paths(grams: np.ndarray, bounds: np.ndarray, level: int, similar: int) -> np.ndarray:
    """Bytes of the values by which the trees of a forest order sets that are not empty: sets x trees x values."""
    depth = DEPTH * (level + 1)
    trees = trees_for(similar, depth)
    start = bounds[:-1][np.diff(bounds) > 0]
    mul, add = _orders(similar)
    out = np.empty((len(start), trees, depth), np.uint8)
    if len(start):
        for tree in range(trees):
            for j in range(depth):
                out[:, tree, j] = mix(np.minimum.reduceat(grams * mul[tree, j] + add[tree, j], start)) & np.uint64(255)
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, (2, n), np.uint64)
    return seeds[0] * np.uint64(2) + np.uint64(1), seeds[1]


def agreement(similar: int) -> int:
    p, n = similar / 100, values_for(similar)
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another, and their bounds."""
    w = words(texts, lower=True)
    grams, bounds = w.grams(k)
    count = np.diff(w.first)
    doc = np.repeat(np.arange(len(count)), np.diff(bounds))
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        grams = np.concatenate([grams, spans_hash(w.hash, w.first[few], w.first[few + 1])])
        doc = np.concatenate([doc, few])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(doc):
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(count) + 1))


def _signed(k: int, similar: int):
    values = values_for(similar)
    mul, add = _seeds(values)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            grams, bounds = sets(batch.column(1), k)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            one, two = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            signature = np.zeros((len(n), values), np.uint8)
            if len(some):
                start = bounds[some]
                one[some] = np.add.reduceat(grams, start).view(np.int64)
                two[some] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), start).view(np.int64)
                for j in range(values):
                    signature[some, j] = (mix(np.minimum.reduceat(grams * mul[j] + add[j], start)) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(one), pa.array(two), pa.array([r.tobytes() for r in signature], pa.binary())],
                ["doc_id", "row", "n_shingles", "one", "two", "signature"],
            )

    return rows


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each element's set after joining a with b."""
    parent = np.arange(n) if parent is None else parent
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


_EDGE = "a long, b long"


def _edges(ids: np.ndarray, root: np.ndarray) -> pa.Table:
    """Each element with the smallest id of its set: a star, mostly the same one in whatever order and company a set is found again."""
    least = np.full(len(root), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    own = np.flatnonzero(least[root] != ids)
    return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(least[root[own]], pa.int64())})


def _region(least: int):
    def compare(table: pa.Table) -> pa.Table:
        """Neighbours in the tree's order first, then each entry outside the largest set against all others."""
        ids = table.column("entry").to_numpy()
        tree = table.column("tree")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.lexsort(np.roll(sig, -tree * DEPTH, 1)[:, ::-1].T)
        ids, sig = ids[order], sig[order]
        n = len(ids)
        near = np.flatnonzero((sig[1:] == sig[:-1]).sum(1) >= least)
        root = _roots(n, near, near + 1)
        return _edges(ids, _settled(n, root, lambda i: (sig == sig[i]).sum(1) >= least))

    return compare


def _settled(n: int, root: np.ndarray, links) -> np.ndarray:
    """Joins what links(i) finds until no two sets can be linked: all elements outside the largest set have been looked at."""
    done = np.zeros(n, bool)
    while True:
        size = np.bincount(root, minlength=n)
        left = np.flatnonzero(~done & (root != size.argmax()))
        if not len(left):
            return root
        i = left[0]
        done[i] = True
        found = np.flatnonzero(links(i))
        if (root[found] != root[i]).any():
            root = _roots(n, np.full(len(found), i), found, root)


def _linked(similar: int):
    def compare(table: pa.Table) -> pa.Table:
        """Exact links among sets, as a star for each component."""
        table = table.sort_by("entry")
        ids = table.column("entry").to_numpy()
        own = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # a repeated row is fetched as often as it stands
        ids, table = ids[own], table.take(pa.array(own))
        each = [np.cumsum(unpack(x, np.uint64)) for x in table.column("shingles").to_pylist()]
        n, size = len(ids), np.array([len(x) for x in each])
        _, flat = np.unique(np.concatenate(each), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(flat, kind="stable")
        holder = np.repeat(np.arange(n), size)[order]  # entries by shingle
        at = np.searchsorted(flat[order], np.arange(flat.max() + 2))

        def links(i: int) -> np.ndarray:
            own = flat[bounds[i] : bounds[i + 1]]
            count = at[own + 1] - at[own]
            place = np.arange(count.sum()) + np.repeat(at[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            common = np.bincount(holder[place], minlength=n)
            return 100 * common >= similar * (size + size[i] - common)

        return _edges(ids, _settled(n, np.arange(n), links))

    return compare


def _fetch(k: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            grams, bounds = sets(batch.column(0), k)
            cells: list[list] = [[], [], []]
            for entry, groups, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), bounds, bounds[1:]):
                packed = pack(np.diff(grams[a:b], prepend=np.uint64(0)))
                for group in groups:
                    for cell, value in zip(cells, (entry, group, packed)):
                        cell.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.binary())], ["entry", "group", "shingles"])

    return rows


def _deeper(k: int, similar: int, level: int):
    """entry, tree and path of every tree of a deeper forest, from the texts of entries."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                grams, bounds = sets(part.column(1), k)
                found = paths(grams, bounds, level, similar)
                entry = part.column(0).to_numpy()[np.diff(bounds) > 0]
                n, trees, depth = found.shape
                cells = pa.Array.from_buffers(pa.binary(depth), n * trees, [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(entry, trees), pa.int64()), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), cells], ["entry", "tree", "path"])

    return rows


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted order, the places whose path a neighbour has in common, and those whose neighbour is not in sight."""
    for batch in batches:
        if batch.num_rows:
            tree, path = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), object)
            same = np.concatenate([[True], (tree[1:] == tree[:-1]) & (path[1:] == path[:-1]), [True]])
            yield batch.filter(pa.array(same[1:] | same[:-1]))


def _regions(stand: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """stand(entry, tree, path) in sorted order: entry, tree and key of the places in runs; and of each run of two or more its key, size, and what its members add up to."""
    ordered = stand.repartitionByRange("tree", "path", "entry").sortWithinPartitions("tree", "path", "entry")
    runs = written(ordered.select("entry", "tree", "path").mapInArrow(_runs, "entry long, tree int, path binary").select("entry", "tree", F.xxhash64(F.lit(level), "tree", "path").alias("key")), "runs")
    members = [F.sum(F.expr(f"xxhash64(entry, {seed}) >> 24")).alias(name) for seed, name in ((1, "members"), (2, "others"))]
    return runs, written(runs.groupBy("key").agg(F.count("*").alias("n"), F.min("entry").alias("first"), *members).where("n > 1"), "regions")


def duplicates(docs: DataFrame, k: int = WORDS, similar: int = SIMILAR, region: int = REGION, cluster: int = CLUSTER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document of docs(doc_id, text)."""
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    signed = written(text.select("doc_id", "text", "row").mapInArrow(_signed(k, similar), "doc_id long, row long, n_shingles long, one long, two long, signature binary"), "signed")
    # an entry is a set, with a number of its own and one of the rows that have it, which its text is fetched from
    entries = signed.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two").agg(F.min(F.struct("doc_id", "row", "n_shingles", "signature")).alias("e"))
    entries = entries.select(F.monotonically_increasing_id().alias("entry"), "one", "two", "e.doc_id", "e.row", F.col("e.n_shingles").alias("size"), "e.signature")
    entries = written(entries, "entries")

    # the first forest's values are those of signatures; deeper ones are made from texts, for the entries of large regions
    trees = F.explode(F.sequence(F.lit(0), F.lit(trees_for(similar) - 1))).alias("tree")
    stand = entries.select("entry", "signature", trees).select("entry", "tree", F.expr(f"substring(signature, tree * {DEPTH} + 1, {DEPTH})").alias("path"))
    found = None
    for level in range(LEVELS):
        runs, size = _regions(stand, level)
        # regions of the same members are one, whatever trees and depths they come from
        same = size.where(F.col("n") <= region).groupBy("n", "members", "others", "first").agg(F.min("key").alias("key"))
        small = runs.join(same.select("key"), "key").select("entry", "tree", "key")
        found = small if found is None else found.unionAll(small)
        large = size.where(F.col("n") > region).select("key")
        if not large.limit(1).count():
            large = None
            break
        if level + 1 < LEVELS:
            hot = written(runs.join(large, "key").select("entry").distinct().join(entries.select("entry", "row"), "entry"), "hot")
            texts = sieved(text, "row", hot).join(hot, "row").dropDuplicates(["row", "entry"])
            stand = written(texts.select("entry", "text").mapInArrow(_deeper(k, similar, level + 1), "entry long, tree int, path binary"), "stand")
    found = written(found.distinct(), "members")
    near = found.join(entries.select("entry", "signature"), "entry").groupBy("key").applyInArrow(_region(agreement(similar)), _EDGE)
    if large is not None:
        # a cluster may hold too much, since exact comparison follows
        chained = written(size.select("key", F.col("first").alias("b")).join(large, "key").join(runs, "key").select(F.col("entry").alias("a"), "b"), "chained")
        near = near.unionAll(chained)
    clusters = written(components(near), "clusters")

    # sets are compared within small clusters, and within the regions of large ones
    sized = clusters.join(entries.select(F.col("entry").alias("node"), "size"), "node")
    total = sized.groupBy("component").agg(F.sum("size").alias("total"))
    sized = sized.join(total.withColumn("large", F.col("total") > cluster).drop("total"), "component")
    if large is not None:
        kept_whole = clusters.join(chained.select(F.col("b").alias("node")).distinct(), "node").select("component", F.lit(True).alias("whole")).distinct()
        sized = sized.join(kept_whole, "component", "left").withColumn("large", F.col("large") & F.col("whole").isNull())
    groups = sized.where("not large").select("node", "size", F.xxhash64("component", F.lit("cluster")).alias("group"))
    by_region = sized.where("large").select("node", "size").join(found.select(F.col("entry").alias("node"), F.col("key").alias("group")).distinct(), "node")
    groups = written(groups.unionAll(by_region.select("node", "size", "group")), "groups")
    blocks = F.ceil(F.col("total") / cluster)
    placed = groups.join(groups.groupBy("group").agg(F.sum("size").alias("total"), F.count("*").alias("n")).where("n > 1"), "group")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    paired = F.expr("if(blocks = 1, array(group), transform(sequence(cast(0 as bigint), blocks - 1), j -> xxhash64(group, least(j, block), greatest(j, block))))")
    placed = placed.select("node", F.explode(paired).alias("group")).groupBy("node").agg(F.collect_list("group").alias("groups"))
    placed = written(placed.join(entries.select(F.col("entry").alias("node"), "row"), "node"), "placed")
    # a sieve of fixed size spares most other documents the shuffle
    fetched = sieved(text, "row", placed).select("row", "text").join(placed, "row")
    shingles = fetched.select("text", "node", "groups").mapInArrow(_fetch(k), "entry long, group long, shingles binary")
    links = shingles.groupBy("group").applyInArrow(_linked(similar), _EDGE)
    linked = components(links).withColumnRenamed("node", "entry")

    named = linked.join(entries.select("entry", "doc_id"), "entry")
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("entry", "component_id")
    of_set = entries.select("one", "two", "entry", "doc_id").join(named, "entry", "left").select("one", "two", F.coalesce("component_id", "doc_id").alias("component_id"))
    some = F.col("n_shingles") > 0
    # an empty set meets no entry: its keys are nulled, so that such rows spread by their doc_id
    own = signed.select("doc_id", "n_shingles", F.when(some, F.col("one")).alias("one"), F.when(some, F.col("two")).alias("two"))
    out = own.join(of_set, ["one", "two"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, k: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The rows of docs, all columns as they came, but of each group of linked rows only the one of the smallest doc_id.

    Rows are judged as rows, whatever their ids: those of one id with different texts are different documents, and rows
    without id go behind any with one.  A row without words is linked with nothing and stays.
    """
    rows = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    found = duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text"), k, similar).where("component_id <> doc_id or not kept")
    # only rows that are linked with a smaller one, and the ones they are linked with, can go or change places
    linked = found.select(F.col("doc_id").alias(_ROW), "component_id").unionAll(found.select(F.col("component_id").alias(_ROW), "component_id").distinct())
    linked = written(linked, "linked")
    ranked = rows.select(_ROW, F.col("doc_id").isNull().alias("none"), "doc_id").join(linked, _ROW)
    first = ranked.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", _ROW))[_ROW].alias(_ROW)).select(_ROW)
    gone = linked.select(_ROW).join(first, _ROW, "left_anti")
    return rows.join(gone, _ROW, "left_anti").select(docs.columns)
