"""Benchmark decontamination: short test items found inside long documents.

A short item's Jaccard similarity with a long document is tiny whatever it shares,
so both sides are partitioned by size.  Items fall into classes by the power of two
that holds their shingles; for each class, documents are cut into windows of twice
that many shingles, each overlapping the next by half, so that a copied passage lies
whole in some window and makes up a quarter of it or more.  Windows and items have
MinHash signatures; an item is a candidate of a document if any of `HASHES` values
agrees with a window of its class.  A passage holding the wanted 0.8 of an item has
similarity 0.2 at least with its window, which all 48 values miss with probability
0.8**48, about 2 in 100,000; a whole copy is missed with one in a million.
Candidates are verified by exact containment: the share of the item's distinct
shingles that occur in the whole document.

Words are compared after lower-casing A-Z; shingles have five words.  An item of
fewer words is one shingle of all its words, looked for as such.  Items go to the
executors in blocks whose size is bounded by `BLOCK_WORDS`, each text once with all of its ids; every block passes over
all documents, and a worker builds a block's index once for all of its tasks.  Hash values of 64 bits stand for shingles.

Defined cases: null, empty or wordless items and documents match nothing; an item
without id has no rows in matches(), but clean() looks for it too; repeated
rows each give their rows; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import mix, pieces, words

WORDS = 5
HASHES = 48
CONTAINED = 0.8
#: Words of items that one block sends to every executor: 8 bytes a word for shingles, and the signatures.
BLOCK_WORDS = 2_000_000
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (2, HASHES), np.uint64)
_MUL, _ADD = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


class Items:
    """Items of one block, each text once with all of its ids: their shingles, and by size class their signatures in sorted columns."""

    def __init__(self, ids: list[list[int]], texts: list[bytes | None], k: int):
        w = words(pa.array(texts, pa.binary()), lower=True)
        n = np.diff(w.first)
        full, bounds = w.grams(k)
        self.k, self.ids = k, ids
        self.shingles = [np.unique(full[bounds[i] : bounds[i + 1]]) for i in range(len(ids))]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in np.unique(n[(n > 0) & (n < k)]).tolist():
            grams, at = w.grams(m)
            rows = np.flatnonzero(n == m)
            self.short[m] = grams[at[rows]], rows
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        count = np.array([len(s) for s in self.shingles], np.int64)
        sizes = np.array([1 << (c - 1).bit_length() if c else 0 for c in count.tolist()], np.int64)
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            flat, first = np.concatenate([self.shingles[i] for i in rows]), np.cumsum(count[rows]) - count[rows]
            signature = np.stack([np.minimum.reduceat(mix(flat * a + b), first) for a, b in zip(_MUL, _ADD)], 1)
            order = np.argsort(signature, 0, kind="stable")
            self.classes[size] = np.take_along_axis(signature, order, 0), rows[order]

    def find(self, grams: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """Candidates (document, item) by size class and signature."""
        out: set[tuple[int, int]] = set()
        if not len(grams) or not self.classes:
            return out
        edges = {}
        for size in self.classes:
            # blocks of `size` shingles in each document; a window is a block and its successor
            n = -(-np.diff(bounds) // size)
            doc = np.repeat(np.arange(len(n)), n)
            begin = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size + bounds[doc]
            edges[size] = begin, doc, np.append(doc[1:] == doc[:-1], False)
        for k in range(HASHES):
            value = mix(grams * _MUL[k] + _ADD[k])
            for size, (signature, rows) in self.classes.items():
                begin, doc, joined = edges[size]
                least = np.minimum.reduceat(value, begin)
                least[:-1] = np.where(joined[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                lo = np.searchsorted(signature[:, k], least)
                for at in np.flatnonzero(np.append(signature[:, k], ~np.uint64(0))[lo] == least):
                    for j in range(lo[at], len(rows)):
                        if signature[j, k] != least[at]:
                            break
                        out.add((int(doc[at]), int(rows[j, k])))
        return out


#: The index of the block that a worker looked into last, so that its tasks build it once.
_last: dict[str, Items] = {}


def _index(name: str, sent, k: int) -> Items:
    if name not in _last:
        _last.clear()
        _last[name] = Items(*sent.value, k)
    return _last[name]


def matches(docs: DataFrame, items: DataFrame, k: int = WORDS, contained: float = CONTAINED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every document of docs(doc_id, text) with every item of items(item_id, text) it holds."""
    spark = docs.sparkSession
    out = None
    for ids, texts in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast((ids, texts))
        found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
            _search(sent, k, contained), "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
        )
        out = found if out is None else out.unionAll(found)
    return out


def _blocks(items: DataFrame, block_words: int, named: bool = True) -> Iterator[tuple[list[list[int]], list[bytes]]]:
    """Distinct texts of items with their ids (if named; else without), streamed to the driver and cut by their size; at least one block, perhaps empty."""
    ids: list[list[int]] = []
    texts: list[bytes] = []
    size, any_ = 0, False
    own = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null and item_id is not null" if named else "text is not null")
    # ids of a text that is there very often are a list no longer than the rows that matches() gives for it
    grouped = own.groupBy("text").agg(F.sort_array(F.collect_list("item_id")).alias("ids")) if named else own.select("text", F.array().cast("array<bigint>").alias("ids")).distinct()
    for text, found in grouped.orderBy("text").toLocalIterator():
        if ids and size + len(text) > 8 * block_words:
            yield ids, texts
            ids, texts, size, any_ = [], [], 0, True
        ids.append(found)
        texts.append(bytes(text))
        size += len(text)
    if ids or not any_:
        yield ids, texts


def clean(docs: DataFrame, items: DataFrame, k: int = WORDS, contained: float = CONTAINED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that hold none of the items; rows without doc_id are judged by their text like others."""
    names = docs.columns
    for ids, texts in _blocks(items, block_words, named=False):
        sent, block = docs.sparkSession.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def rows(batches: Iterable[pa.RecordBatch], sent=sent, block=block) -> Iterator[pa.RecordBatch]:
            known = _index(block, sent, k)
            for batch in pieces(batches, "text"):
                found = {f[0] for f in _held(known, batch.column(names.index("text")), contained)}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def _held(items: Items, texts: pa.Array, contained: float) -> set[tuple[int, int, int, int]]:
    """(document, item, shared, shingles of the item) by place, verified."""
    w = words(texts.cast(pa.binary()), lower=True)
    grams, bounds = w.grams(items.k)
    found: set[tuple[int, int, int, int]] = set()
    for doc, item in items.find(grams, bounds):
        wanted = items.shingles[item]
        shared = int(np.isin(wanted, grams[bounds[doc] : bounds[doc + 1]]).sum())
        if shared >= contained * len(wanted):
            found.add((doc, item, shared, len(wanted)))
    for m, (hashes, which) in items.short.items():
        grams_m, bounds_m = w.grams(m)
        for at in np.flatnonzero(np.isin(grams_m, hashes)):
            doc = int(np.searchsorted(bounds_m, at, "right") - 1)
            found |= {(doc, int(which[j]), 1, 1) for j in np.flatnonzero(hashes == grams_m[at])}
    return found


def _search(sent, k: int, contained: float):
    block = uuid.uuid4().hex

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(block, sent, k)
        for batch in pieces(batches, "text"):
            table = np.array(sorted(_held(items, batch.column(1), contained)), np.int64).reshape(-1, 4)
            often = np.array([len(items.ids[i]) for i in table[:, 1]], np.int64)
            ids = [x for i in table[:, 1] for x in items.ids[i]]
            table = table[np.repeat(np.arange(len(table)), often)]
            doc_ids = batch.column(0).take(pa.array(table[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(ids, pa.int64()), pa.array(table[:, 2]), pa.array(table[:, 3]), pa.array(table[:, 2] / np.maximum(table[:, 3], 1))],
                ["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
            )

    return rows
