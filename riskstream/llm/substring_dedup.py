"""Repeated passages, found with FM-indexes over shards and removed.

A window of 50 words is removed from a document if it also starts in a document of a
smaller id.  To bring together what may be equal without comparing everything with
everything, each window is known by its anchor, the 12-word sequence of least hash
in it, which equal windows share.  Consecutive windows of one anchor are a segment of
under 90 words, about one for 20 words of text.

1. Segments are counted by (anchor, content hash), combined before the shuffle, so a group of copies
   is one text from here on, however large.  An anchor that one document alone has, with one
   content, is passed over: nothing can match there.
2. One copy of every other segment, from the document that has it first, goes to a shard by
   its anchor.  A shard of up to `SHARD_WORDS` words is indexed (fm_index.py), and segments are
   streamed against it by backward search for the intervals whose matching statistics reach a window:
   each as its first document asks, which owners before it hold, and, if other documents hold the segment too, as
   those ask.  An anchor with more than `SEGMENTS` different segments (the edge of a
   passage that very many documents share) is split by the windows themselves: what would be searched
   for is then the whole window, and the smallest owner of each is found by grouping.
3. What was found is known by anchor and content.  Documents are cut up the same way once more, and
   it holds at every place where one has that segment, whether it is the first to have it or not.

Windows are judged on the input, so the result does not depend on order.  Words and
sequences are known by 64-bit hashes.  Defined cases: a null or empty text has no
words; documents of under 50 words keep all; rows of one id, equal or not, are not repeats
of each other, and each gives a row; a null doc_id is kept whole; a text of any length is worked on whole; extra columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import Words, grams_hash, mix, pieces, spans_hash, words, written
from riskstream.llm.fm_index import Index

WINDOW = 50
ANCHOR = 12
SHARD_WORDS = 300_000
SEGMENTS = 2000


@dataclass
class Segments:
    doc: np.ndarray
    order: np.ndarray  # within the document
    start: np.ndarray  # words
    end: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def segments(w: Words, window: int, anchor: int) -> Segments:
    n = np.maximum(np.diff(w.first) - window + 1, 0)
    total = int(n.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none, none)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) + np.repeat(w.first[:-1] - (np.cumsum(n) - n), n)
    grams = grams_hash(w.hash, anchor)
    place = np.uint64((1 << 24) - 1)
    value = (grams & ~place) | (np.arange(len(grams)).astype(np.uint64) & place)
    width, reach = window - anchor + 1, 1
    while 2 * reach <= width:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    least = np.minimum(value[at], value[at + width - reach])
    chosen = at + ((least.astype(np.int64) - at) & int(place))
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], total) - 1
    own, start, end = doc[begin], at[begin], at[last] + window
    order = np.arange(len(begin)) - np.searchsorted(own, own)
    return Segments(own, order, start, end, mix(grams[chosen[begin]] + np.uint64(1)).view(np.int64), spans_hash(w.hash, start, end).view(np.int64))


def _cut(window: int, anchor: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = segments(words(batch.column(1)), window, anchor)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.doc)), pa.array(s.anchor, pa.int64()), pa.array(s.content, pa.int64())], ["doc_id", "anchor", "content"])

    return rows


def _places(s: Segments, lo: int, hi: int) -> dict[tuple[int, int], list[int]]:
    """Of segments lo to hi, which stand where by what they hold."""
    held: dict[tuple[int, int], list[int]] = {}
    for k, what in zip(range(lo, hi), zip(s.anchor[lo:hi].tolist(), s.content[lo:hi].tolist())):
        held.setdefault(what, []).append(k)
    return held


_FETCHED = "anchor long, content long, owner long, repeated boolean, words binary, window long, at int"


def _fetch(window: int, anchor: int):
    """Of documents with the segments wanted of them: their word hashes, or their windows where hot."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = words(batch.column(1))
            s = segments(w, window, anchor)
            first = np.searchsorted(s.doc, np.arange(batch.num_rows + 1))
            cells: list[list] = [[], [], [], [], [], [], []]
            for i, (doc, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                held = _places(s, first[i], first[i + 1])
                for x in wanted:
                    what = x["anchor"], x["content"]
                    if what not in held:
                        continue  # another row of this id has it
                    k = held[what][0]
                    own = w.hash[s.start[k] : s.end[k]]
                    if x["hot"]:
                        found = [(*what, doc, x["repeated"], None, key, j) for j, key in enumerate(grams_hash(own, window).view(np.int64).tolist())]
                    else:
                        found = [(*what, doc, x["repeated"], own.tobytes(), None, None)]
                    for row in found:
                        for cell, value in zip(cells, row):
                            cell.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["anchor", "content", "owner", "repeated", "words", "window", "at"])

    return rows


#: later: of documents after the first one that holds the segment. end: null for all of it.
_FOUND = "anchor long, content long, owner long, later boolean, start int, end int"


def _search(window: int, shard_words: int):
    """Rows in order of anchors and contents; a shard is a run of whole anchors."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        owners: list[int] = []
        repeated: list[bool] = []
        texts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            owner = np.array(owners)
            # an anchor's smallest owner has nothing before it
            _, group = np.unique(np.array([k[0] for k in keys]), return_inverse=True)
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, owner)
            own, later = np.flatnonzero(owner > least[group]), np.flatnonzero(repeated)
            asked = np.concatenate([own, later]).astype(np.int64)
            found = Index(texts, owner, 2 * window).matching([texts[i] for i in asked], np.concatenate([owner[own], owner[later] + 1]), window)
            which = asked[np.array([x[0] for x in found], np.int64)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i][0] for i in which], pa.int64()), pa.array([keys[i][1] for i in which], pa.int64()), pa.array(owner[which], pa.int64()), pa.array([x[0] >= len(own) for x in found], pa.bool_()),
                    pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()),
                ],
                ["anchor", "content", "owner", "later", "start", "end"],
            )

        for batch in batches:
            for key, content, owner, more, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= shard_words and key != keys[-1][0]:
                    yield flush()
                    keys, owners, repeated, texts, size = [], [], [], [], 0
                if keys and keys[-1] == (key, content):
                    continue  # a repeated row
                keys.append((key, content))
                owners.append(owner)
                repeated.append(more)
                texts.append(np.frombuffer(text, np.uint64))
                size += len(text) // 8
        if keys:
            yield flush()

    return rows


def _keep(window: int, anchor: int, digest: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = words(batch.column(1))
            s = segments(w, window, anchor)
            first = np.searchsorted(s.doc, np.arange(batch.num_rows + 1))
            gone = np.zeros(len(w.start) + 1, np.int64)
            for i, cuts in enumerate(batch.column(2).to_pylist()):
                if not cuts:
                    continue
                held = _places(s, first[i], first[i + 1])
                for x in cuts:
                    for k in held.get((x["anchor"], x["content"]), ()):
                        gone[s.start[k] + (x["start"] or 0)] += 1
                        gone[s.end[k] if x["end"] is None else s.start[k] + x["end"]] -= 1
            kept = np.cumsum(gone)[:-1] <= 0
            removed = np.concatenate([[0], np.cumsum(~kept)])[w.first]
            out = []
            raw = w.data.tobytes()
            for i in range(batch.num_rows):
                own = slice(w.first[i], w.first[i + 1])
                at = np.flatnonzero(kept[own]) + w.first[i]
                text = b" ".join([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, segments_most: int = SEGMENTS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by spaces (or their SHA-256) of every document of docs(doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    known = docs.where("doc_id is not null")
    cut = known.mapInArrow(_cut(window, anchor), "doc_id long, anchor long, content long")
    same = written(cut.groupBy("anchor", "content").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "segments")

    # anchors that more than one document has, or one document with different contents
    anchors = same.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("owner").alias("least"), F.max("last").alias("most")).where("most > least")
    looked = same.join(anchors, "anchor").select("owner", F.struct("anchor", "content", (F.col("last") > F.col("owner")).alias("repeated"), (F.col("contents") > segments_most).alias("hot")).alias("wanted"))
    wanted = looked.groupBy("owner").agg(F.collect_list("wanted").alias("wanted"))
    fetched = written(known.join(wanted, known.doc_id == wanted.owner).select("doc_id", "text", "wanted").mapInArrow(_fetch(window, anchor), _FETCHED), "fetched")
    sharded = fetched.where("words is not null").select("anchor", "content", "owner", "repeated", "words").repartition("anchor").sortWithinPartitions("anchor", "content")
    found = sharded.mapInArrow(_search(window, shard_words), _FOUND)
    hot = fetched.where("words is null")
    least = hot.groupBy("window").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("window", "least")
    own = hot.join(least, "window").where("owner > least").select("anchor", "content", "owner", F.lit(False).alias("later"), F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    later = hot.where("repeated and at = 0").select("anchor", "content", "owner", F.lit(True).alias("later"), F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"))
    found = written(found.unionAll(own).unionAll(later), "found")

    # both sides come from their own shuffles, so the adaptive plan can split a segment that very many documents hold
    cuts = cut.join(found, ["anchor", "content"]).where("if(later, doc_id > owner, doc_id = owner)")
    cuts = cuts.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "content", "start", "end")).alias("cuts"))
    return docs.join(cuts, "doc_id", "left").select("doc_id", "text", "cuts").mapInArrow(_keep(window, anchor, digest), "doc_id long, n_words long, n_removed long, kept string")
