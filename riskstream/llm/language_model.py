"""Language-model scores from a weighted backoff automaton of order three.

States are the histories seen in training: two tokens, one token, and the root, which is
none; the start of a text is a token of histories.  A state's arcs are the tokens seen after
it, and its failure arc leads to the history without its first token.  Weights
are log10 probabilities under Dirichlet priors, each order's mean being the order below,

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | v) = (c(v w) + m P(w)) / (c(v) + m)
    P(w | u v) = (c(u v w) + n P(w | v)) / (c(u v) + n),

so the failure arc of a state weighs m / (c(v) + m) or n / (c(u v) + n), a token that a state has no arc for
is reached through failure arcs at just its probability, and probabilities of all words and one
unknown word add up to 1.  A text is scored in one traversal from left to right that
carries the state and adds up weights; its end is a token too.  The texts of a block are
traversed together, and long ones in stretches of `STRETCH` tokens: a state depends on the last two
tokens only, so a stretch begins by reading the two before it, for their states and not
their weights.

No executor holds all n-grams.  Documents are packed into blocks of about
`BLOCK_BYTES` of text, written once.  Each block asks for just the n-grams that its
documents can traverse, and brings its own training counts.  Keys travel by their leading bits,
`ROUTE` of them a round: in a round, a unit (at first a block) cuts its sorted keys into up to
2**ROUTE cells, and as many units as there are values meet in new units, each of which adds
up its cells.  After log2(blocks) / ROUTE rounds a unit has all counts of its keys, and answers go back
the same way.  So every unit is about the size of a block, and a block makes at most
2**ROUTE rows in each round, whatever the input's size.  A frequent n-gram is one key in
each unit, so no unit is hot.

Tokens are identified by 64-bit hashes, longer n-grams by as many bits as hold `SPARE`
more than log2 of the number of tokens, so that one in 2**SPARE is taken for another, at any size
of the input.  Defined cases: a null or empty text is its end token alone; a document without id is
used for training; repeated rows and ids count and score each; a very long text makes a block of its own; without training
documents N = V = 0 and every token is unknown; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import PIECE, crc_remainder, mix, pieces, words, written

BLOCK_BYTES = 9 << 20
PRIORS = (40.0, 8.0)
ROUTE = 7
SPARE = 20
STRETCH = 1024
ORDERS = 3
_END, _START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A271)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def pack(a: np.ndarray) -> bytes:
    """Compressed by byte planes: high bytes of sorted or small values are alike."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) with places of four bytes; a block has fewer than 2**31 tokens."""
    order = np.argsort(values).astype(np.int32)
    values = values[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values[new], place


@dataclass
class Block:
    vocabulary: np.ndarray  # sorted hashes
    tokens: np.ndarray  # places in vocabulary, documents one after another, each with its end
    bounds: np.ndarray
    held: np.ndarray  # of documents

    def __post_init__(self) -> None:
        """pairs and triples: distinct codes of n-grams, as (state before) * (words + 1) + word; at2, at3: each token's place among them, -1 for the first token's triple."""
        n = len(self.vocabulary)  # stands for the start
        self.before = np.empty(len(self.tokens), np.int64)
        self.before[1:] = self.tokens[:-1]
        self.before[self.bounds[:-1]] = n
        self.pairs, self.at2 = _distinct(self.before * (n + 1) + self.tokens)
        inner = np.ones(len(self.tokens), bool)
        inner[self.bounds[:-1]] = False
        later = np.flatnonzero(inner)
        self.triples, place = _distinct(self.at2[later - 1].astype(np.int64) * (n + 1) + self.tokens[later])
        self.at3 = np.full(len(self.tokens), -1, np.int32)
        self.at3[later] = place

    def release(self) -> None:
        """Lets the n-grams go; tokens, bounds and words stay."""
        del self.before, self.pairs, self.at2, self.triples, self.at3

    def keys(self, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the sorted keys, and the place among them of each word, pair and triple."""
        n = len(self.vocabulary)
        history = np.append(self.vocabulary, _START)
        two = mix(history[self.pairs // (n + 1)] * _A + mix(history[self.pairs % (n + 1)] * _B))
        three = mix(two[self.triples // (n + 1)] * _B + mix(history[self.triples % (n + 1)] * _A))
        mask = np.uint64((1 << 64) - (1 << (64 - bits)))
        two &= mask
        three &= mask
        return [(self.vocabulary, np.arange(n)), _distinct(two), _distinct(three)]

    def counts(self, keys: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Training counts of the keys of each order."""
        train = np.repeat(~self.held, np.diff(self.bounds))
        later = train & (self.at3 >= 0)
        each = (self.tokens[train], self.at2[train], self.at3[later])
        return [np.bincount(place[at], minlength=len(key)).astype(np.uint64) for (key, place), at in zip(keys, each)]


def blocks(docs: DataFrame, held: int, folds: int, block_bytes: int) -> DataFrame:
    """One row for each block of documents, written; crc32(doc_id) mod folds = held marks documents that are not learned from."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        length: list[np.ndarray] = []
        out: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            cells = [uuid.uuid4().int >> 65, len(tokens), pack(vocabulary), pack(tokens.astype(np.uint32)), pack(np.concatenate(length).astype(np.int64)), ids, out]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["block", "size", "vocabulary", "tokens", "lengths", "doc_ids", "held"])

        for batch in pieces(batches, "text", min(PIECE, block_bytes)):
            w = words(batch.column(1), lower=True)
            hashes.append(np.insert(w.hash, w.first[1:], _END))
            length.append(np.diff(w.first) + 1)
            ids += batch.column(0).to_pylist()
            out += batch.column(2).to_pylist()
            size += len(w.data) + batch.num_rows  # empty texts take room as well
            if size >= block_bytes:
                yield flush()
                ids, hashes, length, out, size = [], [], [], [], 0
        if ids:
            yield flush()

    fold = F.coalesce(crc_remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), fold.alias("held")).mapInArrow(
        rows, "block long, size long, vocabulary binary, tokens binary, lengths binary, doc_ids array<long>, held array<boolean>"
    )


def _read(row: dict) -> Block:
    bounds = np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])
    return Block(unpack(row["vocabulary"], np.uint64), unpack(row["tokens"], np.uint32).astype(np.int64), bounds, np.array(row["held"], bool))


#: Keys and counts of one digit of a unit's keys, for each order; they go to another unit.
_CELL = "to long, child long, digit int, keys array<binary>, counts array<binary>"
#: What comes back: for each key, how many more there are in training than the cell brought. seen, total: of the words a last unit adds up, in one of its rows.
_ANSWER = "child long, digit int, more array<binary>, seen long, total long"


def _cells(group: int, prefix: int, child: int, keys: list[np.ndarray], counts: list[np.ndarray], done: int, bits: int) -> list[list]:
    """A unit's keys cut by the next bits; all have the first done bits, prefix. A cell goes to the unit of its digit and the rest of the group."""
    out: list[list] = [[], [], [], [], []]
    shift = np.uint64(64 - done - bits)
    digit = [((k >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in keys]
    cuts = [np.searchsorted(d, np.arange((1 << bits) + 1)) for d in digit]
    for b in range(1 << bits):
        part = [slice(c[b], c[b + 1]) for c in cuts]
        if any(p.start < p.stop for p in part):
            row = (group >> bits) << (done + bits) | prefix << bits | b, child, b, [pack(np.diff(k[p], prepend=np.uint64(0))) for k, p in zip(keys, part)], [pack(n[p]) for n, p in zip(counts, part)]
            for cell, value in zip(out, row):
                cell.append(value)
    return out


def _cell_table(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["to", "child", "digit", "keys", "counts"])


def _asked(route: int, key_bits: int, bits: int):
    """The cells of blocks; route: how many bits of block ids deal them to groups."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _read(row)
                keys = block.keys(key_bits)
                yield _cell_table(_cells(row["block"] >> (63 - route), 0, row["block"], [k for k, _ in keys], block.counts(keys), 0, bits))

    return rows


class _Unit:
    """The cells that meet in a unit: sums by key, and what each cell is told."""

    def __init__(self, table: pa.Table):
        self.child, self.digit = table.column("child"), table.column("digit")
        cells, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        self.keys, self.sums, self.at, self.own = [], [], [], []
        for k in range(ORDERS):
            each = [np.cumsum(unpack(c[k], np.uint64)) for c in cells]
            own = [unpack(c[k], np.uint64) for c in counts]
            keys, at = np.unique(np.concatenate(each), return_inverse=True)
            cut = np.cumsum([len(e) for e in each])[:-1]
            self.keys.append(keys)
            self.sums.append(np.bincount(at, np.concatenate(own), len(keys)).astype(np.uint64))
            self.at.append(np.split(at, cut))
            self.own.append(own)

    def answers(self, totals: list[np.ndarray], seen: int = 0, total: int = 0) -> pa.Table:
        more = [[pack(t[at[i]] - own[i]) for t, at, own in zip(totals, self.at, self.own)] for i in range(len(self.child))]
        n = len(more)
        return pa.table([self.child, self.digit, pa.array(more, pa.list_(pa.binary())), pa.array([seen] + [0] * (n - 1), pa.int64()), pa.array([total] + [0] * (n - 1), pa.int64())], names=["child", "digit", "more", "seen", "total"])


def _last(table: pa.Table) -> pa.Table:
    unit = _Unit(table)
    return unit.answers(unit.sums, int((unit.sums[0] > 0).sum()), int(unit.sums[0].sum()))


def _added(cells: DataFrame, done: int, rounds: list[int]) -> DataFrame:
    """Answers to cells whose keys have been dealt by their first done bits; rounds: bits of those still to come."""
    if not rounds:
        return cells.groupBy("to").applyInArrow(_last, _ANSWER)
    cells = written(cells, "lm-cells")

    def deal(table: pa.Table) -> pa.Table:
        to, unit = table.column("to")[0].as_py(), _Unit(table)
        return pa.Table.from_batches([_cell_table(_cells(to >> done, to & ((1 << done) - 1), to, unit.keys, unit.sums, done, rounds[0]))])

    def answer(table: pa.Table, got: pa.Table) -> pa.Table:
        unit = _Unit(table)
        got = got.sort_by("digit")
        more = [np.concatenate([unpack(m[k], np.uint64) for m in got.column("more").to_pylist()]) for k in range(ORDERS)]
        return unit.answers([s + m for s, m in zip(unit.sums, more)])

    below = written(_added(cells.groupBy("to").applyInArrow(deal, _CELL), done + rounds[0], rounds[1:]), "lm-answers")
    back = cells.groupBy("to").cogroup(below.where("child is not null").groupBy("child")).applyInArrow(answer, _ANSWER)
    return back.unionAll(below.where("seen > 0 or total > 0").selectExpr("cast(null as bigint) as child", "cast(null as int) as digit", "cast(null as array<binary>) as more", "seen", "total"))


def rounds_for(n: int, route: int = ROUTE) -> list[int]:
    """Bits of each round that deal n blocks' keys to n units or more."""
    bits = max(1, (n - 1).bit_length())
    rounds = -(-bits // route)
    return [bits // rounds + (i < bits % rounds) for i in range(rounds)]


def scores(docs: DataFrame, held: int = 2, folds: int = 7, priors: tuple[float, float] = PRIORS, block_bytes: int = BLOCK_BYTES, route: int = ROUTE, spare: int = SPARE, stretch: int = STRETCH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document of docs(doc_id, text)."""
    table = written(blocks(docs, held, folds, block_bytes), "lm-blocks")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rounds = rounds_for(n, route)
    key_bits = min(64, size.bit_length() + spare)
    asked = table.select("block", "vocabulary", "tokens", "lengths", "held").mapInArrow(_asked(sum(rounds), key_bits, rounds[0]), _CELL)
    answers = written(_added(asked, rounds[0], rounds[1:]), "lm-answers")
    seen, total = answers.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # at most 2**route answers for each block, of its own size in all
    ordered = answers.where("child is not null").groupBy(F.col("child").alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("digit", "more"))), lambda x: x.more).alias("more"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, more, ids = _read(row), row["more"], row["doc_ids"]
                del row
                counts = _known(block, more, key_bits)
                del more
                yield _scored(ids, block, counts, total, seen, priors, stretch)
                del block, counts

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.drop("size").join(ordered, "block").mapInArrow(rows, schema)


def _known(block: Block, more: list[list[bytes]], key_bits: int) -> list[np.ndarray]:
    """Training counts of each word, pair and triple of a block; nothing of the keys is kept beside them."""
    keys = block.keys(key_bits)
    counts = block.counts(keys)
    out = []
    while keys:
        k, (_, place) = len(out), keys.pop(0)
        out.append((counts.pop(0) + np.concatenate([unpack(m[k], np.uint64) for m in more]))[place].astype(np.float64))
    return out


class Automaton:
    """The part of the model that a block can reach. States: 0 the root, then each word and the start, then each pair."""

    def __init__(self, block: Block, one: np.ndarray, two: np.ndarray, three: np.ndarray, total: int, seen: int, priors: tuple[float, float]):
        n = len(block.vocabulary)
        self.width = n + 1
        end = int(np.searchsorted(block.vocabulary, _END))
        history = np.append(one, one[end])  # the start has been seen as often as the end
        m, k = priors
        root = (one + 1) / (total + seen + 1)
        # large arrays are made when they are asked for and let go at once: a block has as many arcs as tokens, twice
        some2, some3 = np.flatnonzero(two > 0), np.flatnonzero(three > 0)
        size2, size3 = len(some2), len(some3)
        self.arcs, self.weight, self.to = np.empty(size2 + size3 + 1, np.int64), np.empty(size2 + size3 + 1), np.empty(size2 + size3 + 1, np.int32)
        self.arcs[-1], self.weight[-1], self.to[-1] = np.iinfo(np.int64).max, 1.0, 0
        first, last = block.pairs // (n + 1), block.pairs % (n + 1)
        self.arcs[:size2] = (1 + first[some2]) * self.width + last[some2]
        self.to[:size2] = n + 2 + some2
        p2 = (two + m * root[last]) / (history[first] + m)
        self.weight[:size2] = p2[some2]
        del first, some2
        pair, word = block.triples // (n + 1), block.triples % (n + 1)
        self.arcs[size2:-1] = (n + 2 + pair[some3]) * self.width + word[some3]
        # the pair that a triple ends in, where there is one: the state its arc leads to
        ending = np.searchsorted(block.pairs, last[pair] * (n + 1) + word)
        self.to[size2:-1] = n + 2 + ending[some3]
        del word
        p2 = p2[ending]
        p2 *= k
        p2 += three
        del ending
        p2 /= two[pair] + k
        self.weight[size2:-1] = p2[some3]
        del p2, pair, some3
        np.log10(self.weight, out=self.weight)
        self.root = np.log10(root)
        self.root_to = np.where((one > 0) & (np.arange(n) != end), 1 + np.arange(n), 0)
        self.fail = np.concatenate([[0], np.zeros(n + 1, np.int32), (1 + last).astype(np.int32)])
        self.fail_weight = np.log10(np.concatenate([[1.0], m / (history + m), k / (two + k)]))
        self.start = n + 1 if history[n] > 0 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one token in each lane: the next states and the weights on the way, failure arcs included."""
        weight = np.zeros(len(state))
        to = np.empty(len(state), np.int64)
        lane = np.arange(len(state))
        while len(lane):
            code = state * self.width + word
            at = np.searchsorted(self.arcs, code)
            arc, root = self.arcs[at] == code, state == 0
            to[lane[arc]] = self.to[at[arc]]
            weight[lane[arc]] += self.weight[at[arc]]
            to[lane[root]] = self.root_to[word[root]]
            weight[lane[root]] += self.root[word[root]]
            left = ~(arc | root)
            lane, state, word = lane[left], state[left], word[left]
            weight[lane] += self.fail_weight[state]
            state = self.fail[state]
        return to, weight

    def traverse(self, tokens: np.ndarray, bounds: np.ndarray, stretch: int) -> np.ndarray:
        """The weight of each document."""
        n = -(-np.diff(bounds) // stretch)
        doc = np.repeat(np.arange(len(n)), n)
        begin = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stretch
        end = np.minimum(begin + stretch, bounds[doc + 1])
        order = np.argsort(begin - end, kind="stable")  # longest first, so that those still read are a front part
        doc, begin, end = doc[order], begin[order], end[order]
        state = np.where(begin == bounds[doc], self.start, 0)
        for back in (2, 1):
            known = np.flatnonzero(begin - back >= bounds[doc])
            state[known] = self.step(state[known], tokens[begin[known] - back])[0]
        out = np.zeros(len(doc))
        length = end - begin
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, "left"))
            state, weight = self.step(state[:live], tokens[begin[:live] + i])
            out[:live] += weight
        return np.bincount(doc, out, len(bounds) - 1)


def _scored(doc_ids: list, block: Block, counts: list[np.ndarray], total: int, seen: int, priors: tuple[float, float], stretch: int) -> pa.RecordBatch:
    model = Automaton(block, *counts, total, seen, priors)
    block.release()
    del counts[1:]
    add = lambda x: np.add.reduceat(x, block.bounds[:-1])  # noqa: E731  every document has a token
    known, n = counts[0][block.tokens] > 0, len(doc_ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()), pa.array(block.held), pa.array(np.diff(block.bounds)), pa.array(add(known.astype(np.int64))), pa.array(np.full(n, total, np.int64)),
            pa.array(add(model.root[block.tokens])), pa.array(model.traverse(block.tokens, block.bounds, stretch)),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
