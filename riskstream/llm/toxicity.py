"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of four rows of one hashed table: two independent
hashes of the word, so that a chance collision carries little weight, and two of
its first bytes, so that inflected forms share something.  Filters of widths 1 to 3
run over whole texts; the largest response of each, wherever it stands, goes to a
logistic output.  Training is Adam in numpy, in tasks.  Only the largest
responses have gradients, so a step costs little more than a forward pass.

Every labelled row outside the held-out fold is learned from, whole and whatever its length or number.  They are
packed into shards of about `SHARD_BYTES` of text, be it one or many.  Each is
trained on in its own task from the common model, `ROUNDS` times, and what the tasks changed is averaged, a row of the table over
the shards that touched it, so that rare words learn as fast as frequent ones.  Sums are made by parts of the table and
`FAN` shards at a time; the driver only ever holds the models, whatever the input.

Calibration uses every one of those rows as well: two more models learn from one half of the texts each, and each
scores the half that it has not seen.  Over all these scores, counted in steps of 1 / `STEPS`, the score is shifted so that the best F1
falls at 0.7, and each language gets a threshold of its own on that score.  Scores come from the text
alone; language chooses only which threshold a decision uses.

Defined cases: a null, empty or wordless text scores as the model's response to no
words; without labels of both classes the score is the share of toxic labels
(0 if there is none), held below the threshold; of contradicting labels of an id the toxic one counts;
a text of any length is scored whole, in one pass; repeated rows and ids each give a row; extra columns stay and ones
named like the results of score() are replaced, while clean() keeps all columns as they came; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import bytes_hash, crc_remainder, drop, pieces, sieved, words, written
from riskstream.llm.language_model import pack, unpack

THRESHOLD = 0.7
BITS = 19
DIM = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)  # bytes
ROWS = 2 + len(PREFIXES)
EPOCHS = 6
BATCH = 24
SHARD_BYTES = 16 << 20
ROUNDS = 6  # each of EPOCHS / ROUNDS epochs
FAN = 256
STEPS = 1000
RATE = 0.01
SEED = 7
_PART = 15  # bits of rows in a part of the table
_LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word (n x ROWS), and bounds of documents among words. Case of A-Z and ASCII punctuation do not matter."""
    w = words(texts, lower=True, word_bytes=_LETTERS)
    mask = np.uint64((1 << BITS) - 1)
    fronts = [bytes_hash(w.data, w.start, np.minimum(w.end, w.start + n)) >> np.uint64(7 + n) for n in PREFIXES]
    ids = np.stack([w.hash & mask, (w.hash >> np.uint64(32)) & mask, *(f & mask for f in fronts)], 1)
    return ids.astype(np.int32), w.first


@dataclass
class Model:
    table: np.ndarray  # 2**BITS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray  # widths * FILTERS
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Largest response of each filter in each document, where it stands (-1: nowhere above 0), and the words' vectors."""
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.table[ids[:, k]]
        n, docs = len(x), len(bounds) - 1
        best = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(best.shape, -1, np.int64) if where else None
        for k, width in enumerate(WIDTHS):
            if n < width:
                continue
            m = n - width + 1
            r = x[:m] @ self.filters[k][0]
            for j in range(1, width):
                r += x[j : j + m] @ self.filters[k][j]
            some = np.flatnonzero(np.diff(bounds) >= width)
            if not len(some):
                continue
            lo, hi = bounds[some], bounds[some + 1] - width + 1
            cut = np.stack([lo, hi], 1).ravel()
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(np.append(r, np.full((1, FILTERS), -np.inf, np.float32), 0), np.minimum(cut, m), 0)[::2]
            best[some, cols] = np.maximum(top + self.bias[cols], 0)
            if where:
                for d, a, b in zip(some, lo, hi):
                    at[d, cols] = r[a:b].argmax(0) + a
        if where:
            at[best <= 0] = -1
        return best, at, x

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(ids, bounds)[0] @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        z = np.clip(self.logits(ids, bounds).astype(np.float64) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def _best_cut(z: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The cut of best F1 among n rows at each z, toxic of them so; among equals, the middle of the widest gap."""
    order = np.argsort(-z)
    z, toxic, n = z[order], toxic[order], n[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    gap = z - np.append(z[1:], z[-1] - 2)
    i = max(np.flatnonzero(f1 >= f1.max() - 1e-9), key=lambda j: gap[j])
    return float(z[i] - gap[i] / 2)


def _fresh(rng: np.random.Generator) -> Model:
    width = len(WIDTHS) * FILTERS
    return Model(
        rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32),
        [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(width, np.float32), rng.normal(0, 0.3, width).astype(np.float32), 0.0,
    )


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Model:
    """Fits on word rows of documents (each n x ROWS) and their 0/1 labels."""
    rng = np.random.default_rng(seed)
    model = _fresh(rng)
    _learn(model, docs.__getitem__, labels, float(labels.mean()), EPOCHS, rng)
    return model


def _learn(model: Model, doc: Callable[[int], np.ndarray], labels: np.ndarray, share: float, epochs: int, rng: np.random.Generator, part: tuple[float, float] = (0.0, 1.0)) -> None:
    """Trains the model in place on documents doc(0), doc(1), ...; share: of toxic ones among all that are learned from.

    part: of the whole training that this is, over which the rate falls to a tenth.
    """
    dense = [*model.filters, model.bias, model.out]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    t1, t2 = np.zeros_like(model.table), np.zeros_like(model.table)
    b1 = b2 = 0.0
    step, steps = 0, epochs * -(-len(labels) // BATCH)
    weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            docs = [doc(r) for r in rows]
            ids = np.concatenate(docs)
            bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            best, at, x = model.pooled(ids, bounds, True)
            p = 1 / (1 + np.exp(-np.clip(best @ model.out + model.out_bias, -30, 30)))
            g = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = g[:, None] * model.out * (best > 0)
            grads = [np.zeros_like(f) for f in model.filters] + [back.sum(0), best.T @ g + 1e-4 * model.out]
            d, f = np.nonzero(at >= 0)
            spot, value = at[d, f], back[d, f]
            touched, change = [], []
            for k, w in enumerate(WIDTHS):
                own = (f >= k * FILTERS) & (f < (k + 1) * FILTERS)
                col = f[own] - k * FILTERS
                for j in range(w):
                    pos = spot[own] + j
                    np.add.at(grads[k][j].T, col, value[own, None] * x[pos])
                    touched.append(pos)
                    change.append(value[own, None] * model.filters[k][j].T[col])
            rate = RATE * (1 - 0.9 * (part[0] + (part[1] - part[0]) * step / steps))
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for q, (param, grad) in enumerate(zip(dense, grads)):
                m1[q] += 0.1 * (grad - m1[q])
                m2[q] += 0.001 * (grad * grad - m2[q])
                param -= rate * (m1[q] / fix1) / (np.sqrt(m2[q] / fix2) + 1e-8)
            b1 += 0.1 * (g.sum() - b1)
            b2 += 0.001 * (g.sum() ** 2 - b2)
            model.out_bias -= rate * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8)
            if touched:
                pos, delta = np.concatenate(touched), np.concatenate(change)
                row, inverse = np.unique(ids[pos].ravel(), return_inverse=True)
                grad = np.zeros((len(row), DIM), np.float32)
                np.add.at(grad, inverse.ravel(), np.repeat(delta, ROWS, 0))
                t1[row] = 0.9 * t1[row] + 0.1 * grad
                t2[row] = 0.99 * t2[row] + 0.01 * grad * grad
                model.table[row] -= rate * t1[row] / (np.sqrt(t2[row]) + 1e-6) + 1e-4 * model.table[row]


class _Shard:
    """Documents that a model learns from together: places of their words in a vocabulary of table rows, labels and languages."""

    def __init__(self, row: dict):
        self.vocabulary, self.words = unpack(row["vocabulary"], np.int32).reshape(-1, ROWS), unpack(row["words"], np.uint32)
        self.first = np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])
        self.label, self.lang = np.array(row["label"], np.int64), row["lang"]
        self.number, self.model = row["shard"], row["model"]

    def doc(self, i: int) -> np.ndarray:
        return self.vocabulary[self.words[self.first[i] : self.first[i + 1]]]


_SHARD = "shard long, model int, vocabulary binary, words binary, lengths binary, label array<int>, lang array<string>"
_CHANGE = "model int, part int, shard long, rows binary, sums binary, times binary"


def _shards(found: DataFrame, n: int, halves: bool) -> DataFrame:
    """found(doc_id, row, text, lang, label, half) dealt out evenly to n shards, each for the model of all rows and, if asked for, the two models of halves."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, rest = [], [], []
        for batch in pieces(batches, "text"):
            own, first = features(batch.column(0))
            ids.append(own)
            lengths.append(np.diff(first))
            rest.append(pa.Table.from_batches([batch.select(range(1, 7))]))
        if not ids:
            return
        every, length, rest = np.concatenate(ids), np.concatenate(lengths), pa.concat_tables(rest)
        ids.clear()
        # a word is known by its own two hashes and one of its prefixes
        code = every[:, 0] | every[:, 1].astype(np.int64) << BITS | every[:, 2].astype(np.int64) << 2 * BITS
        _, at, place = np.unique(code, return_index=True, return_inverse=True)
        vocabulary, place, start = pack(every[at].ravel()), place.astype(np.uint32), np.cumsum(length) - length
        order = pc.sort_indices(rest, [("doc_id", "ascending"), ("row", "ascending")]).to_numpy().astype(np.int64)
        half = rest.column("half").to_numpy()[order]
        for model in range(3) if halves else [0]:
            own = order[half == model] if halves and model < 2 else order
            if len(own):
                size = length[own]
                words = place[np.arange(size.sum()) + np.repeat(start[own] - (np.cumsum(size) - size), size)]
                mine = rest.take(pa.array(own))
                cells = [mine.column("shard")[0].as_py(), model, vocabulary, pack(words), pack(size.astype(np.int64)), mine.column("label").to_pylist(), mine.column("lang").to_pylist()]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["shard", "model", "vocabulary", "words", "lengths", "label", "lang"])

    dealt = found.repartition(n).withColumn("shard", F.spark_partition_id().cast("long"))
    return dealt.select("text", "doc_id", "row", "lang", "label", "half", "shard").mapInArrow(rows, _SHARD).repartition(n * (3 if halves else 1))


def _dense(model: Model) -> list[np.ndarray]:
    return [*model.filters, model.bias, model.out]


def _flat(model: Model) -> np.ndarray:
    """All parameters but the table, as rows of its width."""
    flat = np.concatenate([*(p.ravel() for p in _dense(model)), [model.out_bias]]).astype(np.float32)
    return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table (the others' behind), summed changes and how many shards touched each, added up."""
    row, sums, times = (np.concatenate([unpack(c, t) for c in table.column(k).to_pylist()]) for k, t in (("rows", np.int32), ("sums", np.float32), ("times", np.int32)))
    keys, at = np.unique(row, return_inverse=True)
    out = np.zeros((len(keys), DIM), np.float32)
    np.add.at(out, at, sums.reshape(-1, DIM))
    return keys, out, np.bincount(at, times, len(keys)).astype(np.int32)


def _change(model: int, part: int, shard: int, rows: np.ndarray, sums: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    cells = (model, part, shard, pack(rows.astype(np.int32)), pack(sums.astype(np.float32).ravel()), pack(times.astype(np.int32)))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["model", "part", "shard", "rows", "sums", "times"])


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")
    return pa.Table.from_batches([_change(*(table.column(k)[0].as_py() for k in ("model", "part", "to")), *_unpacked(table))])


def _round(shards: DataFrame, models: list[Model], shares: list[float], number: int, n: int) -> None:
    """The models train on from where they are, each on its shards; they move by the mean of the changes."""
    sent = shards.sparkSession.sparkContext.broadcast(models)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard(batch.slice(i, 1).to_pylist()[0])
                before = sent.value[shard.model]
                rng = np.random.default_rng([SEED, number, shard.number, shard.model])
                model = Model(before.table.copy(), [f.copy() for f in before.filters], before.bias.copy(), before.out.copy(), before.out_bias)
                _learn(model, shard.doc, shard.label, shares[shard.model], EPOCHS // ROUNDS, rng, (number / ROUNDS, (number + 1) / ROUNDS))
                model.table -= before.table
                row = np.flatnonzero(model.table.any(1))
                for part in np.unique(row >> _PART):
                    mine = row[row >> _PART == part]
                    yield _change(shard.model, int(part), shard.number, mine, model.table[mine], np.ones(len(mine)))
                flat = _flat(model) - _flat(before)
                yield _change(shard.model, -1, shard.number, (1 << BITS) + np.arange(len(flat)), flat, np.ones(len(flat)))

    changes, left = shards.mapInArrow(rows, _CHANGE), n
    while True:
        left = -(-left // FAN)
        changes = changes.withColumn("to", F.floor(F.col("shard") / FAN)).groupBy("model", "part", "to").applyInArrow(_added, _CHANGE)
        if left == 1:
            break
    for r in changes.toArrow().to_batches(1):
        row, sums, times = _unpacked(pa.Table.from_batches([r]))
        model, mean = models[r.column(0)[0].as_py()], sums / times[:, None]
        if r.column(1)[0].as_py() >= 0:
            model.table[row] += mean
            continue
        flat = (_flat(model) + mean).ravel()
        at = 0
        for p in _dense(model):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        model.out_bias = float(flat[at])
    sent.destroy()


def _counted(shards: DataFrame, models: list[Model]) -> DataFrame:
    """lang, z (in steps), toxic, n: of all rows, each scored by the model of the other half, or by the only one."""
    sent = shards.sparkSession.sparkContext.broadcast(models)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard(batch.slice(i, 1).to_pylist()[0])
                model = sent.value[len(sent.value) - 1 - shard.model]
                z = []
                for j in range(0, len(shard.label), BATCH):
                    docs = [shard.doc(d) for d in range(j, min(j + BATCH, len(shard.label)))]
                    z.append(model.logits(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])))
                step = np.floor(np.clip(np.concatenate(z), -40, 40) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.lang, pa.string()), pa.array(step), pa.array(shard.label)], ["lang", "z", "label"])

    shards = shards.where(F.col("model") < len(models))
    scored = shards.mapInArrow(rows, "lang string, z long, label long")
    return written(scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "z").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")), "cuts")


def fit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """docs(doc_id, text, lang) with labels(doc_id, toxic); only labels whose crc32(doc_id) mod 3 is not 1 are seen, and all of those."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_remainder(F.col("doc_id"), 3) != 1)
    known = known.groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), "lang")
    # copies of a text are in one half
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).cast("int")
    found = sieved(text, "doc_id", known).join(known, "doc_id").select("doc_id", F.xxhash64("text").alias("row"), "text", "lang", "label", half.alias("half"))
    found = written(found, "labelled")
    counts = {(r.half, r.label): r for r in found.groupBy("half", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    count = np.array([[counts[h, y].n if (h, y) in counts else 0 for y in (0, 1)] for h in (0, 1)])
    if not count.sum(0).all():
        return Model(np.zeros((0, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=min(float(count.sum(0)[1] / max(count.sum(), 1)), THRESHOLD - 0.01))
    n = -(-sum(r.size for r in counts.values()) // shard_bytes) or 1
    parts = [*count, count.sum(0)] if count.all() else [count.sum(0)]
    shards = written(_shards(found, n, len(parts) > 1), "shards")
    drop(docs.sparkSession, found)
    models = [_fresh(np.random.default_rng(SEED)) for _ in parts]
    for number in range(ROUNDS):
        _round(shards, models, [float(c[1] / c.sum()) for c in parts], number, n)
    cuts = _counted(shards, models[:2])
    model = models[-1]
    best = lambda rows: _best_cut(*np.array([((r.z + 0.5) / STEPS, r.toxic, r.n) for r in rows]).T)  # noqa: E731  at most 80 steps * STEPS rows, for each language
    total = cuts.groupBy("z").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect()
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - best(total)
    often = cuts.groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("toxic >= 20 and n - toxic >= 20").select("lang").collect()
    for (name,) in often:
        cut = best(cuts.where(F.col("lang") == name).collect()) + model.shift
        model.thresholds[name] = float(min(max(1 / (1 + np.exp(-cut)), 0.4), 0.9))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, threshold (of the document's language) and rejected; other columns stay, and a clashing one is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "threshold", "rejected")
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double, threshold double, rejected boolean"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            got, cut = _judged(sent.value, batch, names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array(cut), pa.array(got >= cut)], [*names, "score", "threshold", "rejected"])

    return docs.mapInArrow(rows, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they came, that the model does not reject at their language's threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            got, cut = _judged(sent.value, batch, names)
            yield batch.filter(pa.array(got < cut))

    return docs.mapInArrow(rows, docs.schema)


def _judged(model: Model, batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a batch's texts, and the thresholds of their languages."""
    got = model.scores(*features(batch.column(names.index("text"))))
    lang = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(got)
    return got, np.array([model.thresholds.get(x or "", THRESHOLD) for x in lang], np.float64)
