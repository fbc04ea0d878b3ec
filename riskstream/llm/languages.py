"""Language identification by hyperdimensional profiles.

Every letter is a random vector of +1 and -1, made from its code point.  A letter with its two neighbours (what is no
letter is a boundary, which has a vector too) is bound into one: the product of the three vectors, each
permuted as often as its place says, so that "abc" and "cba" have next to nothing in common.  A text is the
bundle, the sum, of all of its letters' products; a language's prototype is the bundle of all texts it is learned from.
A text is given the language whose prototype has the largest cosine with it.

Texts are bundled in tasks: triples are counted, and the counts times the vectors of the distinct triples are the
bundle, in whole numbers, so it does not matter how texts are dealt.  Learning sums prototypes by
language and component, at most one row of each a task.  Prototypes are broadcast: `DIMENSIONS` numbers a language, and
more than `LANGUAGES` languages are refused.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned; rows
without language or letter teach nothing; ties go to the language that comes first by name; cosines below zero count as zero; very
long texts are bundled in slices that overlap by a letter; repeated rows each count; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import pieces

DIMENSIONS = 2048
#: Languages that prototypes may be learned for; they are broadcast and held by every task.
LANGUAGES = 4096
UNKNOWN = "und"
SEED = 12
#: Characters of one text bundled at a time, texts scored at a time, and triples whose vectors are made at a time.
SLICE, TEXTS, TRIPLES = 1 << 20, 256, 2048
#: Letters whose vectors a worker keeps.
_LETTERS = 8192


@cache
def letters() -> np.ndarray:
    """For each code point the one of its lower-case letter; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low if len(low) == 1 else c)
    return out


class Vectors:
    """Letters as vectors of +1 and -1, permuted for each of three places."""

    def __init__(self, dimensions: int, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        turn = np.random.Generator(np.random.Philox(key=[seed, 1 << 32])).permutation(dimensions)
        self.turns = [np.arange(dimensions), turn, turn[turn]]
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.tables = [np.zeros((64, self.dimensions), np.int8) for _ in self.turns]

    def rows(self, code_points: np.ndarray) -> np.ndarray:
        """Rows of the tables that hold the vectors of distinct code points, made now if they are new."""
        if len(self.row) + len(code_points) > _LETTERS:
            self.clear()
        for c in code_points.tolist():
            if c not in self.row:
                at = self.row[c] = len(self.row)
                if at == len(self.tables[0]):
                    self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
                own = np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.dimensions, np.int8) * 2 - 1
                for table, turn in zip(self.tables, self.turns):
                    table[at] = own[turn]
        return np.array([self.row[c] for c in code_points.tolist()], np.int64)

    def bound(self, triples: np.ndarray) -> np.ndarray:
        """The product vector of each triple."""
        points = [(triples >> np.int64(21 * place)) & np.int64((1 << 21) - 1) for place in (2, 1, 0)]
        known, at = np.unique(np.concatenate(points), return_inverse=True)
        rows = self.rows(known)[at].reshape(3, -1)
        return self.tables[0][rows[0]] * self.tables[1][rows[1]] * self.tables[2][rows[2]]


def triples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the letters of a text are, and each as one number with its neighbours."""
    z = np.zeros(len(text) + 2, np.int64)
    z[1:-1] = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(z[1:-1])
    return at, (z[at] << np.int64(42)) | (z[at + 1] << np.int64(21)) | z[at + 2]


def bundles(texts: list[str | None], group: np.ndarray, groups: int, vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of the texts of each group, and how many letters they have."""
    out, n = np.zeros((groups, vectors.dimensions)), np.zeros(groups, np.int64)
    for group_of, codes in _codes(texts, group):
        known, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(group_of * len(known) + at, minlength=groups * len(known)).reshape(groups, len(known))
        n += counts.sum(1)
        for i in range(0, len(known), TRIPLES):
            # a slice has fewer than 2**24 letters, so sums of its counts are whole in this precision too
            out += counts[:, i : i + TRIPLES].astype(np.float32) @ vectors.bound(known[i : i + TRIPLES]).astype(np.float32)
    return out, n


def _codes(texts: list[str | None], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups and triples of the letters of some texts together, or of a slice of a long one."""
    short = [(t, g) for t, g in zip(texts, group.tolist()) if t and len(t) <= SLICE]
    if short:
        at, codes = triples("\n".join(t for t, _ in short))
        ends = np.cumsum([len(t) + 1 for t, _ in short])
        yield np.array([g for _, g in short])[np.searchsorted(ends, at, "right")], codes
    for t, g in zip(texts, group.tolist()):
        if t and len(t) > SLICE:
            for i in range(0, len(t), SLICE):
                before = min(i, 1)
                at, codes = triples(t[i - before : i + SLICE + 1])
                inside = (at >= before) & (at < before + SLICE)
                yield np.full(inside.sum(), g), codes[inside]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of labelled(text, lang), by name."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dimensions), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(total.astype(np.int64))], ["lang", "place", "total"])
            sums.clear()

        for batch in _parts(batches):
            names = batch.column("lang").to_pylist()
            known = sorted(set(names))
            group = np.array([known.index(x) for x in names])
            made, n = bundles(batch.column("text").to_pylist(), group, len(known), vectors)
            for lang, row, some in zip(known, made, n):
                if some:
                    sums[lang] = sums[lang] + row if lang in sums else row
            if len(sums) > TEXTS:
                yield from flush()
        yield from flush()

    own = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = own.mapInArrow(task, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    rows = sums.limit(LANGUAGES * dimensions + 1).collect()
    if len(rows) > LANGUAGES * dimensions:
        raise ValueError(f"more than {LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for lang, place, total in rows:
        out.setdefault(lang, np.zeros(dimensions))[place] = total
    return dict(sorted(out.items()))


def predict(documents: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, n_letters of each row of documents(doc_id, text)."""
    names = np.array([*prototypes, UNKNOWN], dtype=object)
    dimensions = len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS
    matrix = np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dimensions))
    sent = documents.sparkSession.sparkContext.broadcast(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(dimensions)
        for batch in _parts(batches):
            made, n = bundles(batch.column("text").to_pylist(), np.arange(batch.num_rows), batch.num_rows, vectors)
            cosine = made @ sent.value.T / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)
            known = (n > 0) & (cosine.shape[1] > 0)
            best = cosine.argmax(1) if cosine.shape[1] else np.zeros(len(n), np.int64)
            score = np.where(known, np.clip(cosine[np.arange(len(n)), best], 0, 1), 0.0) if cosine.shape[1] else np.zeros(len(n))
            guess = names[np.where(known, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(guess.tolist(), pa.string()), pa.array(score), pa.array(n)], ["doc_id", "lang_pred", "score", "n_letters"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, lang_pred string, score double, n_letters long")
