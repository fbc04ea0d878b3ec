"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

A merge table fixes, for every byte string, one sequence of tokens.  Two facts
make that a left-to-right machine.  A sequence is the one of its bytes exactly
if every pair of neighbours is (their joined bytes encode to just these two), and
so the encoding of each prefix ends in one token, which is the prefix's own encoding
continued.  The nondeterministic machine has a thread for every place where a token
may have begun: its node in the trie of tokens, and the chain of tokens before it from the last that is out.  Its subset construction is made as texts reach it: a state is the tuple of live
threads, which settles all that can follow.  On a byte, of the tokens that end there the one that is sound behind
its thread's token ends the prefix, and begins a new thread; what all live threads have in common at the front of
their chains goes out with the step.  So a token is emitted when no live thread began
inside it or before it, at most the longest token's length later, and a step is one look-up of (state, byte).

Decoding looks bytes up and feeds a UTF-8 state machine, whose steps are kept for
each pair of state and token, so that a stream may be cut at any token.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a text of any length is one
run of the machine for each match of the pattern, with no more pending than the longest token; extra
columns are ignored; repeated rows and ids each give a row; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskstream.llm.common import pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
_STATES = 200_000  # states are dropped beyond this and made anew
_KEPT = 500_000  # and so are words, of this many bytes at most
_KEPT_BYTES = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best > len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Emits the tokens of one byte string at a time: a match of the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                to = self.child[node].get(b)
                if to is None:
                    to = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = rank
        self.none = max(ranks.values()) + 1
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.sound: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, tuple[int, ...]], ...]] = []  # live threads (node, chain), oldest first
        self.known: dict[tuple, int] = {}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state << 8 | byte
        self._state(((0, (-1,)),))

    def _state(self, key: tuple) -> int:
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.states)
            self.states.append(key)
        return at

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of a token as its merges go on: from a byte up to all of it, each with its rank."""
        out = self.edges[side].get(token)
        if out is None:
            word = self.bytes[token]
            if len(word) == 1:
                out = [(word, -1)]
            else:
                parts = [word[i : i + 1] for i in range(len(word))]
                while len(parts) > 2:
                    _, at = min((self.ranks.get(a + b, self.none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                out = [*self._edge(self.ranks[parts[side]], side), (word, token)] if parts[side] in self.ranks else [(word, token)]
            self.edges[side][token] = out
        return out

    def _follows(self, a: int, b: int) -> bool:
        """Whether b is a token of its own bytes, and stands after a in the encoding of both: no merge across the edge comes first."""
        ok = self.sound.get(b)
        if ok is None:
            ok = self.sound[b] = merge(self.bytes[b], self.ranks) == [b]
        if not ok or a < 0:
            self.pairs[a << 20 | b] = ok
            return ok
        ok = self.pairs.get(a << 20 | b)
        if ok is None:
            if len(self.pairs) > 2 * _STATES:
                self.pairs.clear()
            left, right, rank, none = self._edge(a, 1), self._edge(b, 0), self.ranks.get, self.none
            i = j = 0
            while True:
                across = rank(left[i][0] + right[j][0], none)
                one = left[i + 1][1] if i + 1 < len(left) else none
                two = right[j + 1][1] if j + 1 < len(right) else none
                if across < none and across < one and across <= two:
                    ok = False
                    break
                if one == two == none:
                    ok = True
                    break
                if one <= two:
                    i += 1
                else:
                    j += 1
            self.pairs[a << 20 | b] = ok
        return ok

    def _move(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that go out on the way."""
        child, tokens, pairs = self.child, self.token, self.pairs
        live, ended = [], None
        for node, chain in self.states[at]:
            to = child[node].get(byte)
            if to is None:
                continue
            if child[to]:
                live.append((to, chain))
            token = tokens[to]
            if ended is None and token >= 0:
                before = chain[-1]
                ok = pairs.get(before << 20 | token)
                if ok is None:
                    ok = self._follows(before, token)
                if ok:
                    ended = (*chain, token)
        assert ended, "the vocabulary lacks a byte"
        if not live:
            return self._state(((0, ended[-1:]),)), ended[1:]
        live.append((0, ended))
        if len(live[0][1]) == 1:  # that thread stands right behind the last token that is out, so nothing goes out
            return self._state(tuple(live)), ()
        least, most = min(t[1] for t in live), max(t[1] for t in live)
        n = 1  # all begin with the last token that is out
        for a, b in zip(least[1:], most[1:]):
            if a != b:
                break
            n += 1
        if len(least) > n:
            live = [(node, (-1, *chain[n:])) for node, chain in live]  # no thread stands right behind the last token that is out
        elif n > 1:
            live = [(node, chain[n - 1 :]) for node, chain in live]
        return self._state(tuple(live)), least[1:n]

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        at, step, add = 0, self.step, out.extend
        for byte in data:
            to = step.get(at << 8 | byte)
            if to is None:
                if len(self.states) > _STATES:
                    now = self.states[at]
                    self._reset()
                    at, step = self._state(now), self.step
                to = step[at << 8 | byte] = self._move(at, byte)
            at, emitted = to
            if emitted:
                add(emitted)
        add(self.states[at][-1][1][1:])  # the thread that begins here has all tokens behind it
        return out


#: UTF-8 states: 0 between characters; 1 to 3 that many continuation bytes missing; then the four whose next byte is bounded; the last is an error.
_BAD = 8


def _utf8(state: int, b: int) -> int:
    if state == 0:
        if b < 0x80:
            return 0
        if 0xC2 <= b <= 0xDF:
            return 1
        if b in (0xE0, 0xED):
            return 4 if b == 0xE0 else 5
        if 0xE1 <= b <= 0xEF:
            return 2
        if b in (0xF0, 0xF4):
            return 6 if b == 0xF0 else 7
        return 3 if 0xF1 <= b <= 0xF3 else _BAD
    if state <= 3:
        return state - 1 if 0x80 <= b <= 0xBF else _BAD
    low, high, to = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, 0))
    return to if low <= b <= high else _BAD


class Decoder:
    """A stream of ids to bytes; state is 0 where the bytes so far end with a whole character."""

    def __init__(self, table: dict[int, bytes]):
        self.table, self.state = table, 0
        self.steps: list[dict[int, int]] = [{} for _ in range(_BAD + 1)]

    def feed(self, ids: Iterable[int]) -> bytes:
        state, steps, table, out = self.state, self.steps, self.table, []
        for i in ids:
            to = steps[state].get(i)
            if to is None:
                to = state
                for b in table[i]:
                    to = _utf8(to, b)
                steps[state][i] = to
            state = to
            out.append(table[i])
        self.state = state
        return b"".join(out)


class Codec:
    def __init__(self, path: str, split: str):
        self.machine = Transducer(load(path))
        self.find = regex.compile(split).findall
        self.kept: dict[str, tuple[int, ...]] = {}  # tuples of numbers, which the garbage collector does not follow
        self.digits = {i: str(i) for i in self.machine.bytes}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept, add = self.kept, out.extend
        for piece in self.find(text):
            ids = kept.get(piece)
            if ids is None:
                data = piece.encode()
                ids = tuple(self.machine.encode(data))
                if len(data) <= _KEPT_BYTES:
                    if len(kept) > _KEPT:
                        kept.clear()
                    kept[piece] = ids
            add(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        decoder = Decoder(self.machine.bytes)
        decoder.steps = self.__dict__.setdefault("_steps", decoder.steps)
        out = decoder.feed(ids)
        if decoder.state:
            raise ValueError("the ids do not decode to whole UTF-8 characters")
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, split: str) -> Codec:
    """One for each worker process."""
    have = _codecs.get((path, split))
    if have is None:
        have = _codecs[path, split] = Codec(path, split)
    return have


def encode(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every document of docs(doc_id, text)."""
    path, split = path or vocabulary_path(), split or pattern()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        for batch in pieces(batches, "text"):
            for ids_, texts in _slices(batch):
                ids = [own.encode(t) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([ids_, pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """Encoded and decoded as encode() does, with digests in place of the ids and bytes."""
    path, split = path or vocabulary_path(), split or pattern()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        for batch in pieces(batches, "text"):
            for doc_ids, texts in _slices(batch):
                n, one, two = [], [], []
                for t in texts:
                    ids = own.encode(t) if t else []
                    n.append(len(ids))
                    one.append(hashlib.sha256(" ".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                    two.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, n: int = 256) -> Iterator[tuple[pa.Array, list]]:
    for at in range(0, batch.num_rows, n):
        part = batch.slice(at, n)
        yield part.column(0), part.column(1).to_pylist()
