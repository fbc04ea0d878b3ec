"""Secrets, with the parts of multipart credentials linked.

Strong spans stand by themselves: assignments to a secret's name, access
identifiers of a fixed prefix, long runs of hexadecimal digits.  Weak ones (account
identifiers, bare high-variety strings, service endpoints) mean little alone.
Within a scope, which is a stretch of text between blank lines, spans are joined
by distance: a weak span is reported only if a part of a kind it completes stands
within `reach` code points in the same scope; a span belongs to the scope it starts in.
The join is a search in the sorted starts of each kind, which carry the largest end so far,
so its cost follows the spans and not their pairs.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and
then by the order of KINDS.  Defined cases: a null or empty text has no spans; a text of
any length is searched whole, in time n log n; repeated rows and repeated or null doc_ids
each give a row; extra columns are ignored by scan() and kept by redact(); an empty table
gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from riskstream.llm.common import pieces

KINDS = ("assign", "access", "hex", "account", "bare", "endpoint")
REACH = 240
_ASCII = re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | _ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", _ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", _ASCII)
_ACCOUNT = re.compile(r"""\b(?:client_?id|account(?:_?id)?|access_?key_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""", re.I | _ASCII)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", _ASCII)
_ENDPOINT = re.compile(r"\b(?:https?|wss?|amqps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+", re.I | _ASCII)
_SCOPE = re.compile(r"\n[\x20\t\r]*\n")
#: Which kinds complete a weak one. A weak kind may complete another weak one: identifier, secret and endpoint are the three parts.
COMPLETES = {
    "account": ("assign", "hex", "bare"),
    "bare": ("access", "account", "endpoint"),
    "endpoint": ("assign", "access", "hex", "bare"),
}

Span = tuple[str, int, int]


def base(text: str) -> list[Span]:
    """Strong spans, unsorted; the kinds do not exclude one another."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _varied(s: str) -> bool:
    """Upper case, lower case and digits: what random keys have and words do not."""
    return any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and any("0" <= c <= "9" for c in s)


def weak(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates that no strong span and no endpoint covers."""

    def open_between(spans: Iterable[Span]):
        """Whether no span reaches into [a, b): of those that start before b, none ends after a."""
        taken = sorted((a, b) for _, a, b in spans)
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

        def free(a: int, b: int) -> bool:
            i = bisect_left(starts, b)
            return i == 0 or ends[i - 1] <= a

        return free

    free = open_between(strong)
    ends = [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    out = [("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text) if free(m.start(), m.end())]
    free = open_between([*strong, *ends, *out])
    out += [("bare", m.start(), m.end()) for m in _BARE.finditer(text) if _varied(m[0]) and free(m.start(), m.end())]
    return out + ends


def linked(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Strong spans, and the weak ones that a complementary part stands near to within their scope; both in order."""
    strong = base(text)
    found = weak(text, strong)
    kept: list[Span] = []
    if found and len(strong) + len(found) > 1:
        breaks = [m.start() for m in _SCOPE.finditer(text)]
        rows: dict[str, list[tuple[int, int, int]]] = {}  # scope, start and the largest end so far in the scope
        for kind, a, b in sorted([*strong, *found], key=lambda s: s[1]):
            row, scope = rows.setdefault(kind, []), bisect_left(breaks, a)
            row.append((scope, a, max(b, row[-1][2]) if row and row[-1][0] == scope else b))
        for kind, a, b in found:
            scope = bisect_left(breaks, a)
            for other in COMPLETES[kind]:
                row = rows.get(other, [])
                i = bisect_right(row, (scope, b + reach, len(text) + 1))
                if i and row[i - 1][0] == scope and row[i - 1][2] >= a - reach:
                    kept.append((kind, a, b))
                    break
    key = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(strong, key=key), sorted(kept, key=key)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Of docs(doc_id, text): counts by kind, a digest of the strong spans, and all spans."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda s: (s[1], KINDS.index(s[0]))
        for batch in pieces(batches, "text"):
            n: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for text in batch.column(1):
                strong, more = linked(text.as_py() or "", reach)
                for k, kind in enumerate(KINDS[:3]):
                    n[k].append(sum(s[0] == kind for s in strong))
                n[3].append(len(more))
                digest.append(hashlib.sha256(_joined(strong).encode()).hexdigest())
                spans.append(_joined(sorted([*strong, *more], key=key)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(n[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(docs: DataFrame, reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of text replaced by mark; n_chars, where there is one, counts the new text. Other columns stay."""
    names = docs.columns
    column = names.index("text")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column(column).to_pylist()
            for i, text in enumerate(texts):
                strong, more = linked(text or "", reach)
                if strong or more:
                    out, done = [], 0
                    for _, a, b in sorted([*strong, *more], key=lambda s: s[1:]):
                        if a >= done:
                            out += [text[done:a], mark]
                        done = max(done, b)
                    texts[i] = "".join(out) + text[done:]
            columns = [pa.array(texts, pa.string()) if k == column else batch.column(k) for k in range(len(names))]
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(rows, docs.schema)
