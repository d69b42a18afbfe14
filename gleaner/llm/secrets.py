"""Secret scan with a trigram inverted index.

Each rule is a regular expression. From its parse tree comes a Boolean query of trigrams that every match must contain.
Documents are indexed in segments: postings (trigram -> documents of the segment) of the folded bytes, for the trigrams
that any rule asks for. A rule's query intersects and unites postings, and only the documents left are verified with the
expression itself, over their whole text. A rule without mandatory trigrams (hex) scans all documents; there, a run of
that length shows on a grid of samples, so that whole segments are tested at once.

Spans count code points, end exclusive. Null text is empty: no spans, and base_sha256 of the empty string. Texts are scanned
whole, however long; repeated rows have the same spans, an empty table gives no rows, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import as_bytes, parts


@dataclass(frozen=True)
class Rule:
    """group: the one whose length counts; least: the characters it must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join((*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")))

# The three base rules, in the order in which they are listed.
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Rules beyond the base: their spans only come on top.
MORE = (
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"Bearer\x20+([A-Za-z0-9+/_.=-]+)", 1, 16),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,30}://[^\s/:@]+:([^\s/:@]+)@", 1, 3),
)

ALL = True  # the query that every document fits


def _and(a, b):
    return b if a is ALL else a if b is ALL else ("and", a, b)


def _or(a, b):
    return ALL if a is ALL or b is ALL else ("or", a, b)


def _need(strings: set[str]):
    """The query of a text that contains one of ``strings``."""
    out = None
    for s in sorted(strings):
        if len(s) < 3:
            return ALL
        own = ALL
        for i in range(len(s) - 2):
            own = _and(own, s[i : i + 3])
        out = own if out is None else _or(out, own)
    return ALL if out is None else out


_LIMIT = 64  # strings that an exact set may hold before it is turned into a query


@dataclass
class _Info:
    """exact: the folded strings it matches, if few; else None, then prefix and suffix sets and the query hold."""

    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    query: object


def _of(strings: set[str]) -> _Info:
    return _Info(strings, strings, strings, ALL)


_ANY = {""}


def _join(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _LIMIT:
        return _of({x + y for x in a.exact for y in b.exact})
    cross = {x + y for x in a.suffix for y in b.prefix} if len(a.suffix) * len(b.prefix) <= _LIMIT else {""}
    query = _and(_and(_solid(a), _solid(b)), _need(cross) if all(len(x) >= 3 for x in cross) else ALL)
    prefix = {x + y for x in a.exact for y in b.prefix} if a.exact is not None and len(a.exact) * len(b.prefix) <= _LIMIT else a.prefix
    suffix = {x + y for x in a.suffix for y in b.exact} if b.exact is not None and len(b.exact) * len(a.suffix) <= _LIMIT else b.suffix
    return _Info(None, prefix, suffix, query)


def _solid(x: _Info):
    return _need(x.exact) if x.exact is not None else x.query


def _either(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= _LIMIT:
        return _of(a.exact | b.exact)
    return _Info(None, a.prefix | b.prefix, a.suffix | b.suffix, _or(_solid(a), _solid(b)))


def _walk(tree) -> _Info:
    out = _of({""})
    for op, arg in tree:
        if op is sre.LITERAL:
            out = _join(out, _of({_fold(chr(arg))}))
        elif op is sre.IN:
            chars = _members(arg)
            out = _join(out, _of(chars) if chars and len(chars) <= 4 else _Info(None, _ANY, _ANY, ALL))
        elif op is sre.SUBPATTERN:
            out = _join(out, _walk(arg[3]))
        elif op is sre.BRANCH:
            either = None
            for part in arg[1]:
                own = _walk(part)
                either = own if either is None else _either(either, own)
            out = _join(out, either)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, part = arg
            own = _walk(part)
            if (least, most) == (0, 1):
                out = _join(out, _either(own, _of({""})))
            elif least == 0:
                out = _join(out, _Info(None, _ANY, _ANY, ALL))
            else:
                out = _join(out, _Info(None, own.prefix, own.suffix, _solid(own)))
        elif op is not sre.AT:
            out = _join(out, _Info(None, _ANY, _ANY, ALL))
    return out


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(chr(arg)))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {_fold(chr(i)) for i in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def trigram_query(pattern: str):
    """ALL, a trigram, or ("and" | "or", query, query): what the ASCII-folded text of any match must contain. Only ASCII
    patterns have one."""
    if not pattern.isascii():
        return ALL
    info = _walk(sre_parser.parse(pattern))
    query = _solid(info)
    return query if info.exact is not None else _and(_and(query, _need(info.prefix)), _need(info.suffix))


def trigrams_of(query) -> set[str]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, str) else trigrams_of(query[1]) | trigrams_of(query[2])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_HEX = np.zeros(256, dtype=bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """The inverted index of some documents' folded bytes for the trigrams of ``wanted`` (a table of 2^24 marks)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> None:
        folded = _FOLD[data].astype(np.int32)
        code = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:] if len(data) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(wanted[code])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[doc + 1]
        pairs = np.unique(code[at[inside]].astype(np.int64) << 32 | doc[inside])
        key, self._docs = pairs >> 32, pairs & 0xFFFFFFFF
        self._keys, self._first = np.unique(key, return_index=True)
        self._end = np.append(self._first[1:], len(key))
        self._n = len(offsets) - 1

    def postings(self, trigram: str) -> np.ndarray:
        k = np.searchsorted(self._keys, code := _code(trigram))
        return self._docs[self._first[k] : self._end[k]] if k < len(self._keys) and self._keys[k] == code else self._docs[:0]

    def search(self, query) -> np.ndarray:
        if query is ALL:
            return np.arange(self._n)
        if isinstance(query, str):
            return self.postings(query)
        a = self.search(query[1])
        if query[0] == "and":
            return np.intersect1d(a, self.search(query[2]), assume_unique=True) if len(a) else a
        return np.union1d(a, self.search(query[2]))


def long_runs(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray, least: int) -> np.ndarray:
    """Documents that may hold ``least`` bytes of ``marks`` in a row: such a run covers least // step samples in a row."""
    step = max(1, least // 3)
    grid = marks[data[::step]]
    k = max(1, least // step)
    if len(grid) < k:
        return np.arange(len(offsets) - 1) if len(data) >= least else np.zeros(0, np.int64)
    run = grid[: len(grid) - k + 1].copy()
    for i in range(1, k):
        run &= grid[i : len(grid) - k + 1 + i]
    return np.unique(np.searchsorted(offsets, np.flatnonzero(run) * step, "right") - 1)


def spans(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, text) -> one row for each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by
    start, then by the rules' order, joined by commas)."""
    rules = (*BASE, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = np.zeros(1 << 24, dtype=bool)
        wanted[[_code(t) for q in queries for t in trigrams_of(q)]] = True
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            text = batch.column("text")
            found: dict[int, list[tuple[int, int, int]]] = {}
            for first, part in parts(text):
                data, offsets = as_bytes(part)
                segment = Segment(data, offsets, wanted)
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    scanned = query is ALL and rule.kind == "hex"
                    for i in long_runs(data, offsets, _HEX, rule.least) if scanned else segment.search(query):
                        own = spans(part[int(i)].as_py() or "", rule, compiled[k])
                        found.setdefault(first + int(i), []).extend((a, k, b) for a, b in own)
            rows = [[0, 0, 0, _EMPTY, ""] for _ in range(len(text))]
            for i, got in found.items():
                got.sort()
                said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in got]
                base = ",".join(s for s, (_, k, _) in zip(said, got, strict=True) if k < len(BASE))
                rows[i] = [*(sum(x[1] == k for x in got) for k in range(len(BASE))), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, SCHEMA)


_EMPTY = hashlib.sha256(b"").hexdigest()
