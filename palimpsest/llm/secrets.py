"""Secret scans through a trigram inverted index.

For each rule a Boolean query over trigrams is derived from the parsed regular expression: what literal strings must occur, as ORs of ANDs
of their trigrams.  Documents are indexed in segments (a few MB of an input partition each): the postings of the trigrams that some query
asks for are sorted document numbers; a rule's query intersects and joins them, and only those documents are verified with the rule
itself.  Rules from which no mandatory trigram follows are run on every document.

Trigrams are of UTF-8 bytes in lower case; rules see the bytes as they are; spans are code points, end exclusive.

Defined results: a null text is empty and has no spans; rows are scanned one by one, so copies get equal spans; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as c
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw_texts

SEGMENT_BYTES = 4 << 20
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


#: The kinds in the order in which results list them; the base ones first.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("session", r"ASIA[A-Z0-9]{16,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chatbot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("mapkey", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("login", r"(?:https?|ftp|postgres|mysql|redis|amqp)://[^\s/:@]{1,100}:[^\s/:@]{4,100}@"),
)


# --- from a regular expression to a Boolean query -----------------------------------------------------------------------------------

#: A query is a set of alternatives, each a set of trigrams that must all occur; None: no condition.
Query = frozenset


def trigrams(text: bytes) -> frozenset[bytes]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any_of(strings: set[bytes]) -> Query | None:
    if any(len(s) < 3 for s in strings):
        return None
    return _shortest({trigrams(s) for s in strings})


def _shortest(alternatives: set[frozenset[bytes]]) -> Query:
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _both(p: Query | None, q: Query | None) -> Query | None:
    if p is None or q is None:
        return q if p is None else p
    if len(p) * len(q) > 4096:  # either alone is a valid, weaker condition
        return min(p, q, key=len)
    return _shortest({a | b for a in p for b in q})


def _characters(items) -> set[bytes] | None:
    found: set[bytes] = set()
    for op, arg in items:
        if op is c.LITERAL:
            found.add(chr(arg).lower().encode())
        elif op is c.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(x).lower().encode() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _derive(nodes) -> tuple[set[bytes] | None, Query | None]:
    """The strings that the nodes match, if they are few, and what any match must hold."""
    query: Query | None = None
    exact, run = True, {b""}
    for op, arg in nodes:
        strings, inner = None, None
        if op is c.LITERAL:
            strings = {chr(arg).lower().encode()}
        elif op is c.IN:
            strings = _characters(arg)
        elif op is c.SUBPATTERN:
            strings, inner = _derive(arg[3])
        elif op is c.BRANCH:
            ways = [_derive(x) for x in arg[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            elif all(q is not None for _, q in ways):
                inner = _shortest(set().union(*(q for _, q in ways)))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, sub = arg
            part, inner = _derive(sub)
            if part is not None and high <= 4:
                strings = set()
                for n in range(low, high + 1):
                    ways = {b""}
                    for _ in range(n):
                        ways = {a + b for a in ways for b in part}
                    strings |= ways
            if low == 0:
                inner = None
        elif op is c.AT or op in (c.ASSERT, c.ASSERT_NOT):
            continue
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(query, _any_of(run))
        query = _both(query, inner if strings is None else _any_of(strings))
        exact, run = False, {b""}
    return (run if exact else None), _both(query, _any_of(run))


def trigram_query(pattern: str) -> Query | None:
    return _derive(parser.parse(pattern))[1]


# --- the index of a segment -------------------------------------------------------------------------------------------------------


class SegmentIndex:
    """Postings of the wanted trigrams over a list of texts."""

    def __init__(self, texts: list[bytes], wanted: list[bytes], numbers: np.ndarray):
        """numbers: for each of the 2 ** 24 trigrams 1 + its place in wanted, or 0."""
        sizes = np.array([len(t) + 3 for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(t.lower() + b"\n\n\n" for t in texts), dtype=np.uint8)
        pairs = []
        for k in range(0, max(len(data) - 2, 0), SEGMENT_BYTES):
            part = data[k : k + SEGMENT_BYTES + 2].astype(np.uint32)
            number = numbers[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            hit = np.flatnonzero(number)
            doc = np.searchsorted(ends, hit + k, side="right")
            pairs.append(np.unique(number[hit].astype(np.int64) * len(texts) + doc))
        pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        number, doc = pair // max(len(texts), 1), pair % max(len(texts), 1)
        cut = np.searchsorted(number, np.arange(1, len(wanted) + 2))
        self.size = len(texts)
        self.postings = {t: doc[cut[k] : cut[k + 1]] for k, t in enumerate(wanted)}

    def candidates(self, query: Query | None) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        found = np.zeros(0, np.int64)
        for alternative in query:
            lists = sorted((self.postings[t] for t in alternative), key=len)
            both = lists[0]
            for other in lists[1:]:
                if not len(both):
                    break
                both = np.intersect1d(both, other, assume_unique=True)
            found = np.union1d(found, both)
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern.encode()), trigram_query(r.pattern)) for r in rules]
        self.wanted = sorted({t for _, _, q in self.rules if q is not None for a in q for t in a})
        self.numbers = np.zeros(1 << 24, dtype=np.uint16)
        for k, t in enumerate(self.wanted):
            self.numbers[(t[0] << 16) | (t[1] << 8) | t[2]] = k + 1

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, place of the kind, end) in order."""
        index = SegmentIndex(texts, self.wanted, self.numbers)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            for i in index.candidates(query):
                text = texts[i]
                for m in regex.finditer(text):
                    if rule.accept(m):
                        found[i].append((m.start(), k, m.end()))
        for i, spans in enumerate(found):
            if spans and not texts[i].isascii():
                found[i] = _in_code_points(texts[i], spans)
            found[i].sort()
        return found


def _in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    at, n, last = {}, 0, 0
    for p in sorted({x for s, _, e in spans for x in (s, e)}):
        n += len(text[last:p].decode("utf-8", "replace"))
        at[p], last = n, p
    return [(at[s], k, at[e]) for s, k, e in spans]


def segments(texts: list[bytes], most: int = SEGMENT_BYTES) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > most:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> of the base kinds, base_sha256, spans) for every row."""
    base = [k for k, r in enumerate(rules) if r.base]
    names = [f"n_{rules[k].kind}" for k in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            spans = [s for part in segments([t or b"" for t in raw_texts(b)]) for s in scanner.scan(part)]
            said = lambda some: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in some)
            own = [[x for x in s if x[1] in base] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([sum(x[1] == k for x in s) for s in own], pa.int64()) for k in base]]
                + [pa.array([hashlib.sha256(said(s).encode()).hexdigest() for s in own], pa.string()), pa.array([said(s) for s in spans], pa.string())],
                names=["doc_id", *names, "base_sha256", "spans"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} long" for n in names], "base_sha256 string", "spans string"]))
