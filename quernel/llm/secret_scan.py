"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what any match must
contain. Documents are indexed in blocks: the postings of the trigrams that some rule asks for are
bitmaps over the documents of the block; queries intersect and unite them, and only the candidates are
read by the regular expression. A rule without a mandatory trigram (the hexadecimal one) reads every
text. The index folds A-Z to a-z, which can only add candidates.

Defined cases: a null text counts as empty; a text without a secret has zero counts, empty spans and the
digest of the empty string; repeated rows give equal rows; an empty table gives an empty result; other
columns are ignored. Texts are read whole; a text of any length is one document of its block.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.runtime import ship_package

#: Bytes of text that are indexed together.
BLOCK = 1 << 22
#: Literals that one part of a regular expression may stand for before it is given up.
LITERALS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    fold: bool = False  # ASCII letters in either case

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: The three base kinds; their order is the order of spans that start together.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)


def trigram_query(pattern: str):
    """What a match must contain: None (anything), a trigram, ("and", parts) or ("or", parts)."""
    whole, exact = _walk(list(_parser.parse(pattern)))
    return _all([*whole, _literals(exact)])


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literals(words: set[str]):
    return _any([_all([w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _walk(items) -> tuple[list, set[str]]:
    """Queries that hold before the last open literal, and the literals that the end may be."""
    done, open_ = [], {""}

    def close() -> None:
        nonlocal open_
        done.append(_literals(open_))
        open_ = {""}

    for op, arg in items:
        words = _words(op, arg)
        if words is not None and len(words) * len(open_) <= LITERALS:
            open_ = {a + b for a in open_ for b in words}
            continue
        close()
        if words is not None:
            open_ = words
        elif op is C.SUBPATTERN:
            inner, end = _walk(list(arg[3]))
            done.append(_all([*inner, _literals(end)]))
        elif op is C.BRANCH:
            done.append(_any([_all([*q, _literals(e)]) for q, e in (_walk(list(x)) for x in arg[1])]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            inner, end = _walk(list(arg[2]))
            done.append(_all([*inner, _literals(end)]))
    return done, open_


def _words(op, arg) -> set[str] | None:
    """All texts that a part can match, in lower case, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.AT:
        return {""}
    if op is C.SUBPATTERN:
        return _join(list(arg[3]))
    if op is C.BRANCH:
        each = [_join(list(x)) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        inner = _join(list(arg[2]))
        if inner is None or arg[1] is C.MAXREPEAT or arg[1] > 5:
            return None
        out = set()
        for k in range(arg[0], arg[1] + 1):
            power = {""}
            for _ in range(k):
                power = {a + b for a in power for b in inner}
            out |= power
            if len(out) > LITERALS:
                return None
        return out
    return None


def _join(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        words = _words(op, arg)
        if words is None or len(words) * len(out) > LITERALS:
            return None
        out = {a + b for a in out for b in words}
    return out


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class Scanner:
    """Rules with their queries, and the numbers of the trigrams that these ask for."""

    def __init__(self, rules=BASE + ADDED):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        asked = sorted({t for _, _, q in self.rules for t in _trigrams(q) if all(ord(c) < 128 for c in t)})
        self.number = {t: k + 1 for k, t in enumerate(asked)}
        letters = sorted(set("".join(asked)))
        self.bits = (len(letters) + 1).bit_length()
        self.code = np.zeros(256, np.int32)  # 0: a byte that no trigram has
        for k, c in enumerate(letters):
            self.code[[ord(c), ord(c.upper())]] = k + 1
        self.of = np.zeros(1 << 3 * self.bits, np.uint8 if len(asked) < 255 else np.uint16)
        for t, k in self.number.items():
            self.of[self._key(*self.code[[ord(c) for c in t]])] = k

    def _key(self, a, b, c):
        return a << 2 * self.bits | b << self.bits | c

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bitmap: does document j hold trigram i? data: bytes of the block's documents, one after the other."""
        docs = len(offsets) - 1
        held = np.zeros((len(self.number) + 1, docs), bool)
        if len(data) >= 3:
            d = self.code[data]
            k = self.of[self._key(d[:-2], d[1:-1], d[2:])]
            at = np.flatnonzero(k)
            j = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[j + 1]
            held[k[at[inside]], j[inside]] = True
        return held

    def candidates(self, query, held: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(held.shape[1], bool)
        if isinstance(query, str):
            return held[self.number[query]] if query in self.number else np.ones(held.shape[1], bool)
        parts = [self.candidates(q, held) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each document its spans (start, rule, end) in code points, in order."""
        held = self.postings(data, offsets)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            for j in np.flatnonzero(self.candidates(query, held)).tolist():
                out[j].extend((m.start(), k, m.end()) for m in regex.finditer(texts[j]) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        for spans in out:
            spans.sort()
        return out


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def _blocks(column: pa.Array):
    """Texts of a column, with their bytes and offsets, about BLOCK bytes at a time."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(raw):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield [t or "" for t in column.slice(i, j - i).to_pylist()], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans (kind:start:end, comma-joined)."""
    ship_package(docs.sparkSession)

    def run(batches):
        s = scanner()
        kinds, base = [r.kind for r, _, _ in s.rules], len(BASE)
        for batch in batches:
            rows = []
            for texts, data, offsets in _blocks(batch.column(1)):
                for spans in s.scan(texts, data, offsets):
                    told = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
                    mine = ",".join(x for x, (_, k, _) in zip(told, spans) if k < base)
                    rows.append((*[sum(k == i for _, k, _ in spans) for i in range(base)], hashlib.sha256(mine.encode()).hexdigest(), ",".join(told)))
            cols = list(zip(*rows)) if rows else [[]] * (base + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:base]], *[pa.array(c, pa.string()) for c in cols[base:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).toDF("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
