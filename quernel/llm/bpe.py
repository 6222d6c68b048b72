"""Byte-level BPE encoding and decoding with pre-tokenisation by array scans instead of a regular expression.

Every code point becomes a class (letter, number, space, other white space, apostrophe that may open a
contraction, other). A small automaton over these classes decides where a piece begins. Its transition
functions form a finite monoid, so the state before every character comes from an associative scan:
blocks are scanned side by side by table look-ups, block totals are scanned in turn, and both are put
together. The slices between boundaries go through a cache of merged pieces; the cache is bounded.

Defined cases: a null text counts as empty and has no tokens; repeated rows give equal rows; an empty
table gives an empty result; other columns are ignored. Text of any length is encoded whole, a long
piece by a heap in n log n steps. Special tokens do not exist: their spelling is ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.runtime import ship_package

#: Characters that are encoded together; a longer text is taken alone.
CHUNK = 1 << 20
#: Pieces that a worker remembers, twice.
CACHE = 1 << 17
BLOCK = 256

L, N, O, C2, C3, SP, SPL, WS, WSL = range(9)  # noqa: E741
START, IN_L, IN_N, IN_O, IN_SP, IN_WS, K1, K2 = range(8)
RESET = 9  # symbol + RESET: the same symbol at the start of a text

#: Characters with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> int:
    if state == K2:
        return K1
    if state == K1:
        return START
    if symbol in (C2, C3):
        return IN_O if state in (IN_O, IN_SP) else (K1 if symbol == C2 else K2)
    return {L: IN_L, N: IN_N, O: IN_O, SP: IN_SP, SPL: IN_SP, WS: IN_WS, WSL: IN_WS}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a piece begins at a character with this symbol, given the state before it."""
    if state in (K1, K2):
        return False
    if state == START or symbol in (SPL, WSL):
        return True
    if symbol in (SP, WS):
        return state not in (IN_SP, IN_WS)
    return state not in (IN_SP, {L: IN_L, N: IN_N}.get(symbol, IN_O))


@lru_cache(1)
def _tables():
    """Class of each code point; monoid of transition functions: generators, composition, action; begin table."""
    kind = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = L
        elif k == "N":
            kind[c] = N
    kind[WHITE_SPACE] = WS
    kind[0x20] = SP
    plain = [tuple(_step(q, s) for q in range(8)) for s in range(9)]
    resets = [(f[START],) * 8 for f in plain]
    known = {}
    for f in plain + resets:
        known.setdefault(f, len(known))
    queue = list(known)
    while queue:  # close the set under composition with the generators
        f = queue.pop()
        for g in plain + resets:
            h = tuple(g[q] for q in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    every = list(known)
    then = np.zeros((len(every), len(every)), np.uint16)
    for a, f in enumerate(every):
        for b, g in enumerate(every):
            then[a, b] = known[tuple(g[q] for q in f)]
    gens = np.array([known[f] for f in plain + resets], np.uint16)
    act = np.array(every, np.uint8)
    begin = np.array([[_begins(q, s) for s in range(9)] for q in range(8)])
    return kind, gens, then, act, begin


def _scan(f: np.ndarray, then: np.ndarray, act: np.ndarray, start: int) -> np.ndarray:
    """State after each function of f, applied from the left to start."""
    n, m = len(f), len(then)
    if n <= 2 * BLOCK:
        out, q = np.empty(n, np.uint8), start
        for i, a in enumerate(f.tolist()):
            q = int(act[a, q])
            out[i] = q
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK), np.uint16)
    grid.ravel()[:n] = f
    grid.ravel()[n:] = f[-1]
    grid = np.ascontiguousarray(grid.T)
    flat = then.ravel()
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1].astype(np.int32) * m + grid[j]]
    after = _scan(grid[-1], then, act, start)
    before = np.concatenate([[np.uint8(start)], after[:-1]])
    return act.ravel()[grid.astype(np.int32) * act.shape[1] + before].T.ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin: points are code points of texts one after the other, starts the first of each text that isn't empty."""
    kind, gens, then, act, begin = _tables()
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    s = kind[points]
    first = np.zeros(n, bool)
    first[starts] = True
    follows = np.empty(n, bool)  # the next character is of the same text
    follows[:-1] = ~first[1:]
    follows[-1] = False
    white = s >= SP
    last = white.copy()
    last[:-1] &= follows[:-1] & ~white[1:]
    last[-1] = False
    s[last] += 1
    at = np.flatnonzero((points == 0x27) & follows)
    if len(at):
        one = points[at + 1]
        two = np.where(follows[at + 1], points[np.minimum(at + 2, n - 1)], 0)
        s[at[np.isin(one, [ord(c) for c in "stmd"])]] = C2
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        s[at[pair]] = C3
    after = _scan(gens[s + np.where(first, RESET, 0)], then, act, START)
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = after[:-1]
    before[first] = START
    return np.flatnonzero(begin[before, s])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """Rank of the token that two adjacent tokens make, by binary search over all splits of all tokens."""

    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)
        self.made = np.append(np.array(made, np.int64)[order], self.NONE)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a << 32 | b
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.made[at], self.NONE)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of pieces, all merged side by side: each round merges in every piece the pair of least rank, the leftmost of equal ones."""
    out: list[bytes] = [b""] * len(pieces)
    token = pairs.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    length = np.array([len(p) for p in pieces], np.int64)
    whose = np.arange(len(pieces))
    cost = np.full(len(token), Pairs.NONE)
    cost[:-1] = pairs(token[:-1], token[1:])
    cost[np.cumsum(length) - 1] = Pairs.NONE
    while len(length):
        ends = np.cumsum(length)
        begins = ends - length
        least = np.minimum.reduceat(cost, begins)
        done = least == Pairs.NONE
        if done.any():
            raw = token.astype("<u4").tobytes()
            for k in np.flatnonzero(done).tolist():
                out[whose[k]] = raw[4 * begins[k] : 4 * ends[k]]
            rest = np.repeat(~done, length)
            token, cost, length, whose, least = token[rest], cost[rest], length[~done], whose[~done], least[~done]
            if not len(length):
                break
            ends = np.cumsum(length)
            begins = ends - length
        hit = np.flatnonzero(cost == np.repeat(least, length))
        piece = np.repeat(np.arange(len(length)), length)[hit]
        at = hit[np.concatenate([[True], piece[1:] != piece[:-1]])]
        token[at] = least
        stay = np.ones(len(token), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))  # where the merged tokens are without those that went
        token, cost, length = token[stay], cost[stay], length - 1
        ends = np.cumsum(length)
        begins = ends - length
        inner = at[at < ends - 1]
        cost[at] = Pairs.NONE
        cost[inner] = pairs(token[inner], token[inner + 1])
        prior = at[at > begins] - 1
        cost[prior] = pairs(token[prior], token[prior + 1])
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long piece, with a heap and linked neighbours, in n log n steps."""
    n = len(piece)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, e = heapq.heappop(heap)
        j = right[i] if end[i] else n
        if not end[i] or j >= n or end[j] != e:
            continue
        end[i], end[j], right[i] = e, 0, right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class _Cache:
    """Piece -> its ids as little-endian bytes. Two generations: what is in use survives when the younger is full."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def many(self, pieces: list[str]) -> list[bytes]:
        got = list(map(self.new.get, pieces))
        if None in got:
            lost = {pieces[i] for i, x in enumerate(got) if x is None}
            found = {p: self.old[p] for p in lost if p in self.old}
            short = []
            for p in lost - found.keys():
                raw = p.encode("utf-8", "surrogatepass")
                if (whole := self.ranks.get(raw)) is not None:
                    found[p] = struct.pack("<I", whole)
                elif len(raw) > 128:
                    ids = _merge_long(raw, self.ranks)
                    found[p] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    short.append((p, raw))
            if short:
                found.update(zip([p for p, _ in short], merge_many([raw for _, raw in short], self.pairs)))
            got = [found[p] if x is None else x for p, x in zip(pieces, got)]
            if len(self.new) + len(found) > CACHE:
                self.old, self.new = self.new, {}
            self.new.update((p, x) for p, x in found.items() if len(p) <= 64)
        return got


class Codec:
    """Encodes and decodes with the ranks at a path."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.vocab = {i: b for b, i in self.ranks.items()}
        self.cache = _Cache(self.ranks)

    def encode_many(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text its ids as little-endian bytes, and the code point at which each piece begins."""
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > CHUNK:
                yield from self._encode(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        b = boundaries(points, begins[begins < ends])
        cut = b.tolist() + [len(whole)]
        ids = self.cache.many([whole[i:j] for i, j in zip(cut, cut[1:])])
        lo, hi = np.searchsorted(b, begins), np.searchsorted(b, ends)
        for x, y, at in zip(lo.tolist(), hi.tolist(), begins.tolist()):
            yield b"".join(ids[x:y]), b[x:y] - at

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _with_tokens(docs: DataFrame, text_col: str, path: str | None, fields: list[tuple[str, str]], row) -> DataFrame:
    """docs with columns that row(codec, ids, offsets) gives, in place of any columns of these names."""
    ship_package(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n, _ in fields}])
    at = docs.columns.index(text_col)
    kinds = {"long": pa.int64(), "string": pa.string(), "ids": pa.list_(pa.int32())}
    spell = {"long": "bigint", "string": "string", "ids": "array<int>"}

    def run(batches):
        c = codec(path or ranks_path())
        for batch in batches:
            got = [row(c, ids, offsets) for ids, offsets in c.encode_many([t or "" for t in batch.column(at).to_pylist()])]
            cols = [pa.array([g[k] for g in got], kinds[kind]) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[f"c{i}" for i in range(batch.num_columns + len(cols))])

    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + [f"c{len(docs.columns) + i} {spell[k]}" for i, (_, k) in enumerate(fields)])
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*docs.columns, *[n for n, _ in fields])


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with token_ids, piece_starts (code points) and n_tokens."""
    return _with_tokens(docs, text_col, path, [("token_ids", "ids"), ("piece_starts", "ids"), ("n_tokens", "long")], lambda _, ids, at: (np.frombuffer(ids, "<u4").astype(np.int32), at.astype(np.int32), len(ids) // 4))


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """encoded with the bytes that the ids stand for."""
    ship_package(encoded.sparkSession)

    @F.pandas_udf("binary")
    def back(ids):
        c = codec(path or ranks_path())
        return ids.map(lambda x: None if x is None else c.decode(np.asarray(x, "<u4").tobytes()))

    return encoded.withColumn(out_col, back(ids_col))


def token_digests(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: ids and decoded bytes, each digested in the worker."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _with_tokens(docs, text_col, path, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], lambda c, ids, _: (len(ids) // 4, sha(ids), sha(c.decode(ids))))
