"""Removal of repeated byte strings by a sparse suffix array.

Of any string of LENGTH bytes the anchor is the position, among those where a gram of GRAM bytes fits, whose
gram has the least hash. It depends on the string alone, so equal strings have their anchor at the same
place, and it suffices to sort the suffixes that begin at anchors: about one in (LENGTH - GRAM) / 2 bytes.

A suffix is a sequence of tokens: the hash of its gram leads, then come the bytes that follow, then those
that precede, each as far as the strings of LENGTH bytes with this anchor reach. Suffixes are range
partitioned by splitters sampled from their leading tokens; each bucket is sorted by multikey quicksort and
neighbours are compared, and the first and last runs of buckets are compared across boundaries. A run of equal
tokens may lie over many buckets, so no token makes a large task.

Suffixes equal in all tokens repeat all their strings. Where only the lead is repeated, the surroundings
differ somewhere: for these, with one suffix of each class, every string of LENGTH bytes is hashed and sorted
in the same way. What is removed are the bytes under repeated strings.

A string is known by two 64-bit hashes: the lead from one table of bytes and base, right, left and string from
a second one.

Passages: beside the bytes, the same search over words tells which documents share a passage with another one.
Units are the hashes of words ``[^\\x20\\x09-\\x0D]+``; of any PASSAGE words the anchor is the gram of PASSAGE_GRAM words
with the least hash, and a document whose anchor's gram is also an anchor in another document shares a passage.
So all that share PASSAGE words are found, and none that share fewer than PASSAGE_GRAM. Nothing is removed for it: a
passage may have fewer than LENGTH bytes.

Defined cases: a null text counts as empty; texts under LENGTH bytes keep all bytes; rows that agree in id and
text are copies of each other for the removal and one document for the passages; a null doc_id is kept; an empty
table gives an empty result; other columns are ignored. Texts are read whole; very long ones in overlapping
segments, which gives the same result; a word of over SEGMENT bytes counts as several.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.runtime import Stored, broadcast_if_small, cut, ship_package

LENGTH = 400
GRAM = 288
#: Bytes that are hashed together, at most 2^POSITION.
SEGMENT, POSITION = 1 << 20, 21
#: Suffixes of a bucket.
BUCKET = 400_000
#: Words of a passage and of its grams.
PASSAGE, PASSAGE_GRAM = 51, 45


@lru_cache(4)
def _tables(size: int, which: int):
    """Random values of bytes, powers of an odd base and of its inverse modulo 2^64; each `which` has its own."""
    rng = np.random.default_rng(20_240_607 + which)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
    power = np.empty(size + 1, np.uint64)
    back = np.empty(size + 1, np.uint64)
    power[0] = back[0] = 1
    power[1:] = base & (1 << 64) - 1
    back[1:] = pow(base, -1, 1 << 64)
    return values, np.cumprod(power), np.cumprod(back)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Hashes:
    """Hashes of all substrings of some bytes, or of all sequences of some 64-bit values."""

    def __init__(self, data: np.ndarray, which: int):
        values, power, self.back = _tables(SEGMENT + 2 * LENGTH, which)
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data if data.dtype == np.uint64 else values[data]) * power[: len(data)], out=self.sum[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sum[end] - self.sum[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(lead: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings of `length` units that lie in one text, and the place of the gram with the least lead in each."""
    least = (lead >> np.uint64(POSITION) << np.uint64(POSITION)) | np.arange(len(lead)).astype(np.uint64)
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: width - want], least[want - width :])
    valid = np.ones(len(least), bool)
    for end in offsets[1:].tolist():
        valid[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(valid)
    return start, (least[start] & np.uint64((1 << POSITION) - 1)).astype(np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie one after the other, and where in these hashes each text begins and the last ends."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    black = np.ones(256, bool)
    black[[0x20, *range(0x09, 0x0E)]] = False  # fixed values: white space
    word = black[data]
    opens, shuts = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    shuts[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] |= word[inner]
    shuts[inner - 1] |= word[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return Hashes(data, 0)(begin, end), np.searchsorted(begin, offsets)


def passage_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and lead of each anchor of PASSAGE words in texts that lie one after the other."""
    if len(data) <= SEGMENT:
        units, bounds = words_of(data, offsets)
    else:  # one long text, by parts that end with a word
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + SEGMENT)
            if end < len(data):
                white = np.flatnonzero((data[at:end] == 0x20) | ((data[at:end] >= 0x09) & (data[at:end] <= 0x0D)))
                end = at + int(white[-1]) + 1 if len(white) else end
            parts.append(words_of(data[at:end], np.array([0, end - at]))[0])
            at = end
        units = np.concatenate(parts)
        bounds = np.array([0, len(units)])
    texts, leads = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(units) - PASSAGE + 1), SEGMENT):  # a text of up to SEGMENT bytes has fewer words
        part = units[at : at + SEGMENT + PASSAGE - 1]
        lead = Hashes(part, 1)
        lead = lead(i := np.arange(len(part) - PASSAGE_GRAM + 1), i + PASSAGE_GRAM)
        start, place = _least(lead, np.clip(bounds - at, 0, len(part)), PASSAGE, PASSAGE_GRAM)
        place = place[np.insert(place[1:] != place[:-1], 0, True)] if len(place) else place
        texts.append(np.searchsorted(bounds, place + at, "right") - 1)
        leads.append(lead[place])
    return np.concatenate(texts), np.concatenate(leads)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of texts that lie one after the other: text, place, first and last string, and tokens (lead, right, left)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    lead = Hashes(data, 0)
    lead = lead(at := np.arange(n - GRAM + 1), at + GRAM)
    start, place = _least(lead, offsets, LENGTH, GRAM)
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    of = Hashes(data, 1)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    place = place[new]
    text = np.searchsorted(offsets, first, "right") - 1
    return text, place, first, last, lead[place], of(place + GRAM, last + LENGTH), of(first, place)


def _chunks(column: pa.Array, whole: bool = False):
    """(first row, bytes, offsets, shift) of groups of texts, or of overlapping segments of one long text (whole: all of it)."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(raw):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if whole or hi - lo <= SEGMENT:
            yield i, data[lo:hi], offsets[i : j + 1] - lo, 0
        else:
            for at in range(lo, hi, SEGMENT):
                part = data[at : min(hi, at + SEGMENT + LENGTH - 1)]
                yield i, part, np.array([0, len(part)]), at - lo
        i = j


def multikey(tokens: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Order of rows by their tokens, by multikey quicksort: three ways about a pivot token, the middle one goes on to the next token."""
    order = np.arange(len(tokens[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([t[part] for t in tokens[depth:][::-1]])]
            continue
        key = tokens[depth][part]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[len(key[:: max(1, len(key) // 9)]) // 2]
        below, same = key < pivot, key == pivot
        a, b = int(below.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[below], part[same], part[~below & ~same]])
        stack.append((lo, lo + a, depth))
        stack.append((lo + a + b, hi, depth))
        if depth + 1 < len(tokens):
            stack.append((lo + a, lo + a + b, depth + 1))
    return order


def repeats(table: DataFrame, rows: int, tokens: list[str], depths: list[int], fold: bool = False, across: str | None = None) -> tuple[DataFrame, Stored]:
    """Rows of table whose first token(s) are repeated, and where they are kept until drop().

    Column r<depth> for each depth: the first `depth` tokens are repeated; one: the first row of its run of equal
    tokens. depths ascend; rows that aren't repeated at the first are left out. fold: rows that follow each other
    in a text (doc_id, h, first) become one with last, the last of them. across: tokens count as repeated only if
    their rows differ in this column (not null)."""
    names, width = table.columns, len(table.columns)
    at = [names.index(t) for t in tokens]
    spread = [n for n in names if n not in tokens]
    parts = max(1, -(-rows // BUCKET), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def folded(whole: pa.Table, keep: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows to keep (by place in whole) and their last; rows at a bucket's edge stay single."""
        i = np.flatnonzero(keep)
        first = whole.column("first").to_numpy()[i]
        doc = whole.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[i]
        h = whole.column("h").to_numpy()[i]
        o = np.lexsort((first, h, doc))
        i, first, doc, h = i[o], first[o], doc[o], h[o]
        on = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (first[1:] <= first[:-1] + 1) & ~edge[i[1:]] & ~edge[i[:-1]]
        begin = np.flatnonzero(np.insert(~on, 0, True)) if len(i) else np.zeros(0, np.int64)
        return i[begin], first[np.append(begin[1:], len(i)) - 1] if len(i) else first

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = [whole.column(k).to_numpy() for k in at]
        order = multikey(keys)
        keys = [k[order] for k in keys]
        n, same = len(order), np.ones(len(order) - 1, bool)
        flags, edges = {}, []
        for depth in range(1, len(tokens) + 1):
            same = same & (keys[depth - 1][1:] == keys[depth - 1][:-1])
            if depth in depths:
                begin = np.flatnonzero(np.insert(~same, 0, True))
                size = np.diff(np.append(begin, n))
                if across:
                    of = whole.column(across).to_numpy()[order]
                    low, high = np.minimum.reduceat(of, begin), np.maximum.reduceat(of, begin)
                    flags[depth] = np.repeat(low != high, size)
                else:
                    flags[depth] = np.append(same, False) | np.insert(same, 0, False)
                    low = high = np.zeros(len(begin), np.int64)
                for i, k in {0: 0, n - 1: len(begin) - 1}.items():  # runs that may go on in the next bucket
                    edges.append((depth, *[int(t[i]) if d < depth else 0 for d, t in enumerate(keys)], int(low[k]), int(high[k]), int(size[k])))
                edge = np.zeros(n, bool)
                edge[: size[0]] = edge[n - size[-1] :] = True
                flags[-depth] = edge
        flags[0] = np.insert(~same, 0, True)
        keep = flags[depths[0]] | flags[-depths[0]]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        chosen, last = folded(whole, keep[back], flags[-depths[0]][back]) if fold else (order[keep], None)
        out, place = whole.take(pa.array(chosen)), back[chosen]
        m = len(chosen)
        cols = [out.column(i).combine_chunks() for i in range(width)]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        cols += [pa.array(flags[d][place]) for d in depths] + [pa.array(flags[-d][place]) for d in depths] + [pa.array(flags[0][place])]
        cols += [pa.array(last)] if fold else []
        told = pa.RecordBatch.from_arrays([*cols, pa.array(np.zeros(m, np.int32)), *[pa.array(np.zeros(m, np.int64))] * 3], names=full)
        yield told
        blank = [pa.nulls(len(edges), told.schema.field(i).type) for i in range(len(full))]
        for d, k in enumerate(at):
            blank[k] = pa.array([e[1 + d] for e in edges], pa.int64())
        blank[-4] = pa.array([e[0] for e in edges], pa.int32())
        for k in (-3, -2, -1):
            blank[k] = pa.array([e[k] for e in edges], pa.int64())
        yield pa.RecordBatch.from_arrays(blank, names=full)

    extra = ["last"] if fold else []
    full = [*names, *[f"r{d}" for d in depths], *[f"e{d}" for d in depths], "one", *extra, "depth", "low", "high", "n"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields] + [f"r{d} boolean" for d in depths] + [f"e{d} boolean" for d in depths] + ["one boolean"] + [f"{c} bigint" for c in extra] + ["depth int, low bigint, high bigint, n bigint"])
    stored = Stored(table.repartitionByRange(parts, *tokens, *spread).mapInArrow(run, schema), "repeats")
    found = stored.read()
    out = found.filter("depth = 0").drop("depth", "low", "high", "n")
    for d in depths:
        mine = tokens[:d]
        runs = found.filter(F.col("depth") == d).groupBy(*mine).agg(F.count("*").alias("runs"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        over = cut(runs.filter("runs > 1 AND low < high" if across else "runs > 1 AND n > 1").select(*mine, F.lit(True).alias("over")))  # two rows a bucket at most
        out = out.join(broadcast_if_small(over), mine, "left").withColumn(f"r{d}", F.col(f"r{d}") | (F.col(f"e{d}") & F.coalesce("over", F.lit(False)))).drop("over")
    return out.filter(F.col(f"r{depths[0]}")).select(*names, *[f"r{d}" for d in depths], "one", *extra), stored


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text) and spans, an array of (a, b): bytes a to b of the text are under repeated strings."""
    ship_package(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col).drop("k")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def suffixes(batches):
        for batch in batches:
            for i, data, offsets, shift in _chunks(batch.column(2)):
                text, place, first, last, lead, right, left = anchors(data, offsets)
                if not len(text):
                    continue
                which, begin = pa.array(text + i), offsets[text] - shift
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x.view(np.int64)) for x in (lead, right, left)], batch.column(0).take(which), batch.column(1).take(which), *[pa.array((x - begin).astype(np.int64)) for x in (first, last)]],
                    names=["lead", "right_", "left_", "doc_id", "h", "first", "last"],
                )

    table = Stored(rows.mapInArrow(suffixes, f"lead bigint, right_ bigint, left_ bigint, doc_id {kind}, h bigint, first bigint, last bigint"), "suffixes")
    found, kept = repeats(table.read(), table.read().count(), ["lead", "right_", "left_"], [1, 3])
    table.drop()
    sure = found.filter("r3").groupBy("doc_id", "h").agg(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("last") + LENGTH).alias("b"))).alias("spans"))

    # Where surroundings differ: each string of these suffixes, and of one suffix of each class beside them.
    unclear = cut(found.filter("NOT r3 OR one").select("doc_id", "h", F.struct("lead", "first", "last").alias("s")).groupBy("doc_id", "h").agg(F.collect_set("s").alias("s"), F.sum(F.expr("s.last - s.first + 1")).alias("n")))
    number = unclear.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    texts = rows.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g")
    asked = unclear.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "h", "text", F.col("s.lead").alias("lead"), F.col("s.first").alias("first"), F.col("s.last").alias("last"))

    def strings(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
                lead, first, last = (np.array(batch.column(c)[k].as_py(), np.int64) for c in (3, 4, 5))
                if len(data) <= SEGMENT:
                    groups = [(0, data, lead, first, last)]
                else:
                    groups = [(int(a), data[a : b + LENGTH], np.array([x]), np.array([a]), np.array([b])) for x, a, b in zip(lead, first, last)]
                for shift, part, x, a, b in groups:
                    of, n = Hashes(part, 1), b - a + 1
                    start = np.repeat(a - shift - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(x, n)), pa.array(of(start, start + LENGTH).view(np.int64)), pa.array([batch.column(0)[k].as_py()] * len(start), batch.schema.field(0).type), pa.array(np.full(len(start), batch.column(1)[k].as_py(), np.int64)), pa.array(start + shift)],
                        names=["lead", "string", "doc_id", "h", "first"],
                    )

    each = asked.mapInArrow(strings, f"lead bigint, string bigint, doc_id {kind}, h bigint, first bigint")
    more, strings_kept = repeats(each, number, ["lead", "string"], [2], fold=True)
    more = more.groupBy("doc_id", "h").agg(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("last") + LENGTH).alias("b"))).alias("spans"))
    done = cut(sure.unionByName(more).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    kept.drop()
    strings_kept.drop()
    return done


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, k (one number for both) and text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text")).withColumn("k", F.xxhash64("doc_id", "h"))


def sharing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k of each document that shares a passage with another one."""
    ship_package(docs.sparkSession)

    def grams(batches):
        for batch in batches:
            for i, data, offsets, _ in _chunks(batch.column(1), whole=True):
                text, lead = passage_anchors(data, offsets)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), batch.column(0).take(pa.array(text + i))], names=["lead", "k"])

    table = Stored(_keyed(docs, id_col, text_col).select("k", "text").mapInArrow(grams, "lead bigint, k bigint"), "grams")
    found, kept = repeats(table.read(), table.read().count(), ["lead"], [1], across="k")
    table.drop()
    done = cut(found.select("k").distinct())
    kept.drop()
    return done


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage; with keep_bytes also kept (the bytes) and spans."""
    spans = repeated_spans(docs, id_col, text_col).withColumn("k", F.xxhash64("doc_id", "h")).toDF("d", "g", "spans", "k")
    rows = _keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    side = spans.join(sharing(docs, id_col, text_col).withColumn("shares", F.lit(True)), "k", "full")
    mine = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    both = rows.join(side, "k", "left").select("doc_id", "text", F.when(mine, F.col("spans.a")).alias("a"), F.when(mine, F.col("spans.b")).alias("b"), F.coalesce("shares", F.lit(False)).alias("shares"))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, a, b in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)]):
                gone = _joined(list(zip(a or [], b or [])))
                edges = [0, *[x for s in gone for x in s], len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                for col, v in zip(out, (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [list(s) for s in gone])):
                    col.append(v)
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), batch.column(4)]
            if keep_bytes:
                cols += [pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage", "kept", "spans"][: len(cols)])

    extra = ", kept binary, spans array<array<bigint>>" if keep_bytes else ""
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, shares_passage boolean{extra}")
