"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of every shingle of words, repeats included; a bit is set when over half
of a text's hashes have it. Equal fingerprints are one entry from there on, however many rows have them.

Links (at most 3 differing bits): the 64 bits fall into 4 parts, and two linked fingerprints agree in one
part at least, so entries meet by (part, value). In each such bucket the entries are sorted by Gray rank,
which puts those that share long bit patterns side by side; the tree above them keeps for each node the
bits that all below it share. A query walks down with the differences gathered so far and leaves a whole
group as soon as these exceed the bound. Only a spanning set of links leaves the task, never all pairs.
A bucket too large for memory is passed on unread: its entries are dealt again by the same law over the
bits that are still free, until it is small; that is exact at every depth.

Components: minimum labels with pointer jumping, as joins, each round kept as a table. One side of each
join has a row for each key, so adaptive execution splits the other where a label holds many rows.

Defined cases: a null, empty or white text has fingerprint zero and is linked like any other; fewer words
than a shingle count as one shingle; a null doc_id comes after all others; repeated rows share a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.skew import skew_join
from quernel.runtime import Stored, broadcast_if_small, cut, fresh, ship_package

WORDS = 3
BITS = 3
#: Entries of a bucket that a task holds; larger buckets are dealt again over their free bits.
BUCKET = 1 << 14
FAN = 8
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """64-bit SimHash of each text, as uint64."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    sizes: list[int] = []
    who: list[int] = []

    def count() -> None:
        n = np.array(sizes)
        raw = np.array(hashes, np.uint64)
        bits = np.zeros((len(n), 64), np.int64)
        ends = np.cumsum(n)
        begins = ends - n
        for at in range(0, len(raw), SHINGLES):
            part = np.unpackbits(raw[at : at + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + len(part))
            bits[lo:hi] += np.add.reduceat(part, np.maximum(begins[lo:hi] - at, 0), axis=0, dtype=np.int64)
        out[who] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        hashes.clear(), sizes.clear(), who.clear()

    hash_ = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = text.lower().split()
        if not w:
            continue
        if len(w) < words:
            hashes.append(hash_(b" ".join(w), 42))
            sizes.append(1)
        else:
            hashes.extend([hash_(b" ".join(x), 42) for x in zip(*[w[k:] for k in range(words)])])
            sizes.append(len(w) - words + 1)
        who.append(i)
        if len(hashes) >= 4 * SHINGLES:
            count()
    if who:
        count()
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _ones(x: np.ndarray) -> np.ndarray:
    """Bits set in each row."""
    n = np.bitwise_count(x)
    return n if n.ndim == 1 else n.sum(axis=1, dtype=np.uint8)


class GrayIndex:
    """Fingerprints of one word, or rows of several, in Gray order under a tree of the bit patterns that groups share."""

    def __init__(self, prints: np.ndarray):
        words = [gray_rank(w) for w in np.atleast_2d(prints.T)]
        self.order = np.lexsort(words[::-1])
        self.prints = prints[self.order]
        levels = [(self.prints, self.prints)]
        while len(levels[-1][0]) > FAN:
            both, either = levels[-1]
            at = np.arange(0, len(both), FAN)
            levels.append((np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)))
        shared = [~(a ^ o) for a, o in levels]
        self.levels = []  # from the top: the shared pattern, and the bits that a node adds to its parent's
        for k in range(len(levels) - 1, -1, -1):
            above = shared[k + 1][np.arange(len(shared[k])) // FAN] if k + 1 < len(levels) else np.uint64(0)
            self.levels.append((levels[k][0], shared[k] & ~above, FAN**k))

    def walk(self, asked: np.ndarray, bits: int, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """Arrays (i, j): asked[i] and self.prints[j] differ in at most `bits` bits. wanted(i, node, depth, span): groups to walk into."""
        top = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(asked)), top), np.tile(np.arange(top), len(asked))
        gathered = np.zeros(len(q), np.uint8)
        for depth, (pattern, adds, span) in enumerate(self.levels):
            if depth:
                q, gathered = np.repeat(q, FAN), np.repeat(gathered, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(pattern)
                q, node, gathered = q[there], node[there], gathered[there]
            if wanted is not None:
                there = wanted(q, node, depth, span)
                q, node, gathered = q[there], node[there], gathered[there]
            gathered = gathered + _ones((asked[q] ^ pattern[node]) & adds[node])
            near = gathered <= bits
            q, node, gathered = q[near], node[near], gathered[near]
        return q, node

    def links(self, bits: int = BITS, block: int = 1024):
        """Arrays (i, j), i < j: entries of self.prints that differ in at most `bits` bits."""
        for lo in range(0, len(self.prints), block):
            q, node = self.walk(self.prints[lo : lo + block], bits, lambda i, node, depth, span, lo=lo: (node + 1) * span - 1 > i + lo)
            if len(q):
                yield q + lo, node

    def apart(self, label: np.ndarray):
        """For walk(): groups that hold an entry of another label than own[i]; label: of each entry, in the order of self.prints."""
        levels = [label]
        for _ in self.levels[1:]:
            at = np.arange(0, len(levels[-1]), FAN)
            least, most = np.minimum.reduceat(levels[-1], at), np.maximum.reduceat(levels[-1], at)
            levels.append(np.where(least == most, least, -1))  # -1: several
        levels.reverse()
        return lambda own: lambda i, node, depth, span: levels[depth][node] != own[i]


def roots(n: int, links) -> np.ndarray:
    """The least entry that each of n entries reaches."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def parts(mask: int) -> list[int]:
    """The bits that are free under mask, in 4 parts of nearly equal size."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in p.tolist()) for p in np.array_split(np.array(free), 4) if len(p)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(batches):
    """Sorted rows (mask, bits, print) -> rows (u, v, null) for links and (mask, bits, print) for entries dealt again."""

    def told(rows_a, rows_b, rows_c, again):
        n = len(rows_a)
        return pa.RecordBatch.from_arrays([pa.array(rows_a.view(np.int64)), pa.array(rows_b.view(np.int64)), pa.array(rows_c.view(np.int64)), pa.array(np.full(n, again))], names=["a", "b", "c", "again"])

    def dealt(mask: int, prints: np.ndarray):
        for p in parts(mask):
            m = np.uint64(mask | p)
            yield told(np.full(len(prints), m), prints & m, prints, True)

    def solve(prints: np.ndarray):
        index = GrayIndex(np.unique(prints))
        root = roots(len(index.prints), index.links())
        at = np.flatnonzero(root != np.arange(len(root)))
        if len(at):
            yield told(index.prints[root[at]], index.prints[at], index.prints[at], False)

    def small(mask, bits, prints):
        """Buckets of a few entries, all at once: each entry against the next ones of its bucket."""
        step = 1
        while len(prints) > step:
            same = (mask[step:] == mask[:-step]) & (bits[step:] == bits[:-step])
            if not same.any():
                return
            near = same & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= BITS) & (prints[step:] != prints[:-step])
            if near.any():
                yield told(prints[:-step][near], prints[step:][near], prints[step:][near], False)
            step += 1

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    spilling = None  # the bucket that is passed on unread

    def flush(mask, bits, prints):
        if not len(prints):
            return
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(prints)))
        tiny = np.repeat(sizes <= 16, sizes)
        yield from small(mask[tiny], bits[tiny], prints[tiny])
        for b, s in zip(begins[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
            yield from solve(prints[b : b + s])

    for batch in batches:
        mask, bits, prints = (np.asarray(batch.column(k)).view(np.uint64) for k in range(3))
        if not len(prints):
            continue
        if spilling is not None:
            same = (mask == spilling[0]) & (bits == spilling[1])
            yield from dealt(int(spilling[0]), prints[same])
            mask, bits, prints = mask[~same], bits[~same], prints[~same]
            if not len(prints):
                continue
            spilling = None
        if held:
            mask, bits, prints = (np.concatenate([h[k] for h in held] + [x]) for k, x in enumerate((mask, bits, prints)))
        last = (mask == mask[-1]) & (bits == bits[-1])
        yield from flush(mask[~last], bits[~last], prints[~last])
        held = [(mask[last], bits[last], prints[last])]
        if last.sum() > BUCKET and int(mask[-1]).bit_count() < 52:
            spilling = (mask[-1], bits[-1])
            yield from dealt(int(spilling[0]), prints[last])
            held = []
    for h in held:
        yield from flush(*h)


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that join what belongs together. prints: distinct fingerprints, column p."""
    deal = F.array(*[F.struct(F.lit(_signed(m)).alias("a"), F.col("p").bitwiseAND(F.lit(_signed(m))).alias("b")) for m in parts(0)])
    rows = prints.select(F.explode(deal).alias("k"), "p").select("k.a", "k.b", F.col("p").alias("c"))
    out = None
    while True:
        got = cut(rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_search, "a bigint, b bigint, c bigint, again boolean"))
        edges = got.filter(~F.col("again")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        out = edges if out is None else out.unionByName(edges)
        rows = got.filter("again").select("a", "b", "c")
        if rows.isEmpty():
            return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it reaches), for every node of edges (u, v).

    Rounds go through files: a checkpoint hands on the planner's estimate of its size, which the joins multiply from
    round to round to numbers of millions of digits."""
    table = Stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    both = table.read()
    held = Stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        label = held.read().select("node", "root")
        of = label.select(F.col("node").alias("v"), "root")
        seen = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = label.join(seen, "node", "left").join(jump, "root", "left")
        last, held = held, Stored(new.select("node", F.least("root", "low", "far").alias("next"), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "labels")
        last.drop()
        if held.read().filter("moved").isEmpty():
            table.drop()
            return held.read().select("node", "root")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and p (the fingerprint as a signed number), computed once."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = fingerprints([t or b"" for t in batch.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.view(np.int64))], names=["doc_id", "p"])

    return cut(docs.select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, p bigint"))


def classes(prints: DataFrame) -> DataFrame:
    """doc_id, p, component_id for rows (doc_id, p)."""
    each = cut(prints.groupBy("p").agg(F.min("doc_id").alias("first")))
    joined = components(links(each.select("p")))
    of = each.join(joined.withColumnRenamed("node", "p"), "p", "left").select("p", "first", F.coalesce("root", "p").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return skew_join(prints, of.join(least, "root").select("p", "component_id"), "p")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    got = classes(simhash(docs, id_col, text_col, words))
    return got.select("doc_id", F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one row of each group, that of the least doc_id (and hash of the text, among rows of one id); same columns."""
    h, i, g = fresh(docs, "q_hash"), fresh(docs, "q_id"), fresh(docs, "q_of")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), key.alias("h")).alias("doc_id"), F.col(text_col).alias("text"))
    got = cut(classes(simhash(slim, "doc_id", "text", words)))
    lost = cut(got.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.i").alias(i), F.col("doc_id.h").alias(g)).distinct())
    again = cut(got.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id.i").alias(i), F.col("doc_id.h").alias(g)))
    on = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(g))
    out = docs.withColumn(h, key).join(broadcast_if_small(lost), on, "left_anti")
    if not again.isEmpty():  # rows that agree in id and text: one of them stays
        side = broadcast_if_small(again)
        out = out.join(side, on, "left_anti").unionByName(out.join(side, on, "left_semi").dropDuplicates([id_col, h]))
    return out.drop(h)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, as uint64."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(b" ".join(x), 42) for x in zip(*[w[k:] for k in range(words)])] or [hash_(b" ".join(w), 42)], np.uint64))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TABLES bucket keys, each of DRAWN min-wise hashes, and the SimHash of LONG words of a set of shingles."""
    drawn = np.full(TABLES * DRAWN, np.iinfo(np.uint64).max)
    bits = np.zeros(LONG * 64, np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        drawn = np.minimum(drawn, ((h[:, None] ^ _XOR) * _ODD).min(axis=0))
        wide = np.stack([h, *[_mixed(h + np.uint64(k)) for k in range(1, LONG)]], axis=1)
        bits += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = np.arange(TABLES, dtype=np.uint64)
    for k in range(DRAWN):
        keys = _mixed(keys ^ drawn[k::DRAWN])
    return keys, np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Near copies by similarity: two texts of similarity s meet in a table with probability s ** DRAWN, so pairs of
#: 0.8 miss all tables once in 40,000. Their SimHashes of 128 bits differ in 19 bits on average, by 4 either way.
SIMILAR = 0.8
TABLES, DRAWN = 20, 4
LONG, RADIUS = 2, 36
#: Texts, and shingles on average, of a block when groups of texts are compared in full.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_XOR = _mixed(np.arange(1, TABLES * DRAWN + 1, dtype=np.uint64))
_ODD = _mixed(_XOR) | np.uint64(1)


def neighbours(sketches: DataFrame) -> DataFrame:
    """Pairs (key, u, v, apart), u < v, of texts next to each other in a bucket that is sorted by the Gray rank of one word of
    their SimHashes. sketches: node, keys, ranks.

    Buckets are ranges of one sorted table, so a large one lies in many tasks; the ends of tasks meet afterwards."""
    flip = F.col("k") % LONG == 1
    rank = [F.when(flip, F.col("ranks")[1 - k]).otherwise(F.col("ranks")[k]).alias(f"r{k}") for k in range(LONG)]
    rows = sketches.select(F.posexplode("keys").alias("k", "key"), "node", "ranks").select("key", *rank, "node")

    def told(key, u, v, value, part):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(u), pa.array(v), pa.array(value), pa.array(np.full(len(key), part, np.int64))], names=["key", "a", "b", "c", "part"])

    def run(batches):
        part, last = 2 * TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(k)) for k in range(4)]
            if last is None:
                yield told(*(c[:1] for c in rows), part)
            else:
                rows = [np.concatenate(x) for x in zip(last, rows)]
            last = [c[-1:] for c in rows]
            key, r0, r1, node = rows
            at = np.flatnonzero(key[1:] == key[:-1])
            yield told(key[at], np.minimum(node[at], node[at + 1]), np.maximum(node[at], node[at + 1]), differing(r0[at], r0[at + 1]) + differing(r1[at], r1[at + 1]), -1)
        if last is not None:
            yield told(*last, part + 1)

    got = cut(rows.repartitionByRange(F.col("key"), F.col("r0"), F.col("node")).sortWithinPartitions("key", "r0", "r1", "node").mapInArrow(run, "key bigint, a bigint, b bigint, c bigint, part bigint"))
    ends = got.filter("part >= 0").withColumn("next", F.lead(F.struct("key", "a", "b", "c")).over(Window.orderBy("part")))  # two rows for each task
    met = ends.filter("part % 2 = 1 AND key = next.key AND c <> next.c")
    across = met.select("key", F.least("c", "next.c").alias("u"), F.greatest("c", "next.c").alias("v"), (_differ(F.col("a"), F.col("next.a")) + _differ(F.col("b"), F.col("next.b"))).cast("bigint").alias("apart"))
    return got.filter("part < 0").select("key", F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("apart")).unionByName(across)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ between the patterns that have these Gray ranks."""
    d = (a ^ b).view(np.uint64)
    return np.bitwise_count(d ^ (d >> np.uint64(1))).astype(np.int64)


def _differ(a: Column, b: Column) -> Column:
    d = a.bitwiseXOR(b)
    return F.bit_count(d.bitwiseXOR(F.shiftrightunsigned(d, 1)))


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) of similarity SIMILAR at least. sets: node, shingles."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_u", "of_v"))
    pairs = edges.join(side("u"), "u").join(side("v"), "v").select("u", "v", both.alias("both"), (F.size("of_u") + F.size("of_v")).alias("sum"))
    return pairs.filter(F.col("both") >= SIMILAR * (F.col("sum") - F.col("both"))).select("u", "v")


def _groups(batches, width: int):
    """Tables of the rows that agree in their first `width` columns; such rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([np.asarray(batch.column(k)) for k in range(width)], axis=1)
        starts = [0, *(1 + np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))).tolist(), len(ids)]
        for lo, hi in zip(starts, starts[1:]):
            if held and any(held[-1].column(k)[0].as_py() != ids[lo, k] for k in range(width)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, *at: int) -> list[np.ndarray]:
    return [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in at]


def _patterns(*ranks: np.ndarray) -> np.ndarray:
    """Rows of the bit patterns that have these Gray ranks."""
    return np.stack([(r := x.view(np.uint64)) ^ (r >> np.uint64(1)) for x in ranks], axis=1)


def _resolve(batches):
    """Sorted rows (piece, a, b, open, node, root, r0, r1, shingles) -> a spanning set of the links of similarity SIMILAR at
    least between an open row and any other row of a block that has another root. Open rows walk down the Gray index of the others."""

    def told(table: pa.Table):
        open_, node, root, r0, r1 = _columns(table, 3, 4, 5, 6, 7)
        lists = table.column(8).combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        kinds, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begins = np.concatenate([[0], ends[:-1]])
        label = np.unique(root, return_inverse=True)[1]
        mine = np.zeros(len(kinds), np.int8)
        found = []
        prints, asked, rest = _patterns(r0, r1), np.flatnonzero(open_), np.flatnonzero(~open_)
        if not len(asked) or not len(rest):
            return
        index = GrayIndex(prints[rest])
        rest = rest[index.order]
        for lo in range(0, len(asked), 64):
            some = asked[lo : lo + 64]
            q, at = index.walk(prints[some], RADIUS, index.apart(label[rest])(label[some]))
            by = np.argsort(q, kind="stable")
            edges = np.searchsorted(q[by], np.arange(len(some) + 1))
            for place, i in enumerate(some.tolist()):
                j = rest[at[by[edges[place] : edges[place + 1]]]]
                j = j[label[j] != label[i]]
                if not len(j):
                    continue
                own = flat[begins[i] : ends[i]]
                mine[own] = 1
                both = np.array([mine[flat[begins[k] : ends[k]]].sum(dtype=np.int64) for k in j.tolist()])
                mine[own] = 0
                for k in j[both >= SIMILAR * (len(own) + ends[j] - begins[j] - both)].tolist():
                    if label[i] != label[k]:
                        label[label == label[k]] = label[i]
                        found.append((node[i], node[k]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for table in _groups(batches, 3):
        yield from told(table)


def _meet(batches):
    """Sorted rows (key, b, open, held, root, r0, r1) -> links (u, v) that join the roots of which two texts of a block are
    within RADIUS. Open rows walk down the Gray index of those held; only a spanning set of links leaves the task."""

    def told(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def solve(open_, held, root, prints):
        kinds, label = np.unique(root, return_inverse=True)
        asked = np.flatnonzero(open_)
        if not len(asked) or not held.any():
            return
        index = GrayIndex(prints[held])
        inside = label[held][index.order]
        joined, wanted = np.arange(len(kinds)), None
        step = max(1, (1 << 19) // len(index.prints))
        for lo in range(0, len(asked), step):
            if wanted is None:
                wanted = index.apart(joined[inside])
            some = asked[lo : lo + step]
            own = joined[label[some]]
            q, at = index.walk(prints[some], RADIUS, wanted(own))
            if not len(q):
                continue
            root_of = roots(len(kinds), [(own[q], joined[inside[at]])])
            moved = np.flatnonzero(root_of != np.arange(len(kinds)))
            if len(moved):
                yield told(kinds[root_of[moved]], kinds[moved])
                joined, wanted = root_of[joined], None
                if (joined == joined[0]).all():
                    return

    def small(key, block, root, prints):
        """Groups of a few rows, all at once: each row against the next ones of its group."""
        step = 1
        while len(key) > step:
            same = (key[step:] == key[:-step]) & (block[step:] == block[:-step])
            if not same.any():
                return
            near = same & (root[step:] != root[:-step])
            near &= _ones(prints[step:] ^ prints[:-step]) <= RADIUS
            if near.any():
                yield told(np.minimum(root[step:][near], root[:-step][near]), np.maximum(root[step:][near], root[:-step][near]))
            step += 1

    def flush(rows):
        key, block, open_, held, root, r0, r1 = rows
        prints = _patterns(r0, r1)
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        sizes = np.diff(np.append(begins, len(key)))
        tiny = np.repeat(sizes <= 16, sizes)
        yield from small(key[tiny], block[tiny], root[tiny], prints[tiny])
        for b, n in zip(begins[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
            yield from solve(open_[b : b + n], held[b : b + n], root[b : b + n], prints[b : b + n])

    kept: list[list[np.ndarray]] = []  # of the last group, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        goes_on = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        if goes_on.all() and (not kept or (kept[0][0][0] == rows[0][0] and kept[0][1][0] == rows[1][0])):
            kept.append(rows)
            continue
        done = [c[~goes_on] for c in rows]
        if kept:
            done = [np.concatenate([h[k] for h in kept] + [c]) for k, c in enumerate(done)]
        if len(done[0]):
            yield from flush(done)
        kept = [[c[goes_on] for c in rows]]
    if kept:
        yield from flush([np.concatenate([h[k] for h in kept]) for k in range(7)])


def _pieces(pairs: DataFrame, sketches: DataFrame, root: DataFrame) -> DataFrame | None:
    """node (a root) and root (its piece) for the roots of which some texts share a bucket and are within RADIUS; None if none do.

    In each bucket the texts outside its most frequent root meet all its texts, through a Gray index of BUCKET rows at most.
    No pair is written out: a bucket gives fewer links than it has roots."""
    rows = pairs.select("key", F.explode(F.array("u", "v")).alias("node")).distinct().join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    by_root = cut(rows.groupBy("key", "root").agg(F.count("*").alias("n")))
    mixed = cut(by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("key", F.ceil(F.col("n") / BUCKET).alias("blocks"), F.col("top.root").alias("top")))
    if mixed.isEmpty():
        return None
    mine, open_ = F.pmod(F.xxhash64("node"), "blocks"), F.col("root") != F.col("top")
    rows = rows.join(broadcast_if_small(mixed), "key").join(sketches.select("node", "ranks"), "node").select("key", "root", "ranks", mine.alias("mine"), open_.alias("open"), "blocks")
    ranks = [F.col("ranks")[k].alias(f"r{k}") for k in range(LONG)]
    own = rows.select("key", F.col("mine").alias("b"), "open", F.lit(True).alias("held"), "root", *ranks)
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: b != F.col("mine"))).alias("b")
    guests = rows.filter("open AND blocks > 1").select("key", others, "open", F.lit(False).alias("held"), "root", *ranks)
    links = cut(own.unionByName(guests).repartition("key", "b").sortWithinPartitions("key", "b").mapInArrow(_meet, "u bigint, v bigint").distinct())
    return None if links.isEmpty() else components(links)


def similar(texts: DataFrame, words: int) -> DataFrame:
    """node and root for the texts that are linked with another by similarity SIMILAR at least. texts: node (hash of the text), text.

    Neighbours in the buckets, which are in Gray order, are confirmed first, for each text its nearest one and then those that
    are in different groups still. What is left are texts that share a bucket with another group: the hierarchical Gray index of
    the bucket tells which groups are in question, and in these the texts meet all others through a Gray index of each block."""
    ship_package(texts.sparkSession)

    def sketched(batches):
        for batch in batches:
            made = [sketch(shingles(t or b"", words)) for t in batch.column(1).to_pylist()]
            lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in ([m[0] for m in made], [gray_rank(m[1]) for m in made])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["node", "keys", "ranks"])

    def listed(batches):
        for batch in batches:
            made = [shingles(t or b"", words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = texts.select("node", F.col("text").cast("binary").alias("text"))
    sets_of = lambda nodes: cut(texts.join(broadcast_if_small(nodes), "node", "left_semi").mapInArrow(listed, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))
    sketches = cut(texts.mapInArrow(sketched, "node bigint, keys array<bigint>, ranks array<bigint>").dropDuplicates(["node"]))
    pairs = cut(neighbours(sketches))
    edges = cut(pairs.filter(F.col("apart") <= RADIUS).groupBy("u", "v").agg(F.min("apart").alias("apart")))
    sets = sets_of(cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
    nearest = edges.select(F.explode(F.array("u", "v")).alias("node"), "u", "v", "apart").groupBy("node").agg(F.min(F.struct("apart", "u", "v")).alias("e"))
    first = cut(nearest.select("e.u", "e.v").distinct())
    good = cut(confirmed(first, sets))
    root = components(good)
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    parted = F.coalesce("root_u", "u") != F.coalesce("root_v", "v")
    rest = cut(edges.select("u", "v").join(first, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left").filter(parted).select("u", "v"))
    if not rest.isEmpty():
        good = cut(good.unionByName(confirmed(rest, sets)))
        root = components(good)
    piece = _pieces(pairs, sketches, root)
    if piece is None:
        return root
    piece = broadcast_if_small(piece.select(F.col("node").alias("root"), F.col("root").alias("piece")))
    members = cut(sketches.select("node", "ranks").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(piece, "root"))
    members = cut(members.join(sets_of(members.select("node")), "node"))
    total = members.groupBy("piece", "root").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("size"))
    by_piece = total.groupBy("piece").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).alias("blocks")
    rows = members.join(broadcast_if_small(cut(by_piece.select("piece", F.col("top.root").alias("top"), blocks))), "piece")
    mine, every = F.pmod(F.xxhash64("node"), "blocks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    tail = ["node", "root", *[F.col("ranks")[k].alias(f"r{k}") for k in range(LONG)], "shingles"]
    # an open row meets each block of all rows, in the task of its own block of open rows
    open_ = rows.filter("root <> top").select("piece", mine.alias("a"), every.alias("b"), F.lit(True).alias("open"), *tail)
    held = cut(rows.filter("root <> top").select("piece", mine.alias("a")).distinct())
    all_ = rows.join(broadcast_if_small(held), "piece").select("piece", "a", mine.alias("b"), F.lit(False).alias("open"), *tail)
    more = open_.unionByName(all_).repartition("piece", "a", "b").sortWithinPartitions("piece", "a", "b").mapInArrow(_resolve, "u bigint, v bigint")
    return components(good.unionByName(cut(more)))


def keep_least_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one row of each group of similar or equal texts, that of the least doc_id (and hash of the text); same columns."""
    h, i, g = fresh(docs, "q_hash"), fresh(docs, "q_id"), fresh(docs, "q_of")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    each = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), key.alias("h")).alias("doc_id"), key.alias("node"))
    first = cut(each.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    root = similar(docs.select(key.alias("node"), F.col(text_col).alias("text")), words)
    of = cut(first.join(root, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    stays = cut(of.join(least, "root").select("node", "first", "n", (F.col("first") == F.col("least")).alias("stays")))
    lost = stays.filter(~F.col("stays")).select(F.col("node").alias(g))
    out = docs.withColumn(h, key).join(broadcast_if_small(lost), F.col(h) == F.col(g), "left_anti")
    again = cut(stays.filter("stays AND n > 1").select(F.col("first.i").alias(i), F.col("node").alias(g)))
    if not again.isEmpty():  # of equal texts one row stays
        side = broadcast_if_small(again)
        kept = out.join(side, (F.col(h) == F.col(g)) & F.col(id_col).eqNullSafe(F.col(i)), "left_semi").dropDuplicates([h])
        out = out.join(side.select(g), F.col(h) == F.col(g), "left_anti").unionByName(kept)
    return out.drop(h)
