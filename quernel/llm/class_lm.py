"""Language-model scoring with Brown classes: exchange clustering, class transitions, word emissions.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token a text. Texts whose
crc32(doc_id as text) is 1 modulo 5 are held out; all others train.

1. Word counts over all training texts: summed in the workers, then by word. The table is distributed; its
   size follows the corpus.
2. Exchange clustering of the CLUSTERED most frequent words with OFTEN occurrences (the end is one); all others are one word with a class of its
   own meanwhile. Bigrams of these over all training texts are a distributed table. The first SETTLED words are
   exchanged by their full matrix, the rest as one word. Then sweeps over all: the table is joined with the
   classes and tells, for every word, how often each class stands before and after it; word after word moves to
   the class that raises the likelihood of the class bigrams most. Sweeps end when the likelihood gains less than
   a share of GAIN, or after SWEEPS.
3. Every other training word gets the class that fits its own contexts best: the classes before and after all its
   occurrences, pre-aggregated, meet by word, and the step of the exchange that adds the word to a class is computed
   for every class. So all words have a class from their contexts, whatever the size of the vocabulary.
4. Every text becomes a sequence of classes: FREQUENT words from a broadcast list, the others through a join with the
   table of words. Transitions of all training sequences are counted.
5. score: log10 P(class | class before) + log10 P(word | class) for each token, the latter with half a
   count added and one place for unseen words in each class. The class of an unseen word is unknown, so the sum over
   all classes counts.

Defined cases: a null text counts as empty and is one end token; a null doc_id trains (its text is empty);
words of equal counts are taken in the order of their bytes, and of equal gains the first class; repeated rows each count and
each have a row; an empty table gives an empty result; other columns are ignored. Texts are read whole, long ones
BLOCK bytes at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.runtime import Stored, ship_package

#: Words that are clustered by exchange, at most, and occurrences that such a word needs: moved by fewer, words follow chance.
CLUSTERED, OFTEN = 16_384, 128
CLASSES = 64
#: Words that are clustered first, by a full matrix.
SETTLED = 1024
SWEEPS, GAIN = 10, 0.002
#: Words whose counts and classes are broadcast to the workers.
FREQUENT = 1 << 17
#: Distinct words that a worker counts before it passes them on; tokens and bytes that it takes at a time.
HELD, TOKENS, BLOCK = 1 << 19, 1 << 20, 1 << 20
#: Rows of contexts in a partition, about; rows whose scores are computed together.
CONTEXTS, ROWS = 1 << 22, 1 << 15
#: No word contains white space, so this stands for the end of a text.
END = b"\n"
#: Stand in a sequence of classes where the class is still to come, and for a word that training never saw.
OPEN, UNSEEN = 255, 254

_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(text: bytes | None):
    """Lists of words of a text, the last one holds the end."""
    at, n = 0, len(text or b"")
    while at < n:
        m = _WHITE.search(text, at + BLOCK) if at + BLOCK < n else None
        end = m.start() if m else n
        yield text[at:end].lower().split()
        at = end
    yield [END]


class _Index(dict):
    """Word -> number, -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_hash(word: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(word, 42)).view(np.int64))


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over the texts of train (column text, binary)."""

    def run(batches):
        from collections import Counter

        held: Counter = Counter()

        def told():
            words = list(held)
            out = _batch("word c", pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64()))
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in _blocks(text):
                    held.update(words)
                    if len(held) > HELD:
                        yield told()
        if held:
            yield told()

    return train.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def bigrams(train: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """cell, n: how often word b follows word a, cell = a * (len(index) + 1) + b. Words outside have the last number. A text begins after an end."""
    width = len(index) + 1

    def run(batches):
        words_of, end = _Index(index), index[END]
        held, count = [np.array([end])], 0

        def told():
            t = np.concatenate(held)
            cells, n = np.unique(t[:-1] * width + t[1:], return_counts=True)
            held[:] = [t[-1:]]
            return _batch("cell n", cells, n)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in _blocks(text):
                    ids = words_of.of(words)
                    held.append(np.where(ids < 0, width - 1, ids))
                    count += len(words)
                    if count > TOKENS:
                        yield told()
                        count = 0
        if count:
            yield told()

    return train.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def neighbours(table: DataFrame, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word how often each class stands before it and after it. of: class of each word, the last one is that of all others."""
    width, kinds = len(of), int(of.max()) + 1

    def run(batches):
        seen = np.zeros(2 * width * kinds, np.int64)
        for batch in batches:
            cell, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = cell // width, cell % width
            seen += np.bincount(np.concatenate([b * kinds + of[a], (width + a) * kinds + of[b]]), np.concatenate([n, n]), minlength=len(seen)).astype(np.int64)
        at = np.flatnonzero(seen)
        yield _batch("at n", at, seen[at])

    got = table.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2 * (CLUSTERED + 1) * (CLASSES + 1) rows at most
    out = np.zeros(2 * width * kinds)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    out = out.reshape(2, width, kinds)
    return out[0], out[1]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _together(of: np.ndarray, after: np.ndarray, kinds: int) -> np.ndarray:
    """Bigrams of classes from the classes that stand after each word."""
    n = np.zeros((kinds, kinds))
    np.add.at(n, of, after)
    return n


def likelihood(n: np.ndarray) -> float:
    return float(_f(n).sum() - _f(n.sum(axis=0)).sum() - _f(n.sum(axis=1)).sum())


def _move(w: int, of: np.ndarray, n: np.ndarray, into: np.ndarray, out: np.ndarray, itself: float, classes: int) -> bool:
    """Puts word w where the likelihood of the class bigrams n is greatest; into, out: classes before and after it, without itself."""
    old = int(of[w])
    n[:, old] -= into
    n[old, :] -= out
    n[old, old] -= itself
    rows, cols = np.maximum(n.sum(axis=1), 0)[:classes], np.maximum(n.sum(axis=0), 0)[:classes]
    a, b = np.maximum(n[:, :classes], 0), np.maximum(n[:classes, :], 0)
    i, o = np.flatnonzero(into), np.flatnonzero(out)
    gain = (_f(a[i] + into[i, None]) - _f(a[i])).sum(axis=0) + (_f(b[:, o] + out[o]) - _f(b[:, o])).sum(axis=1)
    d = np.maximum(np.diagonal(n)[:classes], 0)
    gain += _f(d + into[:classes] + out[:classes] + itself) + _f(d) - _f(d + into[:classes]) - _f(d + out[:classes])
    gain -= _f(rows + out.sum() + itself) - _f(rows) + _f(cols + into.sum() + itself) - _f(cols)
    new = int(np.argmax(gain))
    if old < classes and gain[new] <= gain[old] + 1e-9:
        new = old
    of[w] = new
    n[:, new] += into
    n[new, :] += out
    n[new, new] += itself
    return new != old


def settle(pairs: np.ndarray, classes: int, sweeps: int = 20) -> np.ndarray:
    """Class of each word but the last (all others, in a class of its own) from a full matrix of bigrams."""
    width = len(pairs)
    of = np.append(np.arange(width - 1) % classes, classes)
    member = np.zeros((width, classes + 1))
    member[np.arange(width), of] = 1
    n = member.T @ pairs @ member
    columns = np.ascontiguousarray(pairs.T)
    for _ in range(sweeps):
        moved = 0
        for w in range(width - 1):
            member[w, of[w]] = 0
            moved += _move(w, of, n, columns[w] @ member, pairs[w] @ member, pairs[w, w], classes)
            member[w, of[w]] = 1
        if moved <= 0.01 * width:
            break
    return of


def sweep(of: np.ndarray, before: np.ndarray, after: np.ndarray, classes: int) -> np.ndarray:
    """Classes after each word (but the last, which stands for all others) has moved to where the likelihood is greatest.

    Counts of classes follow each move; the neighbours of a word are those of the sweep's begin."""
    of, n = of.copy(), _together(of, after, classes + 1)
    for w in range(len(of) - 1):
        if before[w].any() or after[w].any():
            _move(w, of, n, before[w], after[w], 0.0, classes)
    return of


def exchange(table: DataFrame, width: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word of a table of bigrams (the last one: classes, for all others), and the bigrams of classes."""
    few = min(SETTLED + 1, width)
    cell = lambda c: F.when(F.col(c) < few - 1, F.col(c).cast("int")).otherwise(few - 1)
    small = table.select(F.floor(F.col("cell") / width).alias("a"), (F.col("cell") % width).alias("b"), "n").select(cell("a").alias("a"), cell("b").alias("b"), "n")
    got = small.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # (SETTLED + 1)^2 rows at most
    pairs = np.zeros((few, few))
    pairs[got["a"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    of = np.full(width, classes)
    of[: few - 1] = settle(pairs, classes)[:-1]
    before, after = neighbours(table, of)
    n = _together(of, after, classes + 1)
    told = None
    for _ in range(sweeps):
        moved = sweep(of, before, after, classes)
        before, after = neighbours(table, moved)
        now = _together(moved, after, classes + 1)
        got = likelihood(now)
        if told is not None and got <= told:
            break
        gained, of, n, told = got - (got if told is None else told), moved, now, got
        if gained and gained < GAIN * (told - likelihood(np.array([[n.sum()]]))):  # against all words in one class
            break
    return of, n


def induced(train: DataFrame, index: dict[bytes, int], of: np.ndarray, n: np.ndarray, tokens: int) -> DataFrame:
    """h, c, class for each training word outside index: its hash, its count and the class that fits its contexts best."""
    classes, kinds = len(n) - 1, len(n)
    width = len(index)
    enter = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * kinds)  # by the class before
    leave = np.log(n + 0.5) - np.log(n.sum(axis=1) + 0.5 * kinds)[:, None]  # to the class after
    enter, leave = enter[:, :classes], np.ascontiguousarray(leave[:classes].T)
    number = 1 + tokens // CONTEXTS

    def contexts(batches):
        words_of, end = _Index(index), of[index[END]]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def told():
            h, k = (np.concatenate([x[j] for x in held]) for j in (0, 1))
            held.clear()
            o = np.lexsort((k, h))
            h, k = h[o], k[o]
            new = np.flatnonzero(np.insert((h[1:] != h[:-1]) | (k[1:] != k[:-1]), 0, True)) if len(h) else np.zeros(0, np.int64)
            return _batch("h k n", h[new].view(np.int64), k[new].astype(np.int32), np.diff(np.append(new, len(h))))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts, hashes = [np.array([end])], []
                for words in _blocks(text):
                    ids = words_of.of(words)
                    ids[ids < 0] = width
                    hashes += [xxhash.xxh64_intdigest(words[i], 42) for i in np.flatnonzero(ids == width).tolist()]
                    parts.append(of[ids])
                c = np.concatenate(parts)
                at = np.flatnonzero(c == classes)
                held.append((np.array(hashes, np.uint64), c[at - 1] * kinds + c[at + 1]))
                count += len(at)
                if count > TOKENS:
                    yield told()
                    count = 0
        if count:
            yield told()

    def best(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        h, k, m = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
        del got
        o = np.lexsort((k, h))
        h, k, m = h[o], k[o], m[o]
        new = np.flatnonzero(np.insert((h[1:] != h[:-1]) | (k[1:] != k[:-1]), 0, True))
        h, k, m = h[new], k[new], np.add.reduceat(m, new)
        first = np.flatnonzero(np.insert(h[1:] != h[:-1], 0, True))
        edges = np.append(first, len(h))
        at = 0
        while at < len(first):  # whole words, about ROWS rows
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + ROWS, "right")) - 1)
            lo, hi = edges[at], edges[to]
            gain = (enter[k[lo:hi] // kinds] + leave[k[lo:hi] % kinds]) * m[lo:hi, None]
            starts = edges[at:to] - lo
            yield _batch("h c class", h[edges[at:to]], np.add.reduceat(m[lo:hi], starts), np.add.reduceat(gain, starts).argmax(axis=1).astype(np.int32))
            at = to

    parts = max(number, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return train.select("text").mapInArrow(contexts, "h bigint, k int, n bigint").repartition(parts, "h").mapInArrow(best, "h bigint, c bigint, class int")


def common_words(table: DataFrame, most: int = FREQUENT) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words and their counts, at most `most`, by count and then by spelling.

    A histogram of the counts gives the bound from which on words are few enough; only these are collected."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 1024)
    bars = sorted(((r["s"], r["n"]) for r in table.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 64 * 1024 rows at most
    room, bound = most, None
    for s, n in bars:
        room -= n
        if room < 0:
            break
        bound = s
    if bound is None:
        return [], np.zeros(0)
    got = table.filter(step >= bound).toArrow()
    rows = sorted(zip((-c for c in got["c"].to_pylist()), got["word"].to_pylist()))
    return [w for _, w in rows], np.array([-c for c, _ in rows], float)


class Model:
    """What training leaves: the clustered words (index, of), all words by hash with count and class (rest, without the
    clustered ones), the FREQUENT words with counts, and totals."""

    def __init__(self, train: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, frequent: int = FREQUENT, often: int = OFTEN):
        spark = train.sparkSession
        counted = Stored(word_counts(train), "words")
        known = counted.read().agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.total, self.kinds = int(known["n"]), int(known["v"])
        words, counts = common_words(counted.read(), frequent)
        counted.drop()
        count_of = dict(zip(words, counts.tolist()))
        chosen = list(dict.fromkeys([END, *(w for w in words[:clustered] if count_of[w] >= often)]))[:clustered]
        self.index = {w: i for i, w in enumerate(chosen)}
        pairs = Stored(bigrams(train, self.index), "bigrams")
        self.of, self.n = exchange(pairs.read(), len(chosen) + 1, classes)
        pairs.drop()
        self.rest = Stored(induced(train, self.index, self.of, self.n, self.total), "classes")
        wanted = {word_hash(w): w for w in words if w not in self.index}
        hashes = spark.createDataFrame(pd.DataFrame({"h": np.array(list(wanted), np.int64)})) if wanted else spark.createDataFrame([], "h bigint")
        found = self.rest.read().join(F.broadcast(hashes), "h", "left_semi").toArrow()  # FREQUENT rows at most
        #: word -> (place in counts and classes)
        self.words = [*[w for w in chosen if w in count_of], *[wanted[h] for h in found["h"].to_pylist()]]
        self.counts = np.array([count_of[w] for w in self.words[: len(self.words) - len(found)]] + found["c"].to_pylist(), float)
        self.classes = np.array([self.of[self.index[w]] for w in self.words[: len(self.words) - len(found)]] + found["class"].to_pylist(), np.int64)
        by_class = self.rest.read().groupBy("class").agg(F.count("*").alias("v")).collect()  # one row for each class
        self.words_in = np.bincount(self.of[[self.index[w] for w in chosen if w in count_of]], minlength=classes).astype(float)[:classes]
        for r in by_class:
            self.words_in[r["class"]] += r["v"]


def sequences(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base, emit (sum of log10(c + 0.5)) and seq, the classes of all tokens, one byte each."""
    spark = rows.sparkSession
    base_room = np.log10(model.total + 0.5 * (model.kinds + 1))
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(model.words)}, model.counts, model.classes.astype(np.uint8), int(model.of[model.index[END]])))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def near(batches):
        index, counts, classes, end = shared.value
        words_of, told, row = _Index(index), np.log10(counts + 0.5), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                parts, rare, emit, known = [], [], 0.0, 0
                for words in _blocks(text):
                    at = words_of.of(words)
                    seen = at >= 0
                    known += int(seen.sum())
                    emit += float(told[at[seen]].sum()) if len(told) else 0.0
                    seq = np.full(len(at), OPEN, np.uint8)
                    seq[seen] = classes[at[seen]]
                    if words[-1:] == [END]:  # the end is known where it was never counted
                        seq[-1] = end
                        emit += 0.0 if seen[-1] else float(np.log10(0.5))
                    parts.append(seq)
                    rare += [xxhash.xxh64_intdigest(words[i], 42) for i in np.flatnonzero(seq == OPEN).tolist()]
                seq = np.concatenate(parts)
                for col, v in zip(out, (row, len(seq), known, emit, seq.tobytes(), np.array(rare, np.uint64).view(np.int64))):
                    col.append(v)
                row += 1
            yield _batch("doc_id held_out rid n_tokens known emit seq h", batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.int64())))

    part = Stored(rows.mapInArrow(near, f"doc_id {kind}, held_out boolean, rid bigint, n_tokens bigint, known bigint, emit double, seq binary, h array<bigint>"), "near")
    rare = part.read().select("rid", F.posexplode("h").alias("pos", "h")).join(model.rest.read(), "h", "left")
    rare = rare.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "class"))).alias("r"))  # one text's words
    both = part.read().drop("h").join(rare, "rid", "left").select("doc_id", "held_out", "n_tokens", "known", "emit", "seq", F.col("r.c").alias("c"), F.col("r.class").alias("class"))

    def fill(batches):
        for batch in batches:
            seqs, known, emit = [], batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
            for i, seq in enumerate(batch.column(5)):
                seq = np.frombuffer(seq.as_buffer(), np.uint8)
                if batch.column(6)[i].is_valid:
                    c, k = (pc.fill_null(batch.column(j)[i].values, x).to_numpy() for j, x in ((6, 0), (7, UNSEEN)))
                    seq = seq.copy()
                    seq[seq == OPEN] = k
                    known[i] += int((c > 0).sum())
                    emit[i] += float(np.log10(c + 0.5).sum())
                seqs.append(seq.tobytes())
            base = emit - batch.column(2).to_numpy() * base_room
            yield _batch("doc_id held_out n_tokens n_known base emit seq", *batch.columns[:3], known, base, emit, pa.array(seqs, pa.binary()))

    done = Stored(both.mapInArrow(fill, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, emit double, seq binary"), "sequences")
    part.drop()
    return done.read()


def transitions(seqs: DataFrame, end: int, classes: int) -> np.ndarray:
    """How often a class follows another one in sequences (column seq)."""

    def run(batches):
        n = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for seq in batch.column(0):
                s = np.frombuffer(seq.as_buffer(), np.uint8).astype(np.int64)
                n += np.bincount(np.append(end, s[:-1]) * classes + s, minlength=len(n))
        yield _batch("at n", np.arange(len(n)), n)

    got = seqs.select("seq").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # CLASSES^2 rows
    out = np.zeros(classes * classes)
    for r in got:
        out[r["at"]] = r["n"]
    return out.reshape(classes, classes)


class _Over:
    """log10 of the probability that a class follows another one over k unseen words, those included.

    Powers of the step over one unseen word come from squares, so a run of k words takes about log2(k) products."""

    def __init__(self, step: np.ndarray, unseen: np.ndarray):
        self.step = step
        self.squares = [self._scaled(unseen[:, None] * step, 0.0)]
        self.known = {0: np.log10(step)}

    @staticmethod
    def _scaled(x: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
        top = x.max()
        return x / top, scale + np.log10(top)

    def log(self, k: int) -> np.ndarray:
        if k in self.known:
            return self.known[k]
        last, scale = self.step, 0.0
        for bit in range(k.bit_length()):
            if bit == len(self.squares):
                x, s = self.squares[-1]
                self.squares.append(self._scaled(x @ x, 2 * s))
            if k >> bit & 1:
                x, s = self.squares[bit]
                last, scale = self._scaled(last @ x, scale + s)
        got = np.log10(last) + scale
        if k <= 64:
            self.known[k] = got
        return got


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES, frequent: int = FREQUENT, often: int = OFTEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    ship_package(docs.sparkSession)
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    model = Model(rows.filter(~F.col("held_out")), clustered, classes, frequent, often)
    seqs = sequences(rows, model)
    model.rest.drop()
    end, total = int(model.of[model.index[END]]), model.total
    n = transitions(seqs.filter("NOT held_out"), end, classes)
    room = n.sum(axis=0) + 0.5 * (model.words_in + 1)
    step = (n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * classes)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        over = _Over(step, 0.5 / room)
        for batch in batches:
            scores = batch.column(5).to_numpy().copy()
            for i, seq in enumerate(batch.column(6)):
                s = np.frombuffer(seq.as_buffer(), np.uint8)
                at = np.flatnonzero(s != UNSEEN)
                gaps, cur = np.diff(at, prepend=-1) - 1, s[at]
                before = np.append(end, cur[:-1])
                scores[i] -= np.log10(room)[cur].sum() + (len(s) - len(at)) * np.log10(0.5)
                for k in np.unique(gaps).tolist():
                    scores[i] += over.log(k)[before[gaps == k], cur[gaps == k]].sum()
            m = batch.num_rows
            yield _batch("doc_id held_out n_tokens n_known train_tokens base_score score perplexity", *batch.columns[:4], np.full(m, total), batch.column(4), scores, 10 ** (-scores / batch.column(2).to_numpy()))

    return seqs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
