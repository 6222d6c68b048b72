"""Balanced label propagation: documents into shards of equal row counts that keep linked documents together.

Documents with equal texts are linked through their text. Every row starts at a shard drawn from its row
number. Rows of one text that share a start are one chunk, so a text has at most SHARDS chunks however many
rows it has. In each round, as joins and grouped sums over chunks, every text votes for the shard that holds
most of its rows, chunks elsewhere ask to move there, and moves are let in under quotas: what two shards
exchange with each other, plus the room that a shard has left below its capacity. A text that holds more than a
quarter of a shard gets a home whole before the others move; one of more rows than a shard first falls into the
least number of pieces that fit. At the end surplus rows go, those without links first and those of large texts
last, from shards above their share to those below it, which makes counts at most one apart.

The law is `rows`. The driver sees SHARDS loads and SHARDS^2 * SLICES flows at most, whatever the input.

Defined cases: a null text is equal to an empty one and has size 1; null and repeated ids are allowed, each
row has its own slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.skew import skew_join
from quernel.runtime import cut

SHARDS = 16
ROUNDS = 12
#: Moves between two shards are let in by slices of the hash of their text.
SLICES = 256
#: How far a shard may rise over its share while labels move.
SLACK = 0.1
#: Rows of a shard that are numbered together.
NUMBERED = 2048


def _narrow(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("rid"),
    )
    start = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    return cut(rows.withColumn("start", start).withColumn("chunk", F.concat("digest", F.unhex(F.lpad(F.hex(start), 4, "0")))))


def _votes(chunks: DataFrame) -> DataFrame:
    """chunks with to: the shard that holds most rows of the text, by a join of the chunks with the grouped votes of their
    text, which is the node that links them; ties fall by a hash of text and shard."""
    votes = chunks.groupBy("digest", "label").agg(F.sum("n").alias("votes"))
    best = votes.groupBy("digest").agg(F.max(F.struct("votes", F.xxhash64("digest", "label").alias("tie"), "label")).alias("best"))
    return chunks.join(best.select("digest", F.col("best.label").alias("to")), "digest")


def quotas(flows: np.ndarray, loads: np.ndarray, capacity: float) -> np.ndarray:
    """How many slices of each (from, to) may move. flows: rows by from, to and slice.

    Two shards exchange as much as both can send; what is left of a shard's capacity goes to the other
    askers in proportion."""
    asked = flows.sum(axis=2)
    swap = np.minimum(asked, asked.T)
    rest = asked - swap
    room = np.maximum(0.0, capacity - loads)
    share = np.divide(room, rest.sum(axis=0), out=np.zeros_like(room), where=rest.sum(axis=0) > 0)
    quota = swap + np.floor(rest * np.minimum(1.0, share))
    return (flows.cumsum(axis=2) <= quota[:, :, None]).sum(axis=2)


def most_rows(rows: float, shards: int) -> int:
    """Rows of a text beyond which it gets its home before the others move."""
    return int(np.ceil(rows / shards) * (1 + SLACK) / 4)


def _pieces(rows: DataFrame, sizes: dict[bytes, int], share: int) -> DataFrame:
    """rows where a text of more rows than share falls into pieces of equal size, as few as fit, each with a digest of its own."""
    if not sizes:
        return rows
    n, most = F.lit(0), max(sizes.values())
    for d, c in sizes.items():  # fewer than shards
        n = F.when(F.col("digest") == F.lit(d), c).otherwise(n)
    wide = rows.withColumn("of", n).withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(max(1, most // NUMBERED))))
    hot = wide.filter("of > 0")
    before = Window.partitionBy("digest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hot.groupBy("digest", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.col("before") + F.row_number().over(Window.partitionBy("digest", "bucket").orderBy("rid")) - 1
    number = F.floor(at * F.ceil(F.col("of") / share) / F.col("of"))
    cut_up = hot.join(F.broadcast(cut(offsets)), ["digest", "bucket"]).withColumn("digest", F.concat("digest", F.unhex(F.lpad(F.hex(number), 4, "0"))))
    cut_up = cut_up.withColumn("chunk", F.concat("digest", F.unhex(F.lpad(F.hex("start"), 4, "0"))))
    return cut(wide.filter("of = 0").select(rows.columns).unionByName(cut_up.select(rows.columns)))


def _homes(big: list[tuple[bytes, int]], shards: int) -> tuple[dict[bytes, int], np.ndarray]:
    """A shard for each large text or piece, the largest first, each where least is taken; and the rows taken."""
    homes, taken = {}, np.zeros(shards)
    for d, n in sorted(big, key=lambda x: (-x[1], x[0])):
        homes[d] = int(np.argmin(taken))
        taken[homes[d]] += n
    return homes, taken


def _started(each: DataFrame, homes: dict[bytes, int], taken: np.ndarray, share: int) -> DataFrame:
    """Chunks with their first label: the home of a large text; others are drawn by the room that is left."""
    if not homes:
        return cut(each.withColumn("label", F.col("start")))
    room = np.maximum(0.0, share - taken)
    bounds = np.floor(room.cumsum() / max(room.sum(), 1.0) * (1 << 16))
    drawn = F.pmod(F.xxhash64("digest", "start", F.lit(7)), F.lit(1 << 16))
    label = sum((F.when(drawn >= int(x), 1).otherwise(0) for x in bounds[:-1]), F.lit(0)) if room.sum() else F.col("start")
    home = each.sparkSession.createDataFrame([(bytearray(d), s) for d, s in homes.items()], "digest binary, home int")
    return cut(each.join(F.broadcast(home), "digest", "left").withColumn("label", F.coalesce("home", label).cast("int")).drop("home"))


def propagate(chunks: DataFrame, shards: int, rows: int, most: int, rounds: int = ROUNDS) -> DataFrame:
    """chunks (digest, start, chunk, label, n, total) with the labels after the last round.

    Only linked rows count as load: rows without links make way when the shards are evened out."""
    loads = np.zeros(shards)
    for r in chunks.groupBy("label").agg(F.sum("n").alias("n")).collect():  # one row for each shard
        loads[r["label"]] = r["n"]
    capacity = max(np.ceil(rows / shards), loads.sum() / shards * (1 + SLACK))
    piece = F.pmod(F.xxhash64("digest", "start"), F.lit(SLICES)).cast("int")
    for _ in range(rounds):
        asking = cut(_votes(chunks).withColumn("piece", piece))
        movers = asking.filter((F.col("label") != F.col("to")) & (F.col("total") <= most))
        flows = np.zeros((shards, shards, SLICES))
        for r in movers.groupBy("label", "to", "piece").agg(F.sum("n").alias("n")).collect():  # shards^2 * SLICES rows at most
            flows[r["label"], r["to"], r["piece"]] = r["n"]
        let_in = quotas(flows, loads, capacity)
        moved = np.array([[flows[a, b, : let_in[a, b]].sum() for b in range(shards)] for a in range(shards)])
        if not moved.sum():
            return asking.select(chunks.columns)
        loads += moved.sum(axis=0) - moved.sum(axis=1)
        bound = F.array(*[F.lit(int(x)) for x in let_in.ravel()])
        goes = (F.col("total") <= most) & (F.col("piece") < F.element_at(bound, F.col("label") * shards + F.col("to") + 1))
        chunks = asking.withColumn("label", F.when(goes, F.col("to")).otherwise(F.col("label"))).select(chunks.columns)
    return cut(chunks)


def even_out(placed: DataFrame, shards: int, rows: int) -> DataFrame:
    """placed (label, late, rid, ...) with shard and slot; counts are at most one apart."""
    buckets = max(1, rows // (shards * NUMBERED))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    counts = cut(placed.groupBy("label", "late", "bucket").agg(F.count("*").alias("n")))
    loads = np.zeros(shards, np.int64)
    for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect():  # one row for each shard
        loads[r["label"]] = r["n"]
    before = Window.partitionBy("label").orderBy("late", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("label", "late", "bucket").orderBy("rid"))
    at = placed.join(offsets, ["label", "late", "bucket"]).withColumn("at", F.col("before") + number - 1)
    target = rows // shards + (np.arange(shards) < rows % shards)
    over, under = np.maximum(0, loads - target), np.maximum(0, target - loads)
    over_before, under_end = np.cumsum(over) - over, np.cumsum(under)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), i + 1)
    surplus = F.col("at") - pick(target, F.col("label")) + pick(over_before, F.col("label"))
    goal = sum((F.when(F.col("surplus") >= int(x), 1).otherwise(0) for x in under_end[:-1]), F.lit(0))
    stays = F.col("at") < pick(target, F.col("label"))
    at = at.withColumn("surplus", surplus).withColumn("goal", F.when(stays, F.col("label")).otherwise(goal).cast("int"))
    moved_slot = pick(loads, F.col("goal")) + F.col("surplus") - pick(under_end - under, F.col("goal"))
    return at.withColumn("shard", F.col("goal")).withColumn("slot", F.when(stays, F.col("at")).otherwise(moved_slot).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    rows = _narrow(docs, id_col, text_col, shards)
    starts = {r["start"]: r["n"] for r in rows.groupBy("start").agg(F.count("*").alias("n")).collect()}  # one row for each shard
    total = sum(starts.values())
    share = -(-total // shards)
    most = max(1, most_rows(total, shards))
    big = [(bytes(r["digest"]), r["n"]) for r in rows.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()]  # 4 * shards rows at most, or half of a small table
    rows = _pieces(rows, {d: n for d, n in big if n > share}, share)
    each = rows.groupBy("digest", "start", "chunk").agg(F.count("*").alias("n"))
    each = cut(each.withColumn("total", F.sum("n").over(Window.partitionBy("digest"))).filter("total > 1"))
    first = each.filter(F.col("total") > most).groupBy("digest").agg(F.first("total").alias("n")).collect()  # as many, and shards pieces
    homes, taken = _homes([(bytes(r["digest"]), r["n"]) for r in first], shards)
    moved = propagate(_started(each, homes, taken, share).select("digest", "start", "chunk", "label", "n", "total"), shards, total, most, rounds)
    placed = cut(skew_join(rows, moved.select("chunk", "label", F.when(F.col("total") > most, 0).otherwise(1).alias("late")), "chunk").select("doc_id", "size", "text_crc32", "rid", F.coalesce("label", "start").alias("label"), F.coalesce("late", F.lit(2)).alias("late")))
    done = even_out(placed, shards, total)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
