"""Benchmark decontamination by template canonicalisation (native DataFrame functions only).

Numbers, units after a number and names become typed placeholders, so that a question with other values has the
same template. A name is a capitalised word; where a sentence, a quotation or a line may begin, words of ORDINARY
are none. White space is one space before that, so wrapping changes nothing. Windows of WINDOW template tokens of
benchmark items are hash-joined with the windows of every document; each item also has the windows that it would
have in lower case, where names are plain words. A match fixes an alignment of item and document; along it the
values in the slots are compared: one value of the item must stand for one value in the document. Where it stands
for two, only windows with the item's own values count. A window with fewer than LITERALS plain words is keyed by its
values, so it only meets windows with the same ones and lists of numbers don't meet each other.

A document leaks an item when its counting windows are COVER of the item's windows or at least RUN of them. Shorter
items have one window of their whole length.

The items' windows are broadcast while they are within the bounds of broadcast_if_small and BENCH_ROWS rows, else
the join shuffles.

Defined cases: null or empty texts and items have no windows and match nothing; texts are read whole, a very long one
is one array of tokens; items with equal windows are each told; repeated windows of a document match each, repeated
rows each have their rows; a null doc_id or item_id is kept as it is; empty tables give an empty result; other columns
are ignored, or kept by drop_leaks, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.runtime import broadcast_if_small, cut, fresh

WINDOW = 8
LITERALS = 4
COVER, RUN = 0.5, 6
BENCH_ROWS = 500_000

# Units of measure and of money.
UNITS = "kg|g|mg|lb|lbs|oz|t|km|m|cm|mm|nm|mi|miles?|meters?|metres?|kilometers?|kilometres?|ft|feet|foot|inch|inches|yards?|l|ml|liters?|litres?|gallons?|s|ms|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|kb|mb|gb|tb|hz|khz|mhz|ghz|v|kv|w|kw|mw|j|kj|cal|kcal|pa|kpa|bar|k|c|f|degrees?|percent|dollars?|euros?|pounds?|cents?|usd|eur|gbp|mph|kmh"
# Words that open sentences and are no names, in four languages.
ORDINARY = "The|An|This|That|These|Those|There|Here|It|Its|He|She|His|Her|They|Their|We|Our|You|Your|My|And|But|Or|If|When|While|Where|Which|Who|Whom|Whose|What|Why|How|In|On|At|By|For|From|Of|To|With|After|Before|Then|So|As|Is|Are|Was|Were|Do|Does|Did|Can|Could|Will|Would|Should|Has|Have|Had|Not|No|Each|Every|All|Some|Find|Given|Let|Der|Die|Das|Ein|Eine|Es|Er|Sie|Wir|Und|Oder|Aber|Wenn|Wie|Was|Wer|Wo|Warum|Im|Am|Mit|Von|Zu|Auf|Nach|Ist|Sind|Le|La|Les|Un|Une|Des|Du|Il|Elle|Ils|Nous|Vous|Et|Ou|Mais|Si|Quand|Comment|Quel|Quelle|Qui|Que|Dans|En|Par|Pour|Sur|Avec|El|Los|Las|Una|Ella|Ellos|Pero|Cuando|Como|Cual|Quien|Con|Por|Para|Es|Son"
NUMBER, UNIT, NAME = "_n", "_u", "_a"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """Words and numbers of a text on one line; a decimal is one token, a number and its unit are two."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[_\s\x{85}\p{Z}]+", " ")
    text = F.regexp_replace(text, r"[.,:](?<=\p{N}[.,:])(?=\p{N})", "_")  # patterns begin with what is rare
    return F.regexp_replace(text, r"(\p{N})(?=\p{L})", "$1 ")


def template(raw: Column, names: bool = True) -> Column:
    """raw_tokens() with placeholders, in lower case; the same number of tokens. names: with placeholders for them."""
    text = raw
    if names:
        text = F.regexp_replace(raw, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}_])(?:(?<=[\p{{Ll}}\p{{N}},;] )|(?!(?:{ORDINARY})(?![\p{{L}}\p{{N}}_])))\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}_])", NAME)
    text = F.regexp_replace(text, r"(?=\p{N})(?<![\p{L}\p{N}_])[\p{N}_]+(?![\p{L}\p{N}_])", NUMBER)
    return F.lower(F.regexp_replace(text, rf"{NUMBER}(?<![\p{{L}}\p{{N}}]{NUMBER}) (?i:{UNITS})(?![\p{{L}}\p{{N}}_])", f"{NUMBER} {UNIT}"))


def windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows without words and raw, with size, key, at (from 0) and seen for each window of each size; seen: its raw tokens if it has slots and the key doesn't hold them. The key is null where the window runs over the end.

    Tokens are hashed once, with a last bit that tells slots; keys are made of these numbers in generated code, and a
    broadcast join slices tokens for its hits alone."""
    kept = [c for c in rows.columns if c not in ("words", "raw")]
    code = F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(~1)).bitwiseOR(w.startswith("_").cast("long")))
    coded = rows.select(*kept, "raw", code.alias("codes")).select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    each = coded.select(*kept, "raw", "size", "codes", F.posexplode_outer("codes").alias("at", "code"))
    n = key = F.lit(None).cast("long")
    for s in sizes:
        of = [F.get("codes", F.col("at") + i) for i in range(s)]
        mine = F.col("size") == s if len(sizes) > 1 else F.lit(True)
        n = F.when(mine, sum(x.bitwiseAND(F.lit(1)) for x in of)).otherwise(n)
        key = F.when(mine, F.xxhash64(*of)).otherwise(key)
    own = F.slice("raw", F.col("at") + 1, F.col("size"))
    few = F.col("n") > F.greatest(F.lit(0), F.col("size") - LITERALS)
    whole = each.select(*kept, "raw", "size", "at", n.alias("n"), F.when(F.col("at") + F.col("size") <= F.size("codes"), key).alias("key"))
    return whole.select(*kept, "size", F.when(few, F.xxhash64(own, F.lit(1))).otherwise(F.col("key")).alias("key"), "at", F.when((F.col("n") > 0) & ~few, own).alias("seen"))


def _split(rows: DataFrame, text_col: str, names: bool = True) -> DataFrame:
    """rows with words and raw in place of the text."""
    kept = [c for c in rows.columns if c != text_col]
    made = rows.select(*kept, raw_tokens(F.col(text_col)).alias("plain")).select(*kept, "plain", template(F.col("plain"), names).alias("mould"))
    parts = F.struct(_tokens(F.col("mould")).alias("words"), _tokens(F.lower("plain")).alias("raw"))
    # an explode of one element keeps the optimizer from moving the split into the work on each window
    return made.select(*kept, F.explode(F.array(parts)).alias("p")).select(*kept, "p.*")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, matched, windows, coverage, slots, changed, kind for each item that a document leaks, with its row number rid."""
    asked_items = cut(benchmark.select(F.col(item_col).alias("item_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("item")))
    items = _split(asked_items, "text").unionByName(_split(asked_items, "text", names=False))
    items = cut(items.filter(F.size("words") > 0).withColumn("span", F.least(F.lit(WINDOW), F.size("words"))).distinct())
    text = _split(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").withColumn("rid", F.monotonically_increasing_id())
    spans = [r["span"] for r in items.select("span").distinct().collect()]  # WINDOW values at most
    if not spans:
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).select("doc_id", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), *[F.lit(0).cast(k).alias(c) for c, k in (("matched", "long"), ("windows", "long"), ("coverage", "double"), ("slots", "long"), ("changed", "long"))], F.lit("").alias("kind"), F.lit(0).cast("long").alias("rid"))
    held = items.select("*", (F.size("words") - F.col("span") + 1).alias("windows"), F.col("words").alias("item_words"), F.col("raw").alias("item_raw"))
    asked = windows(held, spans).filter((F.col("size") == F.col("span")) & F.col("key").isNotNull()).select("item", "item_id", "windows", "key", F.col("at").alias("item_at"), "span", "item_words", "item_raw")
    asked = cut(asked.withColumns({c: F.slice(c, F.col("item_at") + 1, F.col("span")) for c in ("item_words", "item_raw")}).drop("span").dropDuplicates(["item", "item_at", "key"]))
    # the explode of one element keeps the filters below out of the join, which then is generated code with the windows
    hits = windows(text, spans).join(broadcast_if_small(asked, BENCH_ROWS), "key")
    hits = hits.select("rid", "doc_id", "item", "item_id", "windows", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "item_words", "item_raw", F.explode(F.array(F.coalesce("seen", "item_raw"))).alias("doc_raw"))
    slot = F.filter(F.arrays_zip(F.col("item_words").alias("t"), F.col("item_raw").alias("b"), F.col("doc_raw").alias("d")), lambda x: x["t"].isin(NUMBER, UNIT, NAME))
    hits = hits.withColumn("pairs", F.transform(slot, lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d")))).withColumn("plain", F.size("item_words") - F.size("pairs"))
    hits = hits.withColumn("same", F.forall("pairs", lambda x: x["b"] == x["d"])).filter((F.col("plain") >= LITERALS) | F.col("same"))
    aligned = hits.groupBy("rid", "doc_id", "item", "item_id", "windows", "shift").agg(F.collect_set("item_at").alias("ats"), F.collect_set(F.when(F.col("same"), F.col("item_at"))).alias("own"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    steady = F.size(F.array_distinct(F.transform("pairs", lambda x: x["b"]))) == F.size("pairs")
    counted = aligned.withColumn("ats", F.when(steady, F.col("ats")).otherwise(F.col("own"))).withColumn("pairs", F.when(steady, F.col("pairs")).otherwise(F.filter("pairs", lambda x: x["b"] == x["d"])))
    found = counted.groupBy("rid", "doc_id", "item", "item_id", "windows").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    found = found.withColumn("matched", F.size("ats").cast("long")).filter((F.col("matched") >= COVER * F.col("windows")) | (F.col("matched") >= RUN))
    changed = F.size(F.filter("pairs", lambda x: x["b"] != x["d"])).cast("long")
    return found.select("doc_id", "item_id", "matched", F.col("windows").cast("long").alias("windows"), (F.col("matched") / F.col("windows")).alias("coverage"), F.size("pairs").cast("long").alias("slots"), changed.alias("changed"), F.when(changed > 0, "reparameterised").otherwise("same values").alias("kind"), "rid")


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each leaking document and item."""
    return leaks(docs, benchmark).drop("rid")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item; same columns. Rows are named by id and a hash of the text."""
    h, i, g = fresh(docs, "q_hash"), fresh(docs, "q_id"), fresh(docs, "q_of")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = docs.select(F.struct(F.col("doc_id").alias("i"), key.alias("h")).alias("doc_id"), "text")
    lost = cut(leaks(slim, benchmark).select(F.col("doc_id.i").alias(i), F.col("doc_id.h").alias(g)).distinct())
    return docs.withColumn(h, key).join(broadcast_if_small(lost), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(g)), "left_anti").drop(h)
