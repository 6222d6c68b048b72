"""Quality classifier by hierarchical empirical Bayes.

A document is good when its label says quality 1 and toxic 0. The evidence of a document is a log Bayes
factor from its whole text: a logistic regression over measures of style and over a lexicon of words that
stand out in bad documents; words have places in it by their hash, so it has a bound and leaves out none. Both are fitted on at most TRAIN labelled documents, the lexicon on one half and
the regression on the other.

Sites: the host and the path of a URL in `source`; where `source` is no URL it is the host, and the language
is the path. Probabilities of all documents are summed by path and by host. Each host's rate is shrunk towards
the global rate, each path's towards its host's, with strengths that the method of moments gives from the
spread between hosts and between paths of a host, so sparse sites stay near their prior. The posterior odds
of a document are its path's odds times its Bayes factor; it is kept from KEEP on.

Defined cases: a null text counts as empty; null source or language is a site of its own; without labels of
both kinds all evidence is 0 and all rates are PRIOR, so all documents stay; texts are read whole, a very long one
is one row; equal posteriors have equal decisions, and KEEP itself keeps; labels without a document and
repeated rows do no harm; a doc_id labelled twice counts twice; an empty table gives an empty result; other
columns are ignored, or kept by keep_good, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.skew import skew_join
from quernel.runtime import broadcast_if_small, cut, fresh, ship_package

#: Labelled documents that the text model is fitted on, at most.
TRAIN = 20_000
#: Places of the lexicon, which words share by their hash; documents of bad kind that a place needs.
LEXICON, LEAST = 1 << 20, 4
PRIOR = 0.8
KEEP = 0.4
#: Bounds of a shrinkage strength, in documents.
STRENGTH = (2.0, 10_000.0)

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")


def words(text: str) -> set[int]:
    """Places of a text's words in the lexicon."""
    return {zlib.crc32(w.encode()) % LEXICON for w in set(_WORD.findall(text.lower()))}


def style(text: str) -> list[float]:
    """Measures of style, each between 0 and about 1."""
    tokens = text.split()
    n, size = len(tokens), len(text)
    if not n:
        return [1.0] + [0.0] * 9
    lines = text.split("\n")
    upper = sum(1 for t in tokens if len(t) > 1 and t.upper() == t and t.lower() != t)
    again = sum(1 for a, b in zip(tokens, tokens[1:]) if a == b)
    symbols = len(_SYMBOL.findall(text))
    tail = sum(1 for t in tokens if not t[-1].isalnum())
    alone = sum(1 for t in tokens if not any(c.isalnum() for c in t))
    return [0.0, upper / n, again / n, symbols / size, tail / n, alone / n, 1 - len(set(tokens)) / n, 1 - len(set(lines)) / len(lines), sum(map(str.isdigit, text)) / size, min(1.0, math.log1p(n) / 10)]


def features(text: str, lexicon: dict[int, float]) -> list[float]:
    """Style, and the strongest, the second and the summed weights of the text's words in the lexicon."""
    hit = sorted((lexicon[w] for w in words(text) if w in lexicon), reverse=True) if lexicon else []
    m = style(text)
    return [*m, *[math.sqrt(x) for x in m[1:6]], hit[0] if hit else 0.0, hit[1] if len(hit) > 1 else 0.0, min(20.0, sum(hit)) / 4]


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


class Evidence:
    """The fitted text model: log Bayes factor of good against bad."""

    def __init__(self, lexicon: dict[int, float], weights: np.ndarray, prior: float):
        self.lexicon, self.weights, self.prior = lexicon, weights, prior

    def __call__(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        z = float(self.weights[0] + np.dot(self.weights[1:], features(text or "", self.lexicon)))
        return max(-30.0, min(30.0, z - math.log(self.prior / (1 - self.prior))))


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Evidence:
    """The text model from at most `train` labelled documents, chosen by a hash of the id."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    share = min(1.0, 2 * train / max(1, marked.count()))  # no task sorts more than about twice the sample
    below = -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))
    chosen = marked.filter(order <= F.lit(below)).select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), order.alias("o")).orderBy("o").limit(train)
    rows = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "good", (F.pmod("o", F.lit(2)) == 0).alias("half")))
    counts = {(r["half"], r["good"]): r["n"] for r in rows.groupBy("half", "good").agg(F.count("*").alias("n")).collect()}
    if any(not counts.get((h, g)) for h in (True, False) for g in (True, False)):
        return Evidence({}, np.zeros(0), PRIOR)

    def split(batches):
        for batch in batches:
            told = [(w, g) for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in told], pa.int64()), pa.array([int(g) for _, g in told], pa.int64())], names=["word", "good"])

    bad_n, good_n = counts[True, False], counts[True, True]
    seen = rows.filter("half").select("text", "good").mapInArrow(split, "word bigint, good bigint").groupBy("word").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    weight = F.log((F.col("b") + 0.2) / (bad_n + 0.4)) - F.log((F.col("g") + 0.2) / (good_n + 0.4))
    spread = F.sqrt(1 / (F.col("b") + 0.2) + 1 / (F.col("g") + 0.2))
    top = seen.filter(F.col("b") >= LEAST).withColumn("w", weight - 1.0 * spread).filter("w > 0.5").select("word", "w").collect()  # LEXICON rows at most, in practice thousands
    lexicon = {r["word"]: min(6.0, r["w"]) for r in top}

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t, lexicon) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "good"])

    got = rows.filter("NOT half").select("text", "good").mapInArrow(measure, "x array<double>, good boolean").collect()  # TRAIN rows at most
    y = np.array([r["good"] for r in got], float)
    prior = min(0.999, max(0.001, float(y.mean())))
    return Evidence(lexicon, _fit(np.array([r["x"] for r in got]), y), prior)


def with_evidence(docs: DataFrame, model: Evidence, name: str) -> DataFrame:
    """docs and a column with the evidence of each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shared.value(t) for t in batch.column(at).to_pylist()], pa.float64())], names=[f"c{i}" for i in range(width + 1)])

    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + [f"c{width} double"])
    return docs.toDF(*[f"c{i}" for i in range(width)]).mapInArrow(run, schema).toDF(*docs.columns, name)


def site(docs: DataFrame) -> tuple:
    """Columns for host and path."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    url = source.contains("/")
    bare = F.regexp_replace(source, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.when(url, F.lower(F.substring_index(bare, "/", 1))).otherwise(source), F.when(url, F.regexp_extract(bare, r"^[^/]*/([^/?#]*)", 1)).otherwise(lang)


def _logit(p):
    return F.log(p / (1 - p))


def posteriors(each: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate and site (host and path as one key) from rows (host, path, p)."""
    paths = cut(each.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.coalesce(F.sum("hn"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("hs"), F.lit(0.0)).alias("s")).first()
    mean = min(0.999, max(0.001, whole["s"] / whole["n"])) if whole["n"] else PRIOR

    def strength(rows: DataFrame, n: str, s: str, centre) -> float:
        """Size of the Beta prior whose spread matches the spread of the rates beyond chance."""
        rate, noise = F.col(s) / F.col(n), mean * (1 - mean)
        got = rows.agg(F.sum(F.col(n) * F.pow(rate - centre, F.lit(2.0))).alias("q"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
        if not got["k"] or not got["n"]:
            return STRENGTH[1]
        between = (got["q"] - noise * (got["k"] - 1)) / got["n"]
        return min(STRENGTH[1], max(STRENGTH[0], noise / between - 1)) if between > 1e-9 else STRENGTH[1]

    m = strength(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + m * mean) / (F.col("hn") + m))
    both = skew_join(paths, hosts.select("host", "host_rate"), "host")
    k = strength(both, "n", "s", F.col("host_rate"))
    rate = (F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)
    bound = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))
    return both.select("host", "path", bound(F.col("host_rate")).alias("host_rate"), bound(rate).alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, posterior, keep for each document."""
    ship_package(docs.sparkSession)
    host, path = site(docs)
    model = fit(docs, labels)
    slim = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    each = cut(with_evidence(slim, model, "evidence").drop("text"))
    return _decide(each, model)


def _decide(each: DataFrame, model: Evidence) -> DataFrame:
    prior = math.log(model.prior / (1 - model.prior))
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    key = F.xxhash64("host", "path", F.length("host"))
    rates = posteriors(each.withColumn("p", p)).withColumn("site", key).drop("host", "path")
    got = skew_join(each.withColumn("site", key), rates, "site").drop("site")
    return got.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))).withColumn("keep", F.col("posterior") >= KEEP)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects; same columns.

    The list of rejected rows is keyed by id and a hash of the text, and broadcast while it is small."""
    ship_package(docs.sparkSession)
    host, path = site(docs)
    model = fit(docs, labels)
    h, i, g = fresh(docs, "q_hash"), fresh(docs, "q_id"), fresh(docs, "q_of")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string") if "source" in docs.columns else F.lit(""), F.col("lang").cast("string") if "lang" in docs.columns else F.lit(""))
    slim = docs.select("doc_id", "text", host.alias("host"), path.alias("path"), key.alias("h"))
    lost = cut(_decide(cut(with_evidence(slim, model, "evidence").drop("text")), model).filter("NOT keep").select(F.col("doc_id").alias(i), F.col("h").alias(g)).distinct())
    return docs.withColumn(h, key).join(broadcast_if_small(lost), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(g)), "left_anti").drop(h)
