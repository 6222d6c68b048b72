"""Queries for the engine's own operators, by name, over the whole test tables, with DuckDB SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.functions import vector as V
from quernel.operators import chats, chunking, corpus, dense, hybrid, lexical, manifest, vectors
from quernel.plans import fixtures as X
from quernel.plans import sql as S
from quernel.runtime import Stored, cut, spread

QUERIES: dict = {}
ORACLE: dict = {}
DIM, MODEL = 64, "test-64"


def query(oracle: str | None = None):
    """Registers a function under its name, with SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages", "embeddings") else found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.passages(documents(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics, each computed once, as Engine.reindex() would write them: as Parquet, which is a small part of
    the rows' size in a checkpoint. The passages go when both are made."""
    made = Stored(passages(spark, sf_dir).select("doc_id", "chunk_no", "text", "n_tokens"), "passages")
    post, stats = Stored(lexical.postings(made.read()), "postings"), cut(lexical.corpus_stats(made.read()))
    made.drop()
    return post.read(), stats


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.col("embedding").alias("vec"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the first passages of documents, as a cache holds them."""
    first = passages(spark, sf_dir).filter("chunk_no = 0").select("doc_id", "chunk_hash")
    return first.join(embedded(spark, sf_dir).drop("chunk_no"), "doc_id").select(F.lit(MODEL).alias("model"), F.lit(DIM).alias("dim"), "doc_id", "chunk_hash", "vec")


def asked(spark: SparkSession, text: str = X.QUESTION) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, text string")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).filter("doc_id = 0").select(F.lit("q").alias("query_id"), F.col("vec").alias("qvec"))


def r6(c: str):
    return F.round(c, 6).alias(c)


@query(f"WITH {S.PASSAGES}, {S.WORDS} SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL")
def tokenize_counts(spark, sf_dir):
    words = passages(spark, sf_dir).select("doc_id", F.explode(T.tokenize(F.col("text").cast("string"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"WITH {S.PASSAGES}, {S.WORDS} SELECT term, count(DISTINCT (doc_id, chunk_no)) AS df FROM words GROUP BY term")
def doc_frequency(spark, sf_dir):
    return lexical.document_frequency(index(spark, sf_dir)[0])


@query(f"WITH {S.PASSAGES}, {S.TOKENS} SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_passages, round(avg(len(toks)), 6) AS avg_len FROM tokens")
def passage_stats(spark, sf_dir):
    return index(spark, sf_dir)[1].select("n_docs", "n_passages", r6("avg_len"))


@query(f"WITH {S.PASSAGES} SELECT doc_id, chunk_no, CAST(start AS INT) AS start, CAST(length AS INT) AS length FROM cuts")
def chunk_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.offsets(F.octet_length("text"))).alias("chunk_no", "o"))
    return rows.select("doc_id", "chunk_no", F.col("o.start").cast("int").alias("start"), F.col("o.length").alias("length"))


@query(f"WITH {S.PASSAGES} SELECT doc_id, chunk_no, octet_length(blob) AS n_bytes, chunk_hash FROM hashed")
def chunk_hashes(spark, sf_dir):
    return passages(spark, sf_dir).select("doc_id", "chunk_no", F.octet_length("text").cast("long").alias("n_bytes"), "chunk_hash")


@query()
def chunk_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"), T.strip_html(F.col("html")).alias("text"))
    return chunking.passages(rows).select("doc_id", "chunk_no", F.octet_length("text").alias("n_bytes"), "n_tokens", "chunk_hash")


@query(f"WITH {S.PASSAGES}, {S.POSTINGS} SELECT term, doc_id, chunk_no, tf, n_tokens FROM postings")
def posting_list(spark, sf_dir):
    return index(spark, sf_dir)[0]


def _bm25(spark, sf_dir, text):
    return lexical.bm25(asked(spark, text), *index(spark, sf_dir))


@query(f"WITH {S.PASSAGES}, {S.POSTINGS}, {S.asked(X.QUESTION)}, {S.BM25} SELECT rank, doc_id, chunk_no, round(score, 6) AS score FROM lexical")
def bm25_topk(spark, sf_dir):
    return lexical.ranked(_bm25(spark, sf_dir, X.QUESTION), lexical.DEPTH).select("rank", "doc_id", "chunk_no", r6("score"))


@query(f"WITH {S.PASSAGES}, {S.POSTINGS}, {S.asked(X.REPEATED)}, {S.BM25} SELECT rank, doc_id, chunk_no, round(score, 6) AS score FROM lexical")
def bm25_repeated_term(spark, sf_dir):
    return lexical.ranked(_bm25(spark, sf_dir, X.REPEATED), lexical.DEPTH).select("rank", "doc_id", "chunk_no", r6("score"))


@query(f"WITH {S.PASSAGES}, {S.POSTINGS}, {S.asked(X.QUESTION)}, {S.BM25}, {S.cap('SELECT query_id, doc_id, chunk_no, score AS fused FROM bm25', 20)} SELECT rank, doc_id, chunk_no, round(fused, 6) AS score FROM capped")
def bm25_per_doc_cap(spark, sf_dir):
    got = hybrid.cap(_bm25(spark, sf_dir, X.QUESTION), 20, score="score")
    return got.select("rank", "doc_id", "chunk_no", r6("score"))


@query(f"WITH {S.COSINES} SELECT rank, doc_id, round(cosine, 6) AS cosine FROM ranked_cosines WHERE rank <= 50")
def dense_topk(spark, sf_dir):
    got = lexical.ranked(dense.cosines(query_vector(spark, sf_dir), embedded(spark, sf_dir), DIM), 50, "cosine")
    return got.select("rank", "doc_id", r6("cosine"))


@query("SELECT 'same' AS query_id, 0.0 AS q_mean, 0.0 AS q_var, FALSE AS told FROM (SELECT 1) UNION ALL " f"(WITH {S.COSINES} SELECT 'q', round(avg(cosine), 6), round(var_pop(cosine), 6), var_pop(cosine) >= 1e-12 FROM cosines)")
def dense_indifference(spark, sf_dir):
    flat = spark.createDataFrame([("same", [0.0] * DIM)], "query_id string, qvec array<float>")
    got = dense.spread(dense.cosines(query_vector(spark, sf_dir).unionByName(flat), embedded(spark, sf_dir), DIM))
    return got.select("query_id", r6("q_mean"), r6("q_var"), (F.col("q_var") >= dense.SAME).alias("told"))


@query(f"WITH {S.SAMPLE} SELECT i, doc_id FROM sample")
def strided_sample(spark, sf_dir):
    return dense.strided_sample(embedded(spark, sf_dir)).select("i", "doc_id")


@query(f"WITH {S.SAMPLE}, {S.BASELINE} SELECT round(mean, 6) AS mean, round(sd, 6) AS sd, pairs FROM base")
def baseline(spark, sf_dir):
    return _base(spark, sf_dir).select(r6("mean"), r6("sd"), "pairs")


def _base(spark, sf_dir):
    return dense.baseline(dense.strided_sample(embedded(spark, sf_dir)), DIM)


def _dense(spark, sf_dir):
    return dense.dense(query_vector(spark, sf_dir), embedded(spark, sf_dir), _base(spark, sf_dir), DIM)


@query(f"WITH {S.SAMPLE}, {S.BASELINE}, {S.COSINES}, {S.DENSE} SELECT rank, doc_id, round(cosine, 6) AS cosine FROM semantic")
def dense_floor(spark, sf_dir):
    return _dense(spark, sf_dir).select("rank", "doc_id", r6("cosine"))


_FUSED = f"{S.PASSAGES}, {S.POSTINGS}, {S.asked(X.QUESTION)}, {S.BM25}, {S.SAMPLE}, {S.BASELINE}, {S.COSINES}, {S.DENSE}, {S.FUSED}"


def _fused(spark, sf_dir):
    return hybrid.fuse(lexical.ranked(_bm25(spark, sf_dir, X.QUESTION), lexical.DEPTH), _dense(spark, sf_dir))


@query(f"WITH {_FUSED} SELECT doc_id, chunk_no, round(fused, 9) AS fused, via, round(cosine, 6) AS cosine FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("doc_id", "chunk_no", F.round("fused", 9).alias("fused"), "via", r6("cosine"))


@query(f"WITH {_FUSED} SELECT via, count(*) AS n FROM fused GROUP BY via")
def hybrid_via(spark, sf_dir):
    return _fused(spark, sf_dir).groupBy("via").agg(F.count("*").alias("n"))


_HYBRID = f"{_FUSED}, {S.cap('SELECT * FROM fused', 20)}"


def _hybrid(spark, sf_dir):
    return hybrid.search_batch(asked(spark), *index(spark, sf_dir), 20, query_vector(spark, sf_dir), embedded(spark, sf_dir), _base(spark, sf_dir), DIM)


@query(f"WITH {_HYBRID} SELECT rank, doc_id, chunk_no, round(fused, 9) AS score, via, round(cosine, 6) AS cosine FROM capped")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("rank", "doc_id", "chunk_no", F.round("score", 9).alias("score"), "via", r6("cosine"))


@query(f"WITH {S.PASSAGES}, {S.POSTINGS}, {S.asked(X.QUESTION)}, {S.BM25}, {S.cap('SELECT query_id, doc_id, chunk_no, 1.0 / (60 + rank) AS fused FROM lexical', 4)} SELECT rank, doc_id, chunk_no, round(fused, 9) AS score, 'lexical' AS via FROM capped")
def lexical_only_search(spark, sf_dir):
    got = hybrid.search_batch(asked(spark), *index(spark, sf_dir), 4)
    return got.select("rank", "doc_id", "chunk_no", F.round("score", 9).alias("score"), "via")


@query(f"WITH {S.PASSAGES}, {S.POSTINGS}, {S.BATCH}, {S.BM25}, {S.cap('SELECT query_id, doc_id, chunk_no, 1.0 / (60 + rank) AS fused FROM lexical', 4)} SELECT query_id, rank, doc_id, chunk_no, round(fused, 9) AS score FROM capped")
def search_batch(spark, sf_dir):
    many = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return hybrid.search_batch(many, *index(spark, sf_dir), 4).select("query_id", "rank", "doc_id", "chunk_no", F.round("score", 9).alias("score"))


_WHITE = " || ".join(f"chr({c})" for c in [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@query(f"WITH {_HYBRID} SELECT string_agg('[' || rank || '] doc-' || doc_id || chr(10) || trim(text, {_WHITE}), chr(10) || chr(10) ORDER BY rank) AS block FROM capped JOIN passages USING (doc_id, chunk_no)")
def grounding_block(spark, sf_dir):
    return hybrid.grounding(hybrid.hits(_hybrid(spark, sf_dir), passages(spark, sf_dir))).select("block")


@query(f"WITH {_HYBRID}, best AS (SELECT doc_id, min(rank) AS rank FROM capped GROUP BY doc_id) SELECT string_agg('doc-' || doc_id, ',' ORDER BY rank) AS sources FROM best")
def source_list(spark, sf_dir):
    rows = _hybrid(spark, sf_dir).withColumn("doc_name", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return hybrid.sources(rows).select(F.array_join("sources", ",").alias("sources"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS before, 1.0 AS after FROM embeddings")
def normalize_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.select("vec_id", V.dot(F.col("embedding"), F.col("embedding"), DIM).alias("before"), V.normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return n.select("vec_id", F.round("before", 4).alias("before"), F.round(V.dot(F.col("v"), F.col("v"), DIM), 4).alias("after"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY label, i")
def mean_pool(spark, sf_dir):
    got = vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return got.select("label", F.posexplode("vec").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r6("x"))


@query(f"WITH {S.PASSAGES}, {S.CACHE} SELECT h.doc_id, h.chunk_no, c.vec IS NOT NULL AS attached, round(CAST(c.vec[1] AS DOUBLE), 6) AS x FROM hashed h LEFT JOIN cache c USING (chunk_hash)")
def attach_vectors(spark, sf_dir):
    got = vectors.attach(passages(spark, sf_dir), vectors.valid_vectors(cache(spark, sf_dir), MODEL, DIM))
    return got.select("doc_id", "chunk_no", F.col("vec").isNotNull().alias("attached"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("x"))


@query(f"WITH {S.PASSAGES}, {S.CACHE} SELECT doc_id, chunk_hash, min(chunk_no) AS chunk_no FROM hashed WHERE chunk_hash NOT IN (SELECT chunk_hash FROM cache) GROUP BY ALL")
def pending_passages(spark, sf_dir):
    return vectors.pending(passages(spark, sf_dir), cache(spark, sf_dir)).select("doc_id", "chunk_hash", "chunk_no")


@query("SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def sweep_orphans(spark, sf_dir):
    return vectors.orphans(embedded(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")).select("doc_id")


@query(f"WITH {S.PASSAGES}, {S.CACHE} SELECT count(c.vec) AS embedded, count(*) AS total FROM hashed h LEFT JOIN cache c USING (chunk_hash)")
def vec_stats(spark, sf_dir):
    return vectors.vec_stats(vectors.attach(passages(spark, sf_dir), cache(spark, sf_dir)))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return corpus.content_classes(documents(spark, sf_dir))


@query()
def hash_encode(spark, sf_dir):
    return documents(spark, sf_dir).select("id", V.hash_encode(F.col("text"), DIM).alias("vec"))


@query(f"SELECT page_id, {S.strip_html('html')} AS text FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(f"SELECT doc_id, {S.squeeze('text')} AS text FROM documents")
def squeeze_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with made-up times: each was touched as many hours before NOW as its id says."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return ids.select("id", F.lit("m").alias("model"), F.lit(X.NOW).cast("timestamp_ntz").alias("created"), F.expr(f"timestampadd(HOUR, -CAST(id % 1500 AS INT), TIMESTAMP_NTZ '{X.NOW}')").alias("updated"))


@query(f"WITH {S.TITLES} SELECT chat_id, title FROM titles")
def chat_title(spark, sf_dir):
    return chats.titles(messages(spark, sf_dir))


@query(f"WITH {S.TITLES}, {S.METAS} SELECT id, title, count, updated, CAST(row_number() OVER (ORDER BY updated DESC, id DESC) AS INT) AS place FROM metas")
def chat_list(spark, sf_dir):
    got = chats.metas(chat_rows(spark, sf_dir), messages(spark, sf_dir))
    # the place in one client's list; the list is what is shown, so numbering it is the feature
    from pyspark.sql import Window

    return got.select("id", "title", "count", "updated", F.row_number().over(Window.orderBy(F.desc("updated"), F.desc("id"))).alias("place"))


@query(f"WITH {S.TITLES} SELECT chat_id, title FROM titles WHERE contains(lower(title), 'the')")
def chat_search(spark, sf_dir):
    return chats.search_titles(chats.titles(messages(spark, sf_dir)), " THE ")


@query(f"WITH {S.TITLES}, {S.METAS}, b AS (SELECT *, {S.bucket('updated', X.NOW)} AS bucket FROM metas) SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY updated DESC, id DESC) = 1 AS header FROM b")
def chat_buckets(spark, sf_dir):
    got = chats.buckets(chats.metas(chat_rows(spark, sf_dir), messages(spark, sf_dir)), F.to_date(F.lit(X.NOW)))
    return got.select("id", "bucket", "header")


@query("SELECT conv_id AS chat_id, turn AS pos, role FROM conversations c WHERE turn < (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)")
def drop_last(spark, sf_dir):
    return chats.drop_last(messages(spark, sf_dir)).select("chat_id", "pos", "role")


@query("SELECT conv_id AS chat_id, arg_min(text, turn) AS content FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def first_user(spark, sf_dir):
    return chats.first_user(messages(spark, sf_dir))


@query("SELECT conv_id AS chat_id, turn AS pos, role, text AS content FROM conversations")
def chat_replay(spark, sf_dir):
    return chats.replay(messages(spark, sf_dir))


@query(f"WITH {S.PASSAGES} SELECT d.doc_id AS id, (SELECT count(*) FROM cuts c WHERE c.doc_id = d.doc_id) AS chunks FROM documents d")
def list_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("added", F.lit(X.NOW))
    return corpus.docs_list(docs, passages(spark, sf_dir)).select("id", "chunks")


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def lock(spark):
    from quernel.sources.files import parse_lock

    return parse_lock(_values(spark, [(x,) for x in X.LOCK], "value string"))


def drive(spark):
    return _values(spark, X.FILES, "dir string, file string, bytes bigint, sha256 string")


@query(f"WITH {S.LOCK} SELECT kind, repo, rev, file, coalesce(bytes, -1) AS bytes, sha256, coalesce(profile, -1) AS profile FROM lock")
def lock_scan(spark, sf_dir):
    return lock(spark).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("bytes", "profile")})


@query(f"WITH {S.LOCK}, {S.FILES} {S.VERIFY}")
def verify_status(spark, sf_dir):
    return manifest.verify(lock(spark), drive(spark), check_sha=True).withColumn("percent", F.coalesce("percent", F.lit(-1)))


@query(f"WITH {S.LOCK}, {S.FILES} SELECT dir, file, bytes FROM files WHERE dir IN ('models', 'embed') AND file LIKE '%.gguf' AND file NOT IN (SELECT file FROM lock WHERE kind IN ('model', 'embed'))")
def unpinned_files(spark, sf_dir):
    return manifest.unpinned(lock(spark), drive(spark))


@query(f"WITH {S.LOCK}, {S.FILES}, v AS ({S.VERIFY}) SELECT CAST(count_if(status = 'OK') AS BIGINT) AS ok, CAST(count_if(status NOT IN ('OK', 'MISSING')) AS BIGINT) AS bad, CAST(count_if(status = 'MISSING') AS BIGINT) AS missing, CAST(1 AS BIGINT) AS unpinned FROM v")
def verify_counters(spark, sf_dir):
    return manifest.counters(manifest.verify(lock(spark), drive(spark), check_sha=True), manifest.unpinned(lock(spark), drive(spark)))


@query(f"WITH {S.LOCK}, {S.FILES} SELECT kind, repo, file, bytes FROM lock l WHERE kind IN ('model', 'embed') AND coalesce(profile, 0) <= 128 AND NOT EXISTS (SELECT 1 FROM files f WHERE f.dir = {S.DIR} AND f.file = l.file AND f.bytes = l.bytes)")
def needed_downloads(spark, sf_dir):
    return manifest.needed(lock(spark), drive(spark), 128)


@query(f"WITH {S.LOCK}, p AS (SELECT DISTINCT profile FROM lock WHERE profile IS NOT NULL) SELECT profile, CAST((SELECT sum(bytes) FROM lock l WHERE kind IN ('model', 'embed') AND coalesce(l.profile, 0) <= p.profile) AS BIGINT) AS bytes FROM p")
def profile_sizes(spark, sf_dir):
    return manifest.profile_sizes(lock(spark))


@query(f"WITH {S.LOCK}, p AS (SELECT DISTINCT profile FROM lock WHERE profile IS NOT NULL), s AS (SELECT profile, (SELECT sum(bytes) FROM lock l WHERE kind IN ('model', 'embed') AND coalesce(l.profile, 0) <= p.profile) AS bytes FROM p) SELECT max(profile) AS profile FROM s WHERE bytes <= {X.DRIVE_BYTES} - greatest(8589934592, {X.DRIVE_BYTES} // 10)")
def profile_fit(spark, sf_dir):
    return manifest.largest_profile(lock(spark), X.DRIVE_BYTES)


@query(f"WITH {S.LOCK}, {S.FILES}, p AS (SELECT DISTINCT profile FROM lock WHERE profile IS NOT NULL) SELECT max(profile) AS profile FROM p WHERE NOT EXISTS (SELECT 1 FROM lock l WHERE kind IN ('model', 'embed') AND coalesce(l.profile, 0) <= p.profile AND NOT EXISTS (SELECT 1 FROM files f WHERE f.dir = {S.DIR} AND f.file = l.file))")
def complete_profile(spark, sf_dir):
    return manifest.complete_profile(lock(spark), drive(spark))


@query(f"WITH {S.MODELS}, f AS (SELECT *, sum(bytes) OVER (ORDER BY bytes DESC, id) AS run FROM models WHERE NOT regexp_matches(id, '-\\d{{5}}-of-\\d{{5}}$') AND bytes <= {X.BUDGET}) SELECT count(*) AS fitting, CAST(greatest(1, count_if(run <= {X.BUDGET})) AS BIGINT) AS models_max FROM f")
def models_max(spark, sf_dir):
    return manifest.packing(_values(spark, X.MODELS, "id string, bytes bigint").filter("bytes IS NOT NULL").withColumnRenamed("id", "name"), X.BUDGET)


@query(S.RAM)
def ram_budget(spark, sf_dir):
    rows = _values(spark, X.RAM, "ram bigint, encoder bigint")
    return rows.select("ram", F.coalesce("encoder", F.lit(0)).alias("encoder"), manifest.budget(F.col("ram"), F.col("encoder")).cast("bigint").alias("budget"))


@query(S.PICKER)
def model_bands(spark, sf_dir):
    sizes = _values(spark, X.MODELS, "id string, bytes bigint").filter("bytes IS NOT NULL").withColumn("fits", F.col("bytes") <= X.BUDGET)
    got = manifest.picker(_values(spark, X.MODELS, "id string, bytes bigint").select("id"), sizes)
    return got.select("id", "label", "tag", "band", "usable", F.round("weight", 0).cast("bigint").alias("weight"))


@query(S.NAMES)
def model_names(spark, sf_dir):
    rows = _values(spark, [(x,) for x in X.MODEL_IDS], "id string")
    q, p = T.prefixes(F.col("id"))
    return rows.select("id", T.model_name(F.col("id")).alias("name"), q.alias("query_prefix"), p.alias("doc_prefix"))


@query(S.SIZES)
def sizes_shown(spark, sf_dir):
    rows = _values(spark, [(x,) for x in X.SIZES], "n bigint")
    return rows.select("n", T.pretty_bytes(F.col("n")).alias("shown"))


@query()
def torn_jsonl(spark, sf_dir):
    from quernel.sources.files import parse_chats

    files = _values(spark, X.CHAT_FILES, "stem string, all string").withColumn("updated", F.lit(X.NOW).cast("timestamp"))
    return parse_chats(files)[1].select("chat_id", "pos", "role", "content")


@query()
def extract_formats(spark, sf_dir):
    from quernel.sources.extract import extract_files

    return extract_files(_values(spark, X.office_files(), "path string, content binary"))


@query("SELECT * FROM (VALUES ('text', FALSE), ('nul', TRUE), ('empty', FALSE), ('five', FALSE), ('six', TRUE), ('late', FALSE)) t(name, is_binary)")
def binary_sniff(spark, sf_dir):
    rows = _values(spark, X.BLOBS, "name string, content binary")
    return rows.select("name", T.looks_binary(F.col("content")).alias("is_binary"))
