from pyspark.sql import functions as F

from quernel.operators import chunking, dense, hybrid, lexical, vectors


def corpus(spark, docs):
    made = chunking.passages(spark.createDataFrame(docs, "id string, name string, text string"))
    return made, lexical.postings(made), lexical.corpus_stats(made)


def ask(spark, text):
    return spark.createDataFrame([("q", text)], "query_id string, text string")


THREE = [("1", "ejecting.md", "Eject the drive before you pull the drive out."), ("2", "baking.md", "Bake the bread for an hour."), ("3", "models.md", "Models live on the drive.")]


def test_best_match_first_and_no_match_is_empty(spark):
    _, post, stats = corpus(spark, THREE)
    got = hybrid.search_batch(ask(spark, "eject drive"), post, stats).orderBy("rank").collect()
    assert got[0].doc_id == "1" and {r.via for r in got} == {"lexical"}
    assert hybrid.search_batch(ask(spark, "zebra"), post, stats).isEmpty()
    assert hybrid.search_batch(ask(spark, "the and"), post, stats).isEmpty()


def test_a_document_has_two_hits_at_most(spark):
    long = "\n\n".join(["drive " + "filler " * 110] * 12)
    _, post, stats = corpus(spark, [("1", "long", long), ("2", "short", "a drive of its own")])
    got = hybrid.search_batch(ask(spark, "drive"), post, stats, 20).collect()
    assert sum(r.doc_id == "1" for r in got) == 2 and sum(r.doc_id == "2" for r in got) == 1


def test_ties_fall_by_document(spark):
    _, post, stats = corpus(spark, [(str(i), "same", "drive drive") for i in (3, 1, 2)])
    got = hybrid.search_batch(ask(spark, "drive"), post, stats).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["1", "2", "3"]


def test_a_repeated_word_counts_twice(spark):
    _, post, stats = corpus(spark, THREE)
    one, two = (lexical.bm25(ask(spark, t), post, stats).filter("doc_id = '1'").first().score for t in ("drive", "drive drive"))
    assert abs(two - 2 * one) < 1e-12


def test_postings_shuffle_once_whatever_the_batch(spark):
    """Postings are dealt by passage; no row for each query and passage is shuffled."""
    made, post, stats = corpus(spark, THREE)
    asked = spark.createDataFrame([(str(i), "eject the drive drive models") for i in range(30)], "query_id string, text string")
    got = lexical.bm25(asked, post, stats)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id" not in plan
    one = {(r.doc_id, r.score) for r in lexical.bm25(ask(spark, "eject the drive drive models"), post, stats).collect()}
    assert len(one) == 2 and {(r.query_id, r.doc_id, r.score) for r in got.collect()} == {(str(i), *x) for i in range(30) for x in one}


def test_index_keeps_postings_alone_as_parquet(spark):
    from quernel.plans import catalogue
    from quernel.runtime import ensure_checkpoint_dir

    post, stats = catalogue.index(spark, "/root/testdata/sf0.001")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    assert all("/quernel/postings-" in f for f in post.inputFiles()) and post.inputFiles()
    folder = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark).rstrip("/") + "/quernel")
    assert not any("passages-" in f.getPath().getName() for f in folder.getFileSystem(conf).listStatus(folder))
    assert post.select("doc_id", "chunk_no").distinct().count() <= stats.first().n_passages


def vec(i, n=8):
    return [1.0 if k == i else 0.0 for k in range(n)]


def test_fusion_prefers_agreement(spark):
    rank = "query_id string, doc_id string, chunk_no int, rank int"
    lex = spark.createDataFrame([("q", "a", 0, 1), ("q", "b", 0, 2)], rank)
    sem = spark.createDataFrame([("q", "b", 0, 1, 0.9), ("q", "c", 0, 2, 0.8)], rank + ", cosine double")
    got = {r.doc_id: r for r in hybrid.cap(hybrid.fuse(lex, sem), 4).collect()}
    assert got["b"].rank == 1 and got["b"].via == "both" and got["a"].via == "lexical" and got["c"].via == "semantic" and got["a"].cosine is None


def test_an_indifferent_query_has_no_dense_hit(spark):
    have = spark.createDataFrame([(str(i), 0, vec(0)) for i in range(12)], "doc_id string, chunk_no int, vec array<float>")
    q = spark.createDataFrame([("q", vec(0))], "query_id string, qvec array<float>")
    base = dense.baseline(dense.strided_sample(have), 8)
    assert dense.dense(q, have, base, 8).isEmpty()
    assert dense.dense(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<float>"), have, base, 8).isEmpty()


def test_baseline_of_a_single_document_uses_distant_pairs(spark):
    have = spark.createDataFrame([("d", i, vec(i % 8)) for i in range(200)], "doc_id string, chunk_no int, vec array<float>")
    sample = dense.strided_sample(have)
    assert sample.count() == 96
    got = dense.baseline(sample, 8).first()
    assert got.pairs == sum(1 for a in range(96) for b in range(a + 4, 96))
    few = dense.baseline(dense.strided_sample(have.limit(3)), 8).first()
    assert (few.mean, few.sd, few.pairs) == (0.0, 0.0, 0)


def test_unrolled_and_folded_products_agree(spark):
    from quernel.functions.vector import dot

    row = spark.createDataFrame([([1.0, 2.5, -3.0], [0.5, 2.0, 1.0], [1.0])], "a array<float>, b array<float>, c array<float>").select(dot(F.col("a"), F.col("b"), 3).alias("x"), dot(F.col("a"), F.col("b")).alias("y"), dot(F.col("a"), F.col("c"), 3).alias("z"), dot(F.col("a"), F.col("c")).alias("w")).first()
    assert row.x == row.y == 2.5 and row.z == row.w == 0.0


def test_vectors_follow_the_text_and_bad_ones_are_left_out(spark):
    made, _, _ = corpus(spark, THREE + [("4", "copy", THREE[0][2])])
    first = made.filter("doc_id = '1'").first().chunk_hash
    schema = "model string, dim int, doc_id string, chunk_hash string, vec array<float>"
    cache = spark.createDataFrame([("m", 2, "1", first, [1.0, 0.0]), ("m", 2, "2", "h2", [float("nan"), 0.0]), ("m", 2, "3", "h3", [1.0]), ("other", 2, "3", "h3", [1.0, 0.0])], schema)
    good = vectors.valid_vectors(cache, "m")
    assert [r.doc_id for r in good.collect()] == ["1"]
    got = vectors.vec_stats(vectors.attach(made, good)).first()
    assert (got.embedded, got.total) == (2, 4)
    assert {r.doc_id for r in vectors.pending(made, good).collect()} == {"2", "3"}
    assert vectors.pending(made, good, spark.createDataFrame([("m", h) for h in {r.chunk_hash for r in made.collect()}], "model string, chunk_hash string")).isEmpty()
    assert {r.doc_id for r in vectors.orphans(cache, spark.createDataFrame([("1",)], "doc_id string")).collect()} == {"2", "3"}


def test_k_is_parsed(spark):
    assert [hybrid.parse_k(k) for k in (None, "", "0", "1", "20", "21", "x", 7)] == [4, 4, 4, 1, 20, 4, 4, 7]
