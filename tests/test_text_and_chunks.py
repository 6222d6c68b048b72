import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.functions import vector as V
from quernel.operators import chunking
from quernel.sources.extract import WHITE, looks_binary, squeeze


def trim(b: bytes) -> bytes:
    return b.decode("utf-8", "surrogateescape").strip(WHITE).encode("utf-8", "surrogateescape")


def plain_chunks(text: str) -> list[bytes]:
    """The rules of chunking.py, one step after the other."""
    groups, held = [], []
    for line in text.split("\n") + [""]:
        line = line.removesuffix("\r")
        if line.strip(WHITE):
            held.append(line)
        elif held:
            groups.append("\n".join(held).encode())
            held = []
    out, buf = [], b""
    for p in groups:
        while len(p) > 2000:
            out += [trim(buf)] if trim(buf) else []
            buf, p = b"", (out.append(trim(p[:1000])), p[850:])[1]
        if buf and len(buf) + len(p) > 1000:
            out += [trim(buf)] if trim(buf) else []
            buf = buf[-150:] + b"\n" if len(buf) > 150 else b""
        buf = buf + b"\n\n" + p if buf else p
    return out + ([trim(buf)] if trim(buf) else [])


def test_chunks_equal_the_plain_rules(spark):
    random.seed(5)
    parts = ["a ", "\n", "\n\n", " \t\n", "é", "word " * 30, "x" * 900, "\r\n", "y" * 2500, "ü" * 700, " "]
    texts = ["", " ", "\n\n"] + ["".join(random.choice(parts) for _ in range(random.randint(1, 14))) for _ in range(150)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.chunk(F.col("t")).alias("c")).collect()
    for r in got:
        assert [bytes(x) for x in r.c] == plain_chunks(r.t)


def test_long_run_is_cut_hard_and_blank_text_has_no_passage(spark):
    got = spark.createDataFrame([("x" * 9000,), (" \n ",)], "t string").select(chunking.chunk(F.col("t")).alias("c")).collect()
    assert len(got[0].c) == 10 and len(got[0].c[0]) == 1000 and got[1].c == []


def test_tokens(spark):
    row = spark.sql("SELECT 'The İstanbul ΣΑΣ é x foo_bar 12 don''t is of' AS t").select(T.tokenize(F.col("t")).alias("w")).first()
    assert row.w == ["istanbul", "σασ", "é", "foo", "bar", "12", "don", "is", "of"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \t\r\n\xa0 ab", max_size=60))
def test_squeeze_in_python_has_no_runs(text):
    got = squeeze(text)
    assert "\n\n\n" not in got and "  " not in got and got == got.strip(WHITE)


def test_native_squeeze_equals_python(spark):
    random.seed(2)
    texts = ["".join(random.choice(" \t\r\n\xa0ab ") for _ in range(40)) for _ in range(200)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.squeeze(F.col("t")).alias("s")).collect():
        assert r.s == squeeze(r.t)


def test_binary_sniff_equals_python(spark):
    random.seed(3)
    blobs = [bytes(random.choice([1, 9, 65, 66, 200]) for _ in range(n)) for n in (0, 1, 20, 100, 9000)] + [b"a\0", b"a" * 8001 + b"\0"]
    for r in spark.createDataFrame([(b,) for b in blobs], "b binary").select("b", T.looks_binary(F.col("b")).alias("x")).collect():
        assert r.x == looks_binary(bytes(r.b))


def test_hash_encoder(spark):
    def fnv(w):
        h = 2166136261
        for c in w:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        return h

    row = spark.sql("SELECT 'drive drive Eject é' AS t").select(V.hash_encode(F.col("t"), 16).alias("v")).first()
    want = [0.0] * 16
    for w in "drive drive eject é".split():
        want[fnv(w) % 16] += 1
    size = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / size) < 1e-6 for a, b in zip(row.v, want))


def test_names_titles_ids(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.stored_name(F.lit("a.zip → dir/x.txt"))) == "x.txt"
    assert one(T.stored_name(F.lit("  "))) == "untitled.txt"
    assert one(T.title_from(F.lit("a\n b " + "c" * 80))).endswith("…")
    assert one(T.title_from(F.lit(None).cast("string"))) == "New conversation"
    assert one(T.valid_id(T.new_id()))
    assert one(T.truncate(F.lit("héllo"), 2)) == "hé"
    assert one(T.junk_member(F.lit("__MACOSX/a"))) and not one(T.junk_member(F.lit("a/b.txt")))
    assert one(T.max_chars(F.lit(0), F.lit("é:"))) == 1533
