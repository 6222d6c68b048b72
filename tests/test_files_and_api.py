import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quernel.api import Engine
from quernel.plans import fixtures as X
from quernel.sources import extract as E
from quernel.sources import files
from quernel.sources.encoder import HttpEncoder


def test_formats():
    got = {}
    for path, data in X.office_files():
        name = path.rsplit("/", 1)[1]
        try:
            got[name] = E.extract(name, data)
        except E.Unreadable as e:
            got[name] = str(e)
    assert got["a.docx"] == [("a.docx", "One\ttwo\nThree".replace("\t", " "))]
    assert [x for x in got["a.pptx"][0][1].split("\n") if x.startswith("Slide ") and x[6:].isdigit()] == ["Slide 1", "Slide 2", "Slide 10"]
    assert "name\tsize" in got["a.xlsx"][0][1] and "7\t3.5" in got["a.xlsx"][0][1]
    for a in ("a.zip", "a.tar.gz", "a.tar"):
        assert got[a] == [(f"{a} → notes.txt", "in the archive"), (f"{a} → dir/more.md", "deeper")]
    assert got["a.html"][0][1] == "T&C\n\nab c"
    assert got["a.xml"][0][1] == "one\ntwo" and got["broken.xml"][0][1] == "kept"
    assert got["a.rtf"][0][1] == "Café bold\nNext cell € done\nend".replace("Next cell", "Next cell")
    assert got["a.pdf"][0][1] == "Hello (PDF) text" and "OCR" in got["scan.pdf"]
    assert "docx" in got["old.doc"] and got["a.gz"] == "not a text file" and "no text" in got["blank.txt"]


def test_archive_limits(monkeypatch):
    monkeypatch.setattr(E, "MAX_MEMBERS", 3)
    assert len(E.extract("a.zip", X.zipped({f"{i}.txt": b"x" for i in range(9)}))) == 3
    monkeypatch.setattr(E, "MAX_TOTAL", 10)
    assert [n for n, _ in E.extract("a.zip", X.zipped({"a.txt": b"x" * 6, "b.txt": b"y" * 6, "c.txt": b"z" * 4}))] == ["a.zip → a.txt", "a.zip → c.txt"]


def test_udtf(spark):
    E.register_udtf(spark)
    spark.createDataFrame([("a.zip", X.zipped({"a.txt": b"one", "b.txt": b"two"})), ("x.7z", b"")], "name string, content binary").createOrReplaceTempView("landed")
    got = spark.sql("SELECT e.* FROM landed, LATERAL extract_text(name, content) e").collect()
    assert sorted((r.text or "-") for r in got) == ["-", "one", "two"]


def test_chat_files(spark, tmp_path):
    for stem, text in X.CHAT_FILES:
        (tmp_path / f"{stem}.jsonl").write_text(text)
    (tmp_path / "..evil.jsonl").write_text('{"role":"user","content":"x"}\n')
    chats, messages = files.read_chat_files(spark, str(tmp_path))
    assert sorted((r.chat_id[-4:], r.role, r.content) for r in messages.collect()) == [("aaaa", "assistant", "hi"), ("aaaa", "user", "hello"), ("bbbb", "user", ""), ("bbbb", "user", "no header")]
    assert {r.id[-4:]: r.v for r in chats.collect()} == {"aaaa": 1, "bbbb": 0, "cccc": 0}


def test_long_line_and_doc_files(spark, tmp_path):
    (tmp_path / "20260101-000000-aaaa.doc").write_text('{"id":"20260101-000000-aaaa","name":"n","bytes":5,"added":"2026-01-01T00:00:00Z"}\nbody\nmore')
    (tmp_path / "20260101-000000-bbbb.doc").write_text("no header")
    (tmp_path / "bad.doc").write_text("{}\nx")
    got = files.read_doc_files(spark, str(tmp_path)).collect()
    assert [(r.id[-4:], r.name, r.bytes, r.text) for r in got] == [("aaaa", "n", 5, "body\nmore")]
    (tmp_path / "20260101-000000-cccc.jsonl").write_text('{"v":1}\n' + json.dumps({"role": "user", "content": "y" * 1_200_000}) + "\n")
    assert len(files.read_chat_files(spark, str(tmp_path))[1].first().content) == 1_200_000


def test_lock_round_trip(spark, tmp_path):
    rows = files.parse_lock(spark.createDataFrame([(x,) for x in X.LOCK], "value string"))
    files.write_lock(rows, str(tmp_path / "lock"))
    assert sorted(map(str, files.read_lock(spark, str(tmp_path / "lock")).collect())) == sorted(map(str, rows.collect()))
    assert files.read_machine(spark, str(tmp_path / "none.json")).isEmpty()


def test_engine_from_upload_to_deletion(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"))
    assert e.search("anything").isEmpty()
    upload = spark.createDataFrame([("/in/notes.txt", b"Eject the drive safely."), ("/in/more.zip", X.zipped({"d/bread.md": b"Bake the bread."})), ("/in/x.doc", b"")], "path string, content binary")
    added, refused = e.add_files(upload)
    assert sorted(r.name for r in added.collect()) == ["bread.md", "notes.txt"] and refused.count() == 1
    assert [(r.doc_name, r.via) for r in e.search("drive").collect()] == [("notes.txt", "lexical")]
    assert e.worker.start(str(tmp_path / "stream")).awaitTermination(120) and e.worker.progress.embedded == 2
    assert e.worker.once() == 0
    assert e.health().first().embedded == 2
    assert e.search("eject the drive safely.").first().doc_name == "notes.txt"
    block, names = e.grounding("bread")
    assert names[0] == "bread.md" and block.startswith("[1] bread.md\n")
    gone = e.list_docs().filter("name = 'notes.txt'").first().id
    e.delete_doc(gone)
    assert e.search("drive").isEmpty() and e.get_doc(gone).isEmpty()
    e.worker.once()
    e.documents.compact()
    assert e.documents.read().count() == 1 and e.wipe_docs() == 1 and e.health().first().docs == 0


def test_conversations_and_settings(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"))
    a = e.create_chat("m")
    e.append(a, "user", "  What  is\nthis?")
    e.append(a, "assistant", "That.", ["notes.txt"])
    with pytest.raises(ValueError):
        e.append(a, "", "x")
    assert [(r.title, r["count"]) for r in e.list_chats().collect()] == [("What is this?", 2)]
    e.drop_last(a)
    assert [m.role for m in e.get_chat(a).first().messages] == ["user"]
    e.delete_chat(a)
    assert e.list_chats().isEmpty()
    e.create_chat()
    assert e.wipe_chats() == 1
    assert e.settings() == {}
    e.save_settings({"model": "m", "n": 1})
    assert e.settings() == {"model": "m", "n": 1}
    with pytest.raises(RuntimeError):
        Engine(spark, str(tmp_path / "other"), chats=False).list_chats()


class Fake(BaseHTTPRequestHandler):
    refuse, fail, dim = 60, 0, 4

    def log_message(self, *a):
        pass

    def _say(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self._say(200, {"data": [{"id": "/m/enc-small.gguf", "meta": {"n_ctx": 100}}]})

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        if Fake.fail:
            Fake.fail -= 1
            return self._say(503, {})
        if any(len(t) > Fake.refuse for t in texts):
            return self._say(400, {})
        self._say(200, {"data": [{"index": i, "embedding": [[float(len(t)), 1, 0, 0], [1, 1, 0, 0]]} for i, t in reversed(list(enumerate(texts)))]})


def test_embedding_client(spark):
    server = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = HttpEncoder(f"http://127.0.0.1:{server.server_port}").probe()
        assert (c.model, c.dim, c.n_ctx) == ("enc-small", 4, 100)
        Fake.fail = 1
        got = c.embed(["a", "bb", "c" * 100, "d" * 280, "e"])
        assert got[3] is None and got[2] is not None and abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[0] != got[1]
        Fake.fail = 1
        assert c.embed_query("q") is None and c.embed_query("q") is not None
        rows = c.encode(spark.createDataFrame([("a", b"text")], "k string, text binary")).collect()
        assert len(rows[0].vec) == 4
    finally:
        server.shutdown()
