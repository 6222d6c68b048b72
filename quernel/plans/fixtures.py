"""Small made-up inputs for queries that no test table covers."""

from __future__ import annotations

import io
import tarfile
import zipfile

QUESTION = "oned heble erthan thing"
REPEATED = "thing oned thing thing"
NOW = "2026-01-05 10:00:00"
DRIVE_BYTES = 128 << 30
BUDGET = 24 << 30

LOCK = [
    "# pinned files",
    "release v1.2 someone/things",
    "llama_ref b4000",
    "binary mac/server 1000 aa01",
    "embed org/enc main enc-small.gguf 300 e001 64",
    "model org/a main a-8B-Q4_K_M.gguf 5000000000 a001 64",
    "model org/b main b-32B-Q4_K_M.gguf 19000000000 b001 128",
    "model org/c main c-70B-Q4_K_M.gguf 140000000000 c001 256",
    "",
    "model org/d main d-1B.gguf 700000000 d001",
]
FILES = [
    ("bin", "mac/server", 1000, "ffff"),
    ("embed", "enc-small.gguf", 300, "e001"),
    ("models", "a-8B-Q4_K_M.gguf", 2500000000, "zz"),
    ("models", "b-32B-Q4_K_M.gguf", 19000000001, "b001"),
    ("models", "d-1B.gguf", 700000000, "d001"),
    ("models", "stray.gguf", 1, "99"),
    ("models", "notes.txt", 1, "98"),
]
MODELS = [
    ("Alpha-8B-Instruct-Q4_K_M", 5 << 30),
    ("beta-30B-A3B-Instruct-2507-UD-Q4_K_XL", 17 << 30),
    ("Gamma-R1-70B-IQ4_XS", 40 << 30),
    ("delta-4b-it-qat", None),
    ("huge-123B-00001-of-00003", 9 << 30),
    ("mystery", None),
    ("tiny-0.6B-Q8_0", 600 << 20),
]
RAM = [(8 << 30, None), (16 << 30, 330_000_000), (32 << 30, 330_000_000), (128 << 30, 330_000_000), (5 << 30, 2 << 30)]
MODEL_IDS = ["/media/x/embed/bge-small-en-v1.5-q8_0.gguf", "C:\\m\\nomic-embed-text-v1.5.GGUF", "embeddinggemma-300m", "multilingual-e5-base", "Qwen3-Embedding-0.6B", "plain", "a/b/gte-large.gguf.bak"]
SIZES = [0, 1 << 20, 600 << 20, (1 << 30) - 1, 1 << 30, 5 << 30, 1610612736]
CHAT_FILES = [
    ("20260101-000000-aaaa", '{"v":1,"id":"20260101-000000-aaaa","model":"m"}\n{"role":"user","content":"hello"}\n{"role":"assistant","content":"hi"}\n{"role":"us'),
    ("20260101-000000-bbbb", '{"role":"user","content":"no header"}\n\nnot json\n{"role":"","content":"x"}\n{"role":1,"content":"x"}\n{"role":"user"}\n'),
    ("20260101-000000-cccc", "no line end"),
]
BLOBS = [("text", b"plain\ttext\n"), ("nul", b"a\x00b"), ("empty", b""), ("five", b"\x01" * 5 + b"a" * 95), ("six", b"\x01" * 6 + b"a" * 94), ("late", b"a" * 8000 + b"\x00")]


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(members: dict[str, bytes], mode: str = "w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def paragraph(*runs: str) -> str:
    return "<a:p>" + "".join(f"<a:r><a:t>{r}</a:t></a:r>" for r in runs) + "</a:p>"


PDF = b"%PDF-1.4\n1 0 obj\n<< /Length 44 >>\nstream\nBT /F1 12 Tf 10 10 Td (Hello \\(PDF\\) text) Tj ET\nendstream\nendobj\n%%EOF"
RTF = rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator X;}Caf\'e9 \b bold\b0\par Next\tab cell \u8364? done\line end}"


def office_files() -> list[tuple[str, bytes]]:
    """One file of each format that is read or refused."""
    docx = zipped({"word/document.xml": b"<w:d xmlns:w='w'><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:d>"})
    pptx = zipped({f"ppt/slides/slide{n}.xml": f"<s xmlns:a='a'>{paragraph(f'Slide text {n}') if n != 3 else ''}</s>".encode() for n in (10, 2, 1, 3)})
    xlsx = zipped({
        "xl/sharedStrings.xml": b"<sst><si><t>name</t></si><si><r><t>si</t></r><r><t>ze</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": b"<w><sheetData><row><c t='s'><v>0</v></c><c t='s'><v>1</v></c><c/></row><row><c t='s'><v>7</v></c><c><v>3.5</v></c></row></sheetData></w>",
    })
    plain = {"notes.txt": b"in the archive", "dir/more.md": b"deeper", "__MACOSX/x.txt": b"junk", ".hidden": b"junk", "inner.zip": zipped({"a.txt": b"nested"}), "bin.dat": b"\x00\x01"}
    return [
        ("/in/a.docx", docx),
        ("/in/a.pptx", pptx),
        ("/in/a.xlsx", xlsx),
        ("/in/a.zip", zipped(plain)),
        ("/in/a.tar.gz", tarred(plain)),
        ("/in/a.tar", tarred(plain, "w")),
        ("/in/a.html", b"<h1>T&amp;C</h1><script>x()</script><p>a<b>b</b>&nbsp; c</p>"),
        ("/in/a.xml", b"<a><b> one </b><c>two</c></a>"),
        ("/in/broken.xml", b"<a><b>kept</b><c>"),
        ("/in/a.rtf", RTF),
        ("/in/a.pdf", PDF),
        ("/in/scan.pdf", b"%PDF-1.4\n%%EOF"),
        ("/in/a.csv", b"x,y\n1,2\n"),
        ("/in/old.doc", b"\xd0\xcf"),
        ("/in/a.gz", b"\x1f\x8b\x00"),
        ("/in/blank.txt", b" \n "),
    ]
