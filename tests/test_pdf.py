"""PDF bytes made here: trees, compressed objects, invisible layers, faults."""

import zlib

from foliospark.sources import pdf


def stream(content, extra=b"", length=True):
    body = zlib.compress(content)
    size = b" /Length %d" % len(body) if length else b""
    return b"1 0 obj << /Filter /FlateDecode" + size + extra + b" >>\nstream\n" + body + b"\nendstream endobj\n"


HEAD = b"%PDF-1.7\n"
TREE = b"<< /Type /Pages /Count 2 >> << /Type /Pages /Count 12 >>\n"
FONT, IMAGE = b"<< /Type /Font >>\n", b"<< /Subtype /Image >>\n"


def told(data):
    found = pdf.probe(data)
    return found and (found["pages"], found["kind"], found["confidence"])


def test_kinds():
    assert told(HEAD + TREE + IMAGE * 12) == (12, "scan", "high")
    assert told(HEAD + TREE + FONT) == (12, "text", "high")
    assert told(HEAD + b"<< /Type /Page >> << /Type /Page /Parent 1 >> << /Type /Pages >>" + FONT + IMAGE * 3) == (2, "text", "low")
    shown, hidden = stream(b"BT /F1 9 Tf (x) Tj ET"), stream(b"BT 3 Tr (x) Tj ET")
    assert told(HEAD + TREE + FONT + IMAGE * 12 + hidden * 5) == (12, "scan", "high")
    assert told(HEAD + TREE + FONT + IMAGE * 12 + hidden * 3 + shown * 2) == (12, "text", "high")
    assert told(HEAD + TREE + FONT + IMAGE + b"/BaseFont /GlyphLessFont") == (12, "scan", "high")
    assert told(HEAD + TREE + FONT + IMAGE * 10 + b"<< /Creator (ABBYY FineReader 9) >>") == (12, "scan", "low")
    assert told(HEAD + b"<< /Type /Pages /Count 1 >>" + FONT + IMAGE + b"x" * 130_000) == (1, "scan", "low")


def test_compressed_objects():
    inner = b"<< /Type /Pages /Count 7 >> << /Type /Font >>"
    for length in (True, False):
        assert told(HEAD + stream(inner, b" /Type /ObjStm", length)) == (7, "text", "high")
    cut = stream(inner * 400, b" /Type /ObjStm", False)
    assert told(HEAD + TREE + cut[: len(cut) // 2] + b"endstream")[0] == 12  # broken off, what decodes counts
    assert pdf.inflated(zlib.compress(b"abc" * 999)[:-6] + b"\x00\x01") != ""


def test_no_pdf():
    assert [told(x) for x in (None, b"", b"PNG" + TREE + FONT, HEAD, HEAD + FONT)] == [None] * 5


def test_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.PDF").write_bytes(HEAD + TREE + FONT)
    (tmp_path / "two.pdf").write_bytes(b"nothing")
    (tmp_path / "three.txt").write_bytes(HEAD + TREE)
    got = {r.path.rsplit("/", 1)[1]: (r.pages, r.kind) for r in pdf.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {"one.PDF": (12, "text"), "two.pdf": (None, None)}
