"""PDF files made by hand, and the pages read from them."""

import zlib

from ledgerlens.sources import pdf


def made(contents, packed=False, extra=b""):
    """A file with a page for each content stream, in a tree whose numbers run against the order of pages."""
    n = len(contents)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Resources << /Font << /F1 90 0 R /F2 91 0 R >> >> /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (50 - k) for k in range(n)))}
    objects[90] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects[91] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 92 0 R >>"
    cmap = b"2 beginbfchar <0001> <041F> <0002> <0440> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    streams = {92: cmap}
    for k, c in enumerate(contents):
        objects[50 - k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (60 + k)
        streams[60 + k] = c
    out = b"%PDF-1.5\n"
    if packed:
        numbers = sorted(objects)
        bodies, at, heads = b"", 0, b""
        for x in numbers:
            heads += b"%d %d " % (x, at)
            bodies += objects[x] + b"\n"
            at = len(bodies)
        data = zlib.compress(heads + bodies)
        out += b"99 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(numbers), len(heads), len(data)) + data + b"\nendstream\nendobj\n"
    else:
        for x, body in objects.items():
            out += b"%d 0 obj\n%s\nendobj\n" % (x, body)
    for x, body in streams.items():
        data = zlib.compress(body)
        out += b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\r\n" % (x, len(data)) + data + b"\nendstream\nendobj\n"
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


CONTENTS = [
    rb"BT /F1 12 Tf 72 700 Td (Loan \(senior\) agreement) Tj 0 -14 Td [(No. LA) -20 (-7) -400 (of)] TJ T* (caf\351) Tj ET",
    b"BT /F2 12 Tf <00010002> Tj 0 -10 TD <0010 0011 0012> Tj ET",
]


def test_pages_in_order_with_their_text():
    for packed in (False, True):
        pages, warnings = pdf.read_pages(made(CONTENTS, packed))
        assert warnings == [] and pages == [(1, "Loan (senior) agreement\nNo. LA-7 of\ncaf\u00e9", 0), (2, "\u041f\u0440\nabc", 0)]


def test_what_cannot_be_read_is_a_warning():
    assert pdf.read_pages(b"plain") == ([], ["NOT_PDF"]) and pdf.read_pages(made(CONTENTS, extra=b"/Encrypt 7 0 R ")) == ([], ["ENCRYPTED"])
    assert pdf.read_pages(b"%PDF-1.4\n") == ([], ["NO_PAGES"])
    broken = made(CONTENTS).replace(b"stream\r\n", b"stream\r\nxx", 99)
    pages, warnings = pdf.read_pages(broken)
    assert [p[1] for p in pages] == ["", ""] and warnings == ["CONTENT_STREAM"]


def test_files_are_scanned(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(CONTENTS))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    got = {(r["path"].rsplit("/", 1)[1], r["page_number"]): (r["raw_text"], r["warnings"]) for r in pdf.scan(spark, f"file://{tmp_path}/*.pdf").collect()}
    assert got["b.pdf", None] == (None, ["NOT_PDF"]) and got["a.pdf", 2] == ("\u041f\u0440\nabc", []) and len(got) == 3
