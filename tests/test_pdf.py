"""Documents written by hand, read, translated and read again."""

import http.server
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from papyra.operators import content, detect, regions, segment, typeset
from papyra.sources import documents as D
from papyra.sources import pdf

CMAP = b"2 beginbfchar <0041> <03B1> <0042> <00660069> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange"
PAGE = b"""q 1 0 0 1 0 0 cm BT /F1 10 Tf 50 700 Td (Hello) Tj 30 0 Td [(wor) -1000 (ld)] TJ T* ET
0 G 0.5 w 50 650 m 250 650 l S
1 0 0 RG 50 640 m 250 640 l S
1 g 40 690 100 30 re f
BT /F2 12 Tf 1 0 0 1 50 600 Tm 1 0 0 rg <004100420051> Tj ET Q
q 200 0 0 100 300 300 cm /Im Do Q /Fx Do
BI /W 1 /H 1 ID x EI
(kept \\(as\\) it is) Tj"""


def file_of(objects, trailer=b"<< /Root 1 0 R /Info 9 0 R >>"):
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n" + trailer + b"\nstartxref\n9\n%%EOF\n"


def stream(data, head=b""):
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), head, packed)


def example():
    resources = b"<< /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im 10 0 R /Fx 11 0 R >> >>"
    return file_of({
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources " + resources + b" >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R /Annots [12 0 R 13 0 R 14 0 R] >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABC+Times /FirstChar 32 /Widths [" + b"500 " * 96 + b"] >>",
        6: b"<< /Type /Font /Subtype /Type0 /BaseFont /CMMI10 /DescendantFonts [15 0 R] /ToUnicode 16 0 R >>",
        7: stream(PAGE), 8: b"<< /Length 29 >>\nstream\nBT /F1 10 Tf (two) Tj ET      \nendstream",
        9: b"<< /Title <FEFF00DC0062> >>",
        10: b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\nx\nendstream",
        11: stream(b"BT /F1 8 Tf 10 20 Td (in) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0]"),
        12: b"<< /Type /Annot /Subtype /Square /Rect [100 100 10 20] /BS << /S /D /D [3 2] /W 1.5 >> /C [0 0 0] >>",
        13: b"<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (http://x.org) >> >>",
        14: b"<< /Subtype /Link /Rect [1 2 3 4] /Dest [4 0 R /Fit] >>",
        15: b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [65 [600 700]] /FontDescriptor 17 0 R >>",
        16: stream(CMAP),
        17: b"<< /Type /FontDescriptor /FontName /CMMI10 /Descent -200 /FontFile2 18 0 R >>",
        18: stream(b"a font"),
    })


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("a/x.pdf", bytearray(example())), ("bad.pdf", bytearray(b"no document")), ("none.pdf", None)], "path string, content binary")


def test_syntax():
    some = b"/A#20B (a\\(b\\)\\101(x)\\\nc) <48 6> [1 2.5 5 0 R] << /K [true null] /R 7 0 R >> % no\n Tj"
    assert [v for v, _ in pdf.tokens(some)] == ["A B", b"a(b)A(x)c", b"H`", [1, 2.5, pdf.Ref(5)], {"K": [True, None], "R": pdf.Ref(7)}, "Tj"]
    value = {"A": [1, 2.5, True, None, pdf.Ref(3)], "B": pdf.Name("x y"), "C": b"\x00("}
    assert next(pdf.tokens(pdf.said(value)))[0] == {"A": [1, 2.5, True, None, pdf.Ref(3)], "B": "x y", "C": b"\x00("}
    rows = bytes([2]) + bytes(range(4)) + bytes([1]) + bytes([1] * 4) + bytes([4]) + bytes([5] * 4)
    assert pdf._unpredicted(rows, {"Predictor": 12, "Columns": 4})[:8] == bytes([0, 1, 2, 3, 1, 2, 3, 4])
    for name, raw in (("ASCIIHexDecode", b"48656c6c6f>"), ("ASCII85Decode", b"87cURDZ~>")):
        assert pdf.decoded(pdf.Stream({"Filter": pdf.Name(name)}, raw)) == b"Hello"


def test_object_streams_and_encryption():
    inside = b"1 0 2 34 3 70 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [3 0 R] >>      << /Type /Page /MediaBox [0 0 9 9] >>"
    first = inside.index(b"<<")
    at = [inside.index(b"<<"), inside.index(b"<< /Type /Pages"), inside.index(b"<< /Type /Page ")]
    head = b" ".join(b"%d %d" % (n + 1, a - first) for n, a in enumerate(at)).ljust(first)
    doc = pdf.Pdf(b"%PDF-1.7\n" + b"8 0 obj\n" + stream(head + inside[first:], b"/Type /ObjStm /N 3 /First %d" % first) + b"\nendobj\n9 0 obj\n" + stream(b"", b"/Type /XRef /Root 1 0 R") + b"\nendobj\n")
    assert [doc.box(p) for _, p in doc.pages] == [[0, 0, 9, 9]]
    with pytest.raises(ValueError):
        pdf.Pdf(file_of({1: b"<< /Type /Catalog >>"}, b"<< /Root 1 0 R /Encrypt << >> >>"))


def test_reader():
    doc = pdf.Pdf(example())
    r = pdf.Reader(doc, doc.pages[0][1])
    words = {s["text"]: s for s in r.spans}
    assert set(words) >= {"Hello", "wor", "ld", "αfib", "in"}
    assert (words["Hello"]["x0"], words["Hello"]["x1"], words["Hello"]["y0"]) == (50, 75, 700)
    assert words["ld"]["x0"] == 80 + 15 + 10 and words["in"]["x0"] == 110
    alpha = next(i for i in r.items if i["text"] == "α")
    assert (alpha["cid"], alpha["font"], alpha["color"]) == (65, "CMMI10", [1, 0, 0])
    assert abs(alpha["x1"] - alpha["x0"] - 7.2) < 1e-9 and abs(alpha["y0"] - 597.6) < 1e-9
    lines = [i for i in r.items if i["kind"] == "line"]
    assert [(i["x0"], i["x1"], i["y0"], i["size"]) for i in lines] == [(50, 250, 650, 0.5)]
    assert [(f["x0"], f["y1"], f["fill"], f["opacity"]) for f in r.fills] == [(40, 720, [1], 1)]
    assert [(i["x0"], i["x1"]) for i in r.images][0] == (300, 500) and len(r.images) == 2
    assert {i["container"] for i in r.items} == {0, 1}
    names = [n for n, _ in r.operators]
    assert names.count("n") == 1 and names.count("S") == 1 and "Do" in names


def test_pages_on_spark(spark, files):
    pages = D.read_pages(files).cache()
    assert [(r["doc"], r["pages"], r["title"]) for r in D.documents(files).collect()] == [("a/x.pdf", 2, "Üb")]
    assert sorted(r["path"] for r in D.unreadable(files).collect()) == ["bad.pdf", "none.pdf"]
    assert [(r["page"], r["page_width"]) for r in pages.orderBy("page").collect()] == [(0, 600), (1, 600)]
    assert D.read_pages(files, [1]).count() == 1
    assert [(r["font"], r["kind"], bytes(r["file"])) for r in D.embedded_fonts(files).collect()] == [("CMMI10", "FontFile2", b"a font")]
    assert regions.marks(D.rows(pages, "annots")).count() == 1
    assert sorted((r["kind"], r["uri"] or "", r["dest_page"]) for r in D.links(pages).collect()) == [("goto", "", 1), ("uri", "http://x.org", None)]
    assert {r["text"] for r in D.text_lines(pages).where("page = 0").collect()} >= {"Helloworld", "αfib"}
    cover = {r["page"]: r for r in D.image_cover(pages).collect()}
    assert cover[0]["image_area"] == 20_001 and cover[1]["page_chars"] == 3
    assert not any(r["scanned"] for r in detect.scanned(D.image_cover(pages)).collect())
    hidden = regions.covered_spans(D.rows(pages, "spans"), D.rows(pages, "fills"))
    assert {r["text"] for r in hidden.collect()} == {"Hello", "wor", "ld"}
    rest = {r["page"]: r["ops"] for r in content.residual(D.rows(pages, "operators")).collect()}
    assert "0.500000 w" in rest[0] and " n " in rest[0] and "Hello" not in rest[0] and "Tj" not in rest[0]


def test_reader_by_its_protocol(spark, files):
    from papyra.plans.translate import paragraphs_of
    from papyra.sources import adapters

    glyphs = adapters.read_glyphs(files.where("path = 'a/x.pdf'"), D.PdfReader)
    boxes = adapters.detect_regions(glyphs.select("doc", "page").distinct(), adapters.WholePageModel)
    said = {(r["page"], r["container"], r["text"]) for r in paragraphs_of(glyphs, boxes).collect()}
    assert (1, 0, "two") in said and (0, 1, "in") in said
    assert adapters.read_glyphs(files.where("path = 'a/x.pdf'"), D.PdfReader, [1]).count() == 3


def test_from_file_to_file(spark, files, tmp_path):
    """Read, segment, translate, set, write, and read what was written."""
    pages = D.read_pages(files)
    item = lambda i: F.struct(*[i[c].alias(c) if c != "region" else F.lit(2).alias("region") for c in segment.FIELDS])
    found = segment.read(pages.withColumn("items", F.transform("items", item)))
    ops = typeset.typeset(typeset.translated(found, with_text=F.upper), {("tiro", chr(c)): 0.5 for c in range(32, 127)})
    streams = typeset.drawn(ops).where("container = 0").select("doc", "page", "stream")
    tiro = {"tiro": {"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type1"), "BaseFont": pdf.Name("Times-Roman")}}
    made = D.translated_files(files, streams, tiro).cache()
    assert sorted(r["name"] for r in made.collect()) == ["x-dual.pdf", "x-mono.pdf"]
    assert D.write_files(made, str(tmp_path / "out")) == 2
    got = spark.read.format("binaryFile").load(str(tmp_path / "out"))
    assert sorted((r["pages"], r["title"]) for r in D.documents(got).collect()) == [(2, "Üb"), (4, "Üb")]
    dual = D.read_pages(got.where(F.col("path").contains("dual")))
    said = {r["page"]: "".join(s["text"] for s in r["spans"]) for r in dual.collect()}
    assert said[2] == "two" and said[3] == "TWO" and said[0].startswith("Helloworld") and "HELLO" in said[1]
    assert made.where("kind = 'mono'").first()["content"].startswith(example()[:-1])  # the old file keeps its bytes


def test_fetch(spark):
    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "gone" in self.path else 200)
            if "named" in self.path:
                self.send_header("Content-Disposition", 'attachment; filename="../told.pdf"')
            self.end_headers()
            self.wfile.write(b"x" * 5000)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/a/b.pdf?q=1",), (f"{base}/named",), (f"{base}/gone",), ("nonsense",)], "url string")
    got = {r["path"].removeprefix(base): r for r in D.fetch_files(urls).collect()}
    assert (got["/a/b.pdf?q=1"]["name"], len(got["/a/b.pdf?q=1"]["content"])) == ("b.pdf", 5000) and got["/named"]["name"] == "told.pdf"
    assert "404" in got["/gone"]["error"] and got["nonsense"]["error"] and got["nonsense"]["content"] is None
    assert {r["error"] is None for r in D.fetch_files(urls.limit(1), most=4999).collect()} == {False}
    server.shutdown()
